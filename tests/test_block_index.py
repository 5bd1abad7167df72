from collections import Counter

import pytest

from termloom.operators import apriori_index, block_index, blocks
from termloom.operators.dictionary import tokens
from termloom.operators.encode import frequent_words
from termloom.plans import catalogue
from termloom.sources import store


@pytest.mark.parametrize("block", [7, 1 << 21])
def test_lists_of_blocks_are_those_of_the_tokens(spark, tmp_path, monkeypatch, block):
    for name, value in (("BLOCK", block), ("COUNTED", 9), ("CELLS", 5)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(block_index, "ROWS", 3)
    texts = ["a b a b once a b", "x a b", "", "...", "a a a a", "b a twice b a", "a b"] * 2 + ["lone"]
    lines = spark.createDataFrame([(-5 + i // 2 * 1000, i % 2, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")
    levels = store.Levels(spark, "test")
    placed, words = block_index.place_in_blocks(lines, 3, levels)
    lists = block_index.pair_lists(placed, words, 3)
    index, _ = apriori_index.keep_frequent(apriori_index.positions(frequent_words(tokens(lines), words, 3), 2), 3)
    got, want = (sorted(map(str, df.select("gram", "postings", "support").collect())) for df in (lists, apriori_index.posting_lists(index)))
    assert got == want and len(got) == 3
    store.write_index(lists, str(tmp_path / "index"))
    rows = block_index.decoded_positions(store.read_index(spark, str(tmp_path / "index")), words).collect()
    name = {r["tid"]: r["word"] for r in words.collect()}
    assert Counter(map(tuple, rows)) == Counter((" ".join(name[t] for t in r["gram"]), r["doc_id"], r["line_no"], r["pos"]) for r in index.collect())


def test_stored_index_sends_no_row_for_a_place(spark, tmp_path):
    spark.createDataFrame([(i, "a b a b\nb a c") for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.stored_index(spark, str(tmp_path))
    assert df.count() == 6 * 5
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(postings" not in plan and "explode(p#" not in plan
