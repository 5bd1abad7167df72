import pytest
from pyspark.sql import functions as F

from termloom import cli
from termloom.operators import apriori_index, dictionary, encode
from termloom.sources import store
from termloom.sources.lines import lines_from_files, lines_from_table
from termloom.streaming.word_counts import stream_lines, streaming_word_counts

TEXT = ["the cat sat on the mat", "the cat sat on the hat", "a dog"]


def test_lines_from_table(spark):
    df = spark.createDataFrame([(1, 2, "a\nb\r\nc\rd\n"), (1, 3, None), (1, 4, ""), (2, 1, "\n\nx")], "c long, t long, text string")
    rows = lines_from_table(df, ["c", "t"]).collect()
    got = sorted((tuple(r["doc_id"]), r["line_no"], r["line"]) for r in rows)
    assert got == [((1, 2), 0, "a"), ((1, 2), 1, "b"), ((1, 2), 2, "c"), ((1, 2), 3, "d"), ((2, 1), 0, ""), ((2, 1), 1, ""), ((2, 1), 2, "x")]


def test_dictionary_is_dense_and_the_same_when_distributed(spark):
    counts = spark.createDataFrame([(f"w{i}", i % 7 + 1) for i in range(500)], "word string, count long")
    one = {tuple(r) for r in dictionary.build_dictionary(counts).collect()}
    many = {tuple(r) for r in dictionary.build_dictionary(counts, single_task_words=0).collect()}
    assert one == many
    ordered = sorted(one, key=lambda r: r[1])
    assert [r[1] for r in ordered] == list(range(1, 501))
    assert ordered == sorted(one, key=lambda r: (-r[2], r[0]))


def test_files_do_not_collide_and_the_command_line_round_trips(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    long = " ".join(f"t{i}" for i in range(8))
    for name in ("one", "two", "three"):
        (source / f"{name}.txt").write_text(long + "\n" + "\n".join(TEXT) + "\n")
    lines = lines_from_files(spark, str(source))
    assert lines.select("doc_id", "line_no").distinct().count() == lines.count() == 12
    collection, result = str(tmp_path / "col"), str(tmp_path / "res")
    cli.main(["convert", str(source), collection])
    for method in ("suffix", "apriori_index"):
        cli.main(["compute", collection, result, "3", "8", "--type", "2", "--method", method])
        out = str(tmp_path / f"stats-{method}")
        cli.main(["decode", result, collection, out])
        got = {r["ngram"]: r["support"] for r in store.read_text(spark, out).collect()}
        assert got == {long: 3, "the cat sat on the mat": 3, "the cat sat on the hat": 3, "a dog": 3}
    with pytest.raises(Exception):
        cli.main(["decode", result, collection, out])
    with pytest.raises(ValueError):
        cli.main(["compute", collection, result, "0", "8"])


def test_empty_word_survives_the_dictionary_file(spark, tmp_path):
    d = spark.createDataFrame([("", 1, 5), ("a", 2, 3), ("'", 3, 1)], "word string, tid int, count long")
    store.write_dictionary(d, str(tmp_path / "dic"))
    assert {tuple(r) for r in store.read_dictionary(spark, str(tmp_path / "dic")).collect()} == {("", 1, 5), ("a", 2, 3), ("'", 3, 1)}


def test_encoded_lines_and_index_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXT)], "doc_id long, line_no int, line string")
    words = dictionary.tokens(lines)
    d = dictionary.build_dictionary(dictionary.word_counts(words))
    encoded = encode.encode(words, d)
    store.write_encoded(encode.collect_lines(encoded), str(tmp_path / "seq"))
    back = encode.explode_lines(store.read_encoded(spark, str(tmp_path / "seq")))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in encoded.collect()}
    index = apriori_index.positions(encoded, 2)
    lists = apriori_index.posting_lists(index)
    store.write_index(lists, str(tmp_path / "index"))
    unnested = apriori_index.unnest(store.read_index(spark, str(tmp_path / "index")))
    as_set = lambda df: {(tuple(r["gram"]), r["doc_id"], r["line_no"], r["pos"]) for r in df.collect()}
    assert as_set(unnested) == as_set(index)
    assert lists.agg(F.sum("support")).first()[0] == index.count()
    runs = encode.frequent_runs(encode.frequent_tokens(encoded, d, 2))
    assert {(r["doc_id"], r["start"], r["len"]) for r in runs.collect()} == {(0, 0, 5), (1, 0, 5)}


def test_streaming_word_counts(spark, tmp_path):
    source = tmp_path / "s"
    source.mkdir()
    for i, t in enumerate(TEXT):
        (source / f"{i}.txt").write_text(t + "\n")
    query = streaming_word_counts(stream_lines(spark, str(source), 1)).writeStream.outputMode("complete").format("memory").queryName("words").start()
    query.processAllAvailable()
    query.stop()
    assert {r["word"]: r["count"] for r in spark.table("words").collect()}["the"] == 4


def test_command_line_in_many_blocks(spark, tmp_path, monkeypatch):
    from termloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 5)
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.txt").write_text("\n".join([*TEXT, "", "..."]) + "\n")
    (source / "two.txt").write_text("\n".join(TEXT) + "\n")
    collection = str(tmp_path / "col")
    cli.main(["convert", str(source), collection])
    found = lines_from_files(spark, str(source)).collect()
    words = {r["tid"]: r["word"] for r in store.read_dictionary(spark, f"{collection}/dic").collect()}
    rows = store.read_encoded(spark, f"{collection}/seq").collect()
    assert sorted((r["doc_id"], r["line_no"], " ".join(words[t] for t in r["tids"])) for r in rows) == sorted((r["doc_id"], r["line_no"], r["line"]) for r in found if r["line"].strip("."))
    plan = decoded_plan(spark, collection)
    assert "posexplode(tids" not in plan and "Window" not in plan


def decoded_plan(spark, collection):
    from termloom.plans.api import ngram_statistics_lines
    from termloom.types import NGramType, Params

    df = ngram_statistics_lines(store.read_encoded(spark, f"{collection}/seq"), store.read_dictionary(spark, f"{collection}/dic"), Params(2, 3, NGramType.CLOSED, "suffix"))
    return df._jdf.queryExecution().optimizedPlan().toString()
