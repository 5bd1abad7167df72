import hashlib
import random
import re

from termloom.llm.exact_dedup import drop_exact_copies, exact_dedup

from .conftest import LONG


def brute(texts, ids):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = {}
    for n, i in zip(norm, ids, strict=True):
        groups.setdefault(n, []).append(i)
    return sorted((i, min(groups[n]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for n, i in zip(norm, ids, strict=True))


def rows(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect())


def test_against_brute_force(docs_of):
    rng = random.Random(1)
    base = ["a b", "a  b", "a\tb\n", " a b", "", None, " ", "\x0b\x0c", "é x", "é x", LONG, LONG + " y"]
    texts = [rng.choice(base) for _ in range(400)]
    ids = rng.sample(range(10_000), 400)
    for hot in (1_000, 10):  # 10: every text is hot, and its copies are dealt over several parts
        df = exact_dedup(docs_of(texts, ids), hot_rows=hot)
        assert rows(df) == brute(texts, ids)
        assert sorted(r["doc_id"] for r in df.where("kept").collect()) == sorted({k for _, k, _, _ in brute(texts, ids)})


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    df = docs_of(["a", "a", "a", "b", None], [1, 1, None, None, None])
    out = exact_dedup(df).collect()
    assert len(out) == 5
    assert sum(r["kept"] for r in out) == 3
    assert {r["keep_id"] for r in out if r["group_size"] == 3} == {1}
    assert exact_dedup(docs_of([])).collect() == []


def test_filter_keeps_columns_and_one_row_of_each_group(docs_of):
    df = docs_of(["a", "a ", "a  b", "a b", "c"], [5, 4, 3, 2, 1])
    out = drop_exact_copies(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "c"), (2, "a b"), (4, "a "), (5, "a")]


def test_plan_has_one_exchange_and_no_python(docs_of):
    df = exact_dedup(docs_of(["a", "b"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan
    assert "Python" not in plan and "Arrow" not in plan
