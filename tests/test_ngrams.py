import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from termloom import NGramType, Params, ngram_statistics
from termloom.operators import suffix
from termloom.operators.closure import prefix_filter, suffix_filter
from termloom.types import METHODS

MICRO = ["a x b x x", "b a x b x", "x b a x b"]


def lines(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")


def brute(texts, support, length, kind):
    counts = Counter()
    for t in texts:
        w = t.split()
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if not length or j - i <= length:
                    counts[tuple(w[i:j])] += 1
    grams = {g: c for g, c in counts.items() if c >= support}
    if kind == NGramType.ALL:
        return grams
    lost = {(g, c) for h, c in grams.items() if len(h) > 1 for g in (h[1:], h[:-1])}
    if kind == NGramType.CLOSED:
        return {g: c for g, c in grams.items() if (g, c) not in lost}
    return {g: c for g, c in grams.items() if g not in {x for x, _ in lost}}


def run(spark, texts, *args, **kwargs):
    rows = ngram_statistics(lines(spark, texts), *args, **kwargs).collect()
    out = {tuple(r["ngram"].split(" ")): r["support"] for r in rows}
    assert len(out) == len(rows) and all(len(g) == r["n"] for g, r in zip(out, rows, strict=True))
    return out


GOLDEN = {
    (3, 3, 0): "a:3, a x:3, a x b:3, b:5, x:7, x b:4",
    (3, 3, 1): "a x b:3, b:5, x:7, x b:4",
    (3, 3, 2): "a x b:3",
    (2, 5, 0): "a:3, a x:3, a x b:3, a x b x:2, b:5, b a:2, b a x:2, b a x b:2, b x:2, x:7, x b:4, x b x:2",
    (2, 5, 1): "a x b:3, a x b x:2, b:5, b a x b:2, x:7, x b:4",
    (2, 5, 2): "a x b x:2, b a x b:2",
    (3, 1, 2): "a:3, b:5, x:7",
}


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("key", GOLDEN)
def test_golden(spark, method, key):
    expected = {tuple(x.split(":")[0].split()): int(x.split(":")[1]) for x in GOLDEN[key].split(", ")}
    assert run(spark, MICRO, *key, method=method) == expected


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=9).map(" ".join), min_size=1, max_size=12), st.integers(1, 3), st.integers(0, 6))
def test_methods_agree_with_brute_force(spark, texts, support, length):
    for kind in NGramType:
        expected = brute(texts, support, length, kind)
        for method in METHODS:
            assert run(spark, texts, support, length, kind, method=method) == expected, (method, kind)


@pytest.mark.parametrize("method", METHODS)
def test_edges(spark, method):
    assert run(spark, ["x x x x"], 1, 2, method=method) == {("x",): 4, ("x", "x"): 3}
    assert ("a", "b") not in run(spark, ["a z1 b", "a z2 b", "a z3 b"], 3, 3, method=method)
    assert ("a", "b") not in run(spark, ["a", "b"] * 3, 3, 3, method=method)
    ten = " ".join(f"t{i}" for i in range(10))
    assert sorted(map(len, run(spark, [ten] * 3, 3, 4, NGramType.MAXIMAL, method=method))) == [4] * 7
    empty = ngram_statistics(lines(spark, []).limit(0), 2, 3, method=method)
    assert empty.columns == ["ngram", "n", "support"] and empty.count() == 0


def test_unlimited_length_with_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(50))
    found = run(spark, [text] * 5, 5, 0, NGramType.MAXIMAL)
    assert found == {tuple(text.split()): 5}
    texts = ["a b a b a b a c", "a b a b", "c a b a", "a"]
    assert run(spark, texts, 2, 0) == brute(texts, 2, 0, NGramType.ALL)
    assert run(spark, texts, 2, 40) == brute(texts, 2, 40, NGramType.ALL)


def test_ngrams_that_lie_in_several_ranges(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("aaaab", k=rng.randint(0, 12))) for _ in range(120)] + ["a b a a b a a a"] * 9
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(suffix, "BATCH_CELLS", 50)
    spark.conf.set(coalesce, False)
    try:
        for dealt in (1, 2, 5, 16):
            monkeypatch.setattr(suffix, "DEALT", dealt)
            for support in (1, 4):
                assert run(spark, texts, support, 0) == brute(texts, support, 0, NGramType.ALL), (dealt, support)
    finally:
        spark.conf.unset(coalesce)


def test_one_sided_filters_compose(spark):
    for kind in (NGramType.CLOSED, NGramType.MAXIMAL):
        grams = ngram_statistics(lines(spark, MICRO), 2, 5, decoded=False).select("gram", "support")
        both = {tuple(r["gram"]) for r in suffix_filter(prefix_filter(grams, kind), kind).collect()}
        once = {tuple(r["gram"]) for r in ngram_statistics(lines(spark, MICRO), 2, 5, kind, decoded=False).collect()}
        assert both == once


def test_parameters():
    for bad in ((0, 1), (1, -1), (True, 1), (1.5, 2)):
        with pytest.raises(ValueError):
            Params(*bad)
    with pytest.raises(ValueError):
        Params(1, 1, 3)
    with pytest.raises(ValueError):
        Params(1, 1, 0, "other")


def test_reference_empty_token_changes_closed_sets(spark):
    texts = ["(a b", "(a b"]
    rows = ngram_statistics(lines(spark, texts), 2, 3, NGramType.CLOSED, empty_token="reference").collect()
    assert {r["ngram"]: r["support"] for r in rows} == {" a b": 2}
    rows = ngram_statistics(lines(spark, texts), 2, 3, NGramType.CLOSED).collect()
    assert {r["ngram"]: r["support"] for r in rows} == {"a b": 2}
