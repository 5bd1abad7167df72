from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import sequences as seq

ARRAYS = st.lists(st.integers(1, 3), max_size=6)


def python_lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(ARRAYS, ARRAYS), min_size=20, max_size=40))
def test_scalar_functions(spark, rows):
    rows += [([], []), ([1], []), ([], [1]), ([1, 2], [1, 2])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    out = df.select(
        "i", seq.lcp(a, b).alias("l"), seq.is_prefix(a, b).alias("p"), seq.is_suffix(a, b).alias("s"), seq.prefixes(a).alias("ps"),
        seq.windows(a, 2).alias("w"), seq.subsequences(a, 3).alias("u"), seq.subsequences(a, 0).alias("all"), seq.as_text(a).alias("t"),
    )
    for r in out.collect():
        x, y = rows[r["i"]]
        assert r["l"] == python_lcp(x, y)
        assert r["p"] == (y[: len(x)] == x)
        assert r["s"] == (len(x) <= len(y) and y[len(y) - len(x) :] == x)
        assert r["ps"] == [x[: i + 1] for i in range(len(x))]
        assert r["w"] == [x[i : i + 2] for i in range(len(x) - 1)]
        assert sorted(r["u"]) == sorted(x[i:j] for i in range(len(x)) for j in range(i + 1, min(len(x), i + 3) + 1))
        assert len(r["all"]) == len(x) * (len(x) + 1) // 2
        assert r["t"] == str(x)


def test_nulls_windows_and_order(spark):
    df = spark.createDataFrame([(None, [1]), ([1], None)], "a array<int>, b array<int>")
    got = df.select(seq.lcp(F.col("a"), F.col("b")), seq.is_prefix(F.col("a"), F.col("b")), seq.is_suffix(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0, False, False)] * 2
    arrays = spark.createDataFrame([([1, 2],), ([1, 2, 3],), ([2],), ([1, 3],)], "g array<int>")
    assert [r["g"] for r in arrays.orderBy(F.desc("g")).collect()] == [[2], [1, 3], [1, 2, 3], [1, 2]]
    assert arrays.select(seq.window(F.lit([5, 6, 7]), 1, 3).alias("w"), seq.term_frequency(F.lit([4, 9])).alias("f")).first()[:] == ([6, 7], 2)
