"""Closed and maximal n-grams.

An n-gram is maximal if no n-gram of the relation extends it by one term, closed if
none with equal support does. Each n-gram meets the truncations of its extensions in
one aggregation, so the relation is computed once and shuffled once; the prefix filter
looks at extensions to the right, the suffix filter at extensions to the left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import NGramType


def _without(grams: DataFrame, truncations: list[Column], kind: NGramType) -> DataFrame:
    kind = NGramType(kind)
    if kind is NGramType.ALL:
        return grams
    own = F.struct(F.col("gram"), F.col("support").alias("own"), F.lit(None).cast("long").alias("longer"))
    cut = [F.struct(t.alias("gram"), F.lit(None).cast("long").alias("own"), F.col("support").alias("longer")) for t in truncations]
    met = grams.select(F.inline(F.when(F.size("gram") > 1, F.array(own, *cut)).otherwise(F.array(own))))
    best = met.groupBy("gram").agg(F.max("own").alias("support"), F.max("longer").alias("longer"))
    # An extension's support is at most the n-gram's own.
    lost = F.col("longer").isNotNull() if kind is NGramType.MAXIMAL else F.coalesce(F.col("longer") == F.col("support"), F.lit(False))
    return best.where(F.col("support").isNotNull() & ~lost).select("gram", "support")


def _left() -> Column:
    return F.slice("gram", F.lit(1), F.size("gram") - 1)


def _right() -> Column:
    return F.slice("gram", F.lit(2), F.size("gram") - 1)


def prefix_filter(grams: DataFrame, kind: NGramType) -> DataFrame:
    """Drops n-grams that are a prefix of another (with equal support for CLOSED)."""
    return _without(grams, [_left()], kind)


def suffix_filter(grams: DataFrame, kind: NGramType) -> DataFrame:
    """Drops n-grams that are a suffix of another (with equal support for CLOSED)."""
    return _without(grams, [_right()], kind)


def restrict(grams: DataFrame, kind: NGramType) -> DataFrame:
    """Both filters at once."""
    return _without(grams, [_left(), _right()], kind)
