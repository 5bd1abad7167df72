"""Counting of every subsequence of every frequent run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import frequent_runs


def naive_ngrams(frequent: DataFrame, min_support: int, max_length: int) -> DataFrame:
    """``gram, support``; partial sums are formed before the shuffle."""
    runs = frequent_runs(frequent).select("tids", "len", F.explode(F.sequence(F.lit(1), F.col("len"))).alias("b"))
    rest = F.col("len") - F.col("b") + 1
    # One n-gram a row at once: no array holds all those of a long run.
    ends = runs.select("tids", "b", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_length), rest) if max_length else rest)).alias("n"))
    grams = ends.select(F.slice("tids", F.col("b"), F.col("n")).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
