"""Word counts and the dictionary of term ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.store import Levels


def tokens(lines: DataFrame, empty_token: str = "drop") -> DataFrame:
    """``doc_id, line_no, pos, word``; positions count from 0."""
    words = tokenize(F.col("line"), empty_token)
    return lines.select("doc_id", "line_no", F.posexplode(words).alias("pos", "word"))


def word_counts(words: DataFrame) -> DataFrame:
    """``word, count``: pre-aggregated before the one shuffle."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def build_dictionary(counts: DataFrame, single_task_words: int = 1_000_000) -> DataFrame:
    """``word, tid, count``: dense ids from 1 by falling count, ties by word.

    Up to ``single_task_words`` words are numbered in one task. Larger vocabularies are
    range-partitioned by that order, and each partition's first number is the sum of the
    sizes before it; the result is the same.
    """
    order = [F.desc("count"), F.asc("word")]
    levels = Levels(counts.sparkSession, "dictionary")
    counts = levels.keep(counts, "counts")
    if counts.count() <= single_task_words:
        rank = F.row_number().over(Window.orderBy(*order))
        return counts.select("word", rank.cast("int").alias("tid"), "count")
    place = F.monotonically_increasing_id()
    sorted_counts = counts.repartitionByRange(*order).sortWithinPartitions(*order).select("word", "count", place.alias("place"))
    ranked = levels.keep(sorted_counts.select("*", F.shiftright("place", 33).alias("part")), "ranked")
    sizes = {r["part"]: r["count"] for r in ranked.groupBy("part").count().collect()}  # one row per partition
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    start = counts.sparkSession.createDataFrame(offsets, "part long, start long")
    tid = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return ranked.join(F.broadcast(start), "part").select("word", tid.cast("int").alias("tid"), "count")


def frequent_terms(dictionary: DataFrame, min_support: int) -> DataFrame:
    """Dictionary rows with enough support. With ranked ids these are the smallest ids."""
    return dictionary.where(F.col("count") >= min_support)
