"""Words to term ids, and the maximal runs of frequent terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE = ["doc_id", "line_no"]


def encode(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, line_no, pos, tid``: an equi-join on the word.

    No side is forced to be broadcast: the vocabulary grows with the collection, and
    adaptive execution broadcasts it when its measured size allows, and splits hot words.
    """
    return words.join(dictionary.select("word", "tid"), "word").select(*LINE, "pos", "tid")


def frequent_tokens(encoded: DataFrame, dictionary: DataFrame, min_support: int) -> DataFrame:
    """Tokens of frequent terms only, at their original positions (a semi-join)."""
    frequent = dictionary.where(F.col("count") >= min_support).select("tid")
    return encoded.join(frequent, "tid", "left_semi").select(*LINE, "pos", "tid")


def frequent_words(words: DataFrame, dictionary: DataFrame, min_support: int) -> DataFrame:
    """:func:`encode` and :func:`frequent_tokens` in one join."""
    return encode(words, dictionary.where(F.col("count") >= min_support))


def collect_lines(encoded: DataFrame) -> DataFrame:
    """``doc_id, line_no, tids``: one row per line that has tokens."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "tid")))
    return encoded.groupBy(*LINE).agg(F.transform(ordered, lambda x: x["tid"]).alias("tids"))


def explode_lines(lines: DataFrame) -> DataFrame:
    """The inverse of :func:`collect_lines`, with dense positions."""
    return lines.select(*LINE, F.posexplode("tids").alias("pos", "tid"))


def frequent_runs(frequent: DataFrame) -> DataFrame:
    """``doc_id, line_no, start, len, tids``: maximal runs of adjacent frequent tokens."""
    by_line = Window.partitionBy(*LINE).orderBy("pos")
    runs = frequent.withColumn("run", F.col("pos") - F.row_number().over(by_line))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "tid")))
    found = runs.groupBy(*LINE, "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("len"), ordered.alias("tokens"))
    return found.select(*LINE, "start", "len", F.transform("tokens", lambda x: x["tid"]).alias("tids"))
