"""Word counts over a stream of lines.

Supports and closed or maximal sets need the whole collection; counts of words are
what a stream can keep up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of text files as they appear in a folder."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.col("value").alias("line"))


def streaming_word_counts(lines: DataFrame, empty_token: str = "drop") -> DataFrame:
    """``word, count`` so far; for output mode complete or update."""
    words = lines.select(F.explode(tokenize(F.col("line"), empty_token)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
