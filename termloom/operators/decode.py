"""Term ids back to words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode(grams: DataFrame, dictionary: DataFrame, keep_gram: bool = False) -> DataFrame:
    """``ngram, n, support`` (after ``gram``, if kept): words joined by one space. Every id must be in the dictionary."""
    terms = grams.select("gram", "support", F.posexplode("gram").alias("i", "tid"))
    named = terms.join(dictionary.select("tid", "word"), "tid", "left")
    word = F.coalesce("word", F.raise_error(F.concat(F.lit("unknown term id "), F.col("tid").cast("string"))).cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("i", word.alias("word"))))
    out = named.groupBy("gram", "support").agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("ngram"))
    return out.select(*(["gram"] if keep_gram else []), "ngram", F.size("gram").alias("n"), "support")
