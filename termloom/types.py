"""Schemas, the kinds of n-gram sets, and validated parameters."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import types as T

LINES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())])
DICTIONARY = T.StructType([T.StructField("word", T.StringType()), T.StructField("tid", T.IntegerType()), T.StructField("count", T.LongType())])
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("tids", T.ArrayType(T.IntegerType(), False))])
NGRAMS = T.StructType([T.StructField("gram", T.ArrayType(T.IntegerType(), False)), T.StructField("n", T.IntegerType()), T.StructField("support", T.LongType())])
TEXT_STATISTICS = T.StructType([T.StructField("ngram", T.StringType()), T.StructField("support", T.LongType())])


class NGramType(IntEnum):
    """Which n-grams are returned."""

    ALL = 0  # every n-gram with enough support
    CLOSED = 1  # those without an extension by one term of equal support
    MAXIMAL = 2  # those without an extension by one term


METHODS = ("suffix", "naive", "apriori_scan", "apriori_index")
EMPTY_TOKENS = ("drop", "reference")


@dataclass(frozen=True)
class Params:
    """Minimum support (1 or more), maximum length (0: unlimited), kind, method."""

    min_support: int
    max_length: int
    kind: NGramType = NGramType.ALL
    method: str = "suffix"

    def __post_init__(self) -> None:
        if isinstance(self.min_support, bool) or not isinstance(self.min_support, int) or self.min_support < 1:
            raise ValueError("min_support must be an integer of 1 or more")
        if isinstance(self.max_length, bool) or not isinstance(self.max_length, int) or self.max_length < 0:
            raise ValueError("max_length must be an integer of 0 (unlimited) or more")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")
        object.__setattr__(self, "kind", NGramType(self.kind))
