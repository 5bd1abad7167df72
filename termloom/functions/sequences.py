"""Sequences of term ids as array columns.

The descending order of an array column is the engine's order of sequences: larger ids
first, and of two sequences with a common prefix the longer first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcp(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; null counts as empty."""
    shorter = F.least(F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0)))
    differ = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.element_at(a, i) != F.element_at(b, i))
    return F.when(shorter <= 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, shorter)).cast("int")


def is_prefix(a: Column, s: Column) -> Column:
    """Whether ``a`` is a prefix of ``s`` (or equal to it); false for null."""
    return F.coalesce((F.size(a) <= F.size(s)) & (a == F.slice(s, F.lit(1), F.greatest(F.size(a), F.lit(0)))), F.lit(False))


def is_suffix(a: Column, s: Column) -> Column:
    """Whether ``a`` is a suffix of ``s`` (or equal to it); false for null."""
    start = F.greatest(F.size(s) - F.size(a) + 1, F.lit(1))
    return F.coalesce((F.size(a) <= F.size(s)) & (a == F.slice(s, start, F.greatest(F.size(a), F.lit(0)))), F.lit(False))


def window(a: Column, begin: int | Column, end: int | Column) -> Column:
    """Elements from ``begin`` (0-based) up to ``end`` (exclusive); none if ``end`` is not larger."""
    begin, end = (F.lit(x) if isinstance(x, int) else x for x in (begin, end))
    return F.slice(a, begin + 1, F.greatest(end - begin, F.lit(0)))


def prefixes(a: Column) -> Column:
    """All non-empty prefixes, the shortest first."""
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a)), lambda n: F.slice(a, F.lit(1), n))).otherwise(F.array())


def windows(a: Column, k: int) -> Column:
    """All windows of length ``k``."""
    return F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(1), F.size(a) - (k - 1)), lambda i: F.slice(a, i, F.lit(k)))).otherwise(F.array())


def subsequences(a: Column, max_length: int) -> Column:
    """All contiguous subsequences up to ``max_length`` (0: of any length)."""
    limit = F.lit(max_length or 2**31 - 1)
    at = lambda b: F.transform(F.sequence(F.lit(1), F.least(limit, F.size(a) - b + 1)), lambda n: F.slice(a, b, n))
    return F.when(F.size(a) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.size(a)), at))).otherwise(F.array())


def as_text(a: Column) -> Column:
    """``[1, 2]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))


def term_frequency(offsets: Column) -> Column:
    """Occurrences in one posting."""
    return F.size(offsets)
