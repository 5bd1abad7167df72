"""Suffix aggregation: each position is emitted once, with all n-grams that begin there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import prefixes
from .encode import LINE, frequent_runs

#: From this length on (and without a limit) prefixes are not materialised.
LONG = 32
#: Terms that tell ranges of suffixes apart.
DEALT = 16
#: Terms of the n-grams that are put out at once.
BATCH_CELLS = 1 << 18


def suffixes(frequent: DataFrame, max_length: int) -> DataFrame:
    """``suffix``: per frequent token, the run that begins there, cut to ``max_length`` (0: not cut).

    One window over the line: tokens after a gap have a larger distance in position than
    in order, and are filtered from the window's list.
    """
    by_line = Window.partitionBy(*LINE).orderBy("pos")
    if max_length:
        ahead = F.collect_list(F.struct("pos", "tid")).over(by_line.rowsBetween(0, max_length - 1))
        adjacent = F.filter("ahead", lambda x, i: x["pos"] == F.col("pos") + i)
        return frequent.select("pos", ahead.alias("ahead")).select(F.transform(adjacent, lambda x: x["tid"]).alias("suffix"))
    starts = F.explode(F.sequence(F.lit(1), F.col("len")))
    return frequent_runs(frequent).select("tids", "len", starts.alias("b")).select(F.slice("tids", F.col("b"), F.col("len") - F.col("b") + 1).alias("suffix"))


def suffix_counts(frequent: DataFrame, max_length: int) -> DataFrame:
    """``suffix, count`` of distinct suffixes."""
    return suffixes(frequent, max_length).groupBy("suffix").agg(F.count(F.lit(1)).alias("count"))


def suffix_ngrams(frequent: DataFrame, min_support: int, max_length: int) -> DataFrame:
    """``gram, support`` of n-grams with enough support."""
    counts = suffix_counts(frequent, max_length)
    if not max_length or max_length > LONG:
        return stack_ngrams(counts, min_support)
    grams = counts.select(F.explode(prefixes(F.col("suffix"))).alias("gram"), "count")
    return grams.groupBy("gram").agg(F.sum("count").alias("support")).where(F.col("support") >= min_support)


def stack_ngrams(counts: DataFrame, min_support: int) -> DataFrame:
    """``gram, support`` from counted suffixes, in one pass over sorted suffixes.

    Suffixes are cut into ranges by their first ``DEALT`` terms and sorted. A stack holds
    the current suffix as segments: the prefixes that end in one segment have one support.
    Work is a comparison for each suffix, and the output. Only n-grams shorter than
    ``DEALT`` can lie in several ranges; they begin the first or the last suffix of a task,
    which gives their part whatever its support.
    """
    dealt = counts.repartitionByRange(F.slice("suffix", 1, DEALT)).sortWithinPartitions(F.desc("suffix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        supports: list[int] = []
        cells = 0
        ends: list[int] = []  # of the segments of ``last``
        sums: list[int] = []
        last = np.empty(0, np.int32)
        of_first: int | None = None  # how much of ``last`` begins the task's first suffix

        def give(begin: int, end: int, support: int, split: int) -> Iterator[pa.RecordBatch]:
            """The prefixes of ``last`` longer than ``begin`` up to ``end``; up to ``split`` with any support."""
            nonlocal cells
            for n in range(begin + 1, (end if support >= min_support else min(end, split)) + 1):
                grams.append(last[:n])
                supports.append(support)
                cells += n
                if cells >= BATCH_CELLS:
                    yield out()

        def pop(to: int, split: int) -> Iterator[pa.RecordBatch]:
            while ends and ends[-1] > to:
                end, support = ends.pop(), sums.pop()
                below = ends[-1] if ends else 0
                yield from give(max(below, to), end, support, min(split, DEALT - 1))
                if below < to:
                    ends.append(to)
                    sums.append(support)
                elif ends:
                    sums[-1] += support

        def out() -> pa.RecordBatch:
            nonlocal cells
            edges = np.cumsum([0, *map(len, grams)], dtype=np.int32)
            values = np.concatenate(grams) if grams else np.empty(0, np.int32)
            made = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges), pa.array(values, pa.int32())), pa.array(supports, pa.int64())], ["gram", "support"])
            grams.clear()
            supports.clear()
            cells = 0
            return made

        for batch in batches:
            lists = batch.column(0)
            values, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, count in enumerate(batch.column(1).to_pylist()):
                suffix = values[edges[i] : edges[i + 1]]
                least = min(len(last), len(suffix))
                differ = last[:least] != suffix[:least]
                shared = int(differ.argmax()) if differ.any() else least
                yield from pop(shared, of_first or 0)
                of_first = len(suffix) if of_first is None else min(of_first, shared)
                if len(suffix) > shared:
                    ends.append(len(suffix))
                    sums.append(count)
                else:
                    sums[-1] += count
                last = suffix
        yield from pop(0, DEALT)
        yield out()

    parts = dealt.select("suffix", "count").mapInArrow(run, "gram array<int>, support long")
    return parts.groupBy("gram").agg(F.sum("support").alias("support")).where(F.col("support") >= min_support)
