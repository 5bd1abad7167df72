"""Level-wise joins of a positional index.

The index is kept unnested, ``gram, doc_id, line_no, pos``: joining posting lists is
then an equi-join on the position, which no frequent gram can make lopsided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Levels
from .apriori_scan import _union
from .encode import LINE

SCANNED = 4  # levels built from the tokens; longer ones by joins


def positions(frequent: DataFrame, k: int) -> DataFrame:
    """``gram, doc_id, line_no, pos`` of every window of ``k`` adjacent tokens."""
    by_line = Window.partitionBy(*LINE).orderBy("pos").rowsBetween(0, k - 1)
    ahead = frequent.select(*LINE, "pos", F.collect_list(F.struct("pos", "tid")).over(by_line).alias("ahead"))
    whole = (F.size("ahead") == k) & (F.element_at("ahead", -1)["pos"] == F.col("pos") + (k - 1))
    return ahead.where(whole).select(F.transform("ahead", lambda x: x["tid"]).alias("gram"), *LINE, "pos")


def support(index: DataFrame) -> DataFrame:
    """``gram, support`` of an unnested index."""
    return index.groupBy("gram").agg(F.count(F.lit(1)).alias("support"))


def keep_frequent(index: DataFrame, min_support: int) -> tuple[DataFrame, DataFrame]:
    """The index of grams with enough support, and their supports."""
    counts = support(index).where(F.col("support") >= min_support)
    return index.join(counts.select("gram"), "gram", "left_semi"), counts


def join_positions(index: DataFrame) -> DataFrame:
    """Windows one longer: a gram at ``pos`` and one at ``pos + 1`` overlap in all but their ends."""
    right = index.select(*LINE, (F.col("pos") - 1).alias("pos"), F.element_at("gram", -1).alias("last"))
    return index.join(right, [*LINE, "pos"]).select(F.concat("gram", F.array("last")).alias("gram"), *LINE, "pos")


def posting_lists(index: DataFrame) -> DataFrame:
    """``gram, postings, support``: nested lists, ascending by document and line (for export)."""
    lists = index.groupBy("gram", *LINE).agg(F.array_sort(F.collect_list("pos")).alias("offsets"))
    return lists.groupBy("gram").agg(
        F.array_sort(F.collect_list(F.struct(*LINE, "offsets"))).alias("postings"), F.sum(F.size("offsets")).cast("long").alias("support")
    )


def unnest(postings: DataFrame) -> DataFrame:
    """The inverse of :func:`posting_lists`."""
    rows = postings.select("gram", F.explode("postings").alias("p"))
    return rows.select("gram", "p.doc_id", "p.line_no", F.explode("p.offsets").alias("pos"))


def apriori_index_ngrams(frequent: DataFrame, min_support: int, max_length: int) -> DataFrame:
    """``gram, support``."""
    levels = Levels(frequent.sparkSession, "apriori-index")
    tokens = levels.keep(frequent, "tokens")
    found: list[DataFrame] = []
    index, k = None, 1
    while not max_length or k <= max_length:
        joins_follow = k >= SCANNED and (not max_length or k < max_length)
        candidates = positions(tokens, k) if k <= SCANNED else join_positions(index)
        if joins_follow:  # positions are needed again; of other levels only the supports are
            candidates = levels.keep(candidates, f"candidates-{k}")
        counts = levels.keep(support(candidates).where(F.col("support") >= min_support), f"level-{k}")
        if not counts.limit(1).count():
            break
        found.append(counts)
        if joins_follow:
            kept = levels.keep(candidates.join(counts.select("gram"), "gram", "left_semi"), f"index-{k}")
            if index is not None:
                levels.drop(f"index-{k - 1}")
            levels.drop(f"candidates-{k}")
            index = kept
        k += 1
    return _union(found, frequent)
