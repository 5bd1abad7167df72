"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _state(links: DataFrame) -> tuple:
    """Tells sets of links apart: their number, and two sums of their hashes."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, label`` of every node of ``links (a, b)``; the label is the component's smallest node.

    Each step is a pre-aggregated minimum by node and a join; links are never gathered.
    Steps end when no link changes, after a number that is logarithmic in practice.
    """
    links = scratch.write(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    step, state = 0, _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each larger neighbour links to the smallest node around.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself link to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        step += 1
        new = scratch.write(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        before, links, state = state, new, _state(new)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
