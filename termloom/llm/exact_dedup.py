"""Exact deduplication by content sort (DataFrame functions only).

Sampled splitters range-partition the normalised bytes, the external sort of
each partition places equal texts next to one another, and neighbouring full
comparisons form the groups; of each group the smallest identifier stays.

Splitters are a bounded prefix of the text, a 64-bit hash of the whole text and
a part number, so that what the driver samples does not grow with the length of
the texts. The part number is 0 except for hot texts, those with more copies
than ``max(hot_rows, rows / 10_000)``; their copies are dealt over several
parts, hence over several sort partitions. By that definition there are fewer
than 10,000 hot texts, whatever the size of the input. Their totals come from a
pre-aggregated count (map-side combine), which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_TEXTS = 10_000
PREFIX = 48


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_rows: int = 1_000,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``carry`` returns the input's columns, unchanged and in a struct ``row``,
    beside the decision, so that no join is needed to apply it.

    Null texts count as empty; all empty texts are one group. Repeated rows with
    one identifier are copies of one another: exactly one of them is kept. A null
    identifier ranks after every other; if all identifiers of a group are null,
    one of its rows is kept and ``keep_id`` is null. An empty table gives an empty
    result. Other columns of the input are not read unless carried, so their names
    cannot clash.
    """
    spark = docs.sparkSession
    # What travels: the text, or the whole row (which has it).
    load = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.col(text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), load.alias("load"))
    norm = normalised(F.col("load").getField(text_col) if carry else F.col("load"))

    threshold = max(hot_rows, src.count() // HOT_TEXTS)
    hot = src.groupBy(F.xxhash64(norm).alias("h")).count().where(F.col("count") > threshold).collect()

    keyed = src.withColumn("norm", norm).select("doc_id", "load", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("h"))
    if hot:
        parts = spark.createDataFrame([(r["h"], -(-r["count"] // threshold)) for r in hot], "h long, parts int")
        keyed = keyed.join(F.broadcast(parts), "h", "left").withColumn(
            "part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int")
        )
    # The window is partitioned by these and the text, so it needs no exchange of its own.
    keys = ["prefix", "h", *(["part"] if hot else [])]
    dealt = keyed.repartitionByRange(*keys).withColumn("norm", norm)
    dealt = dealt.withColumnRenamed("load", "row") if carry else dealt.drop("load")
    group = Window.partitionBy(*keys, "norm")
    ordered = group.orderBy(F.col("doc_id").asc_nulls_last())
    found = dealt.select(
        *[c for c in ("doc_id", "row", "h", "parts") if c in dealt.columns],
        F.first("doc_id").over(ordered).alias("keep_id"),
        F.row_number().over(ordered).alias("rank"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
    )
    if hot:
        # Whole-group totals of the hot texts, keyed by the digest of the full text.
        totals = (
            src.select("doc_id", norm.alias("norm"))
            .join(F.broadcast(parts.select("h")), F.xxhash64("norm") == F.col("h"), "left_semi")
            .groupBy(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
            .agg(F.min("doc_id").alias("all_min"), F.count(F.lit(1)).alias("all_rows"))
        )
        found = found.join(F.broadcast(totals), "text_sha256", "left").select(
            *[c for c in ("doc_id", "row") if c in found.columns],
            F.when(F.col("all_rows").isNull(), F.col("keep_id")).otherwise(F.col("all_min")).alias("keep_id"),
            "rank",
            F.coalesce("all_rows", "group_size").alias("group_size"),
            "text_sha256",
        )
    return found.select(
        "doc_id",
        *(["row"] if carry else []),
        "keep_id",
        "group_size",
        ((F.col("rank") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, with the input's columns."""
    return exact_dedup(docs, id_col, text_col, carry=True).where("kept").select("row.*")
