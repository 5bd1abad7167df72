"""Corpus-wide line deduplication over levelled sorted runs (DataFrame functions only).

A run is a table of line hashes, bucketed and sorted by hash, with the number of
documents that hold the line and the largest of their identifiers. Documents come
in batches. A batch's lines are merge-anti-joined against every run: unseen hashes
become the batch's own run, so that a hash is in one run only; seen ones go to a
(much smaller) table of repeats. After ``fanout`` runs of a level, they are
compacted into one run of the next level. Runs and batches share a bucketing, so
that the runs are never shuffled for a join.

Lines held by more than ``max(hot_docs, pairs / 10_000)`` documents are hot; there
are fewer than 10,000 of them at any size, and they are broadcast. All others are
joined by shuffled hashes.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

SPACE = " \t\n\x0b\x0c\r"
HOT_LINES = 10_000


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def candidate_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text_hash, pos, hash`` of each line whose key is long enough; docs: ``doc_id, text``."""
    lines = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    stripped = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.char_length("line") >= min_chars)
    return stripped.select("doc_id", "text_hash", "pos", F.unhex(F.md5(line_key(F.col("line")))).alias("hash"))


class LevelledRuns:
    """Runs of line hashes by level, and the repeats that batches found in them."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.repeats: list[DataFrame] = []

    def _write_run(self, run: DataFrame) -> str:
        name = f"termloom_run_{uuid.uuid4().hex}"
        (
            run.repartition(self.buckets, "hash")
            .write.bucketBy(self.buckets, "hash")
            .sortBy("hash")
            .option("path", f"{self.scratch.path}/{name}")
            .option("compression", "snappy")
            .format("parquet")
            .saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Take in ``hash, docs, max_doc`` of a batch whose documents are in no other batch."""
        batch = self.scratch.write(batch.repartition(self.buckets, "hash"), f"batch-{uuid.uuid4().hex}")
        fresh = batch
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), "hash", "left_anti")
        own = self._write_run(fresh)
        if any(self.levels):
            seen = batch.join(self.spark.table(own).hint("merge"), "hash", "left_anti")
            self.repeats.append(self.scratch.write(seen, f"repeats-{uuid.uuid4().hex}"))
        self.levels[0].append(own)
        self._compact()

    def _compact(self) -> None:
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                merged = self.spark.table(self.levels[i][0])
                for name in self.levels[i][1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self.levels[i + 1].append(self._write_run(merged))
                for name in self.levels[i]:
                    self.spark.sql(f"DROP TABLE {name}")
                    self.scratch.drop(name)
                self.levels[i] = []

    def close(self) -> None:
        """Drop the tables, when totals are no longer needed."""
        for name in (name for level in self.levels for name in level):
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.drop(name)
        self.levels, self.repeats = [[]], []

    def totals(self) -> DataFrame:
        """``hash, docs, max_doc`` over all batches."""
        tables = self.runs() + self.repeats
        found = tables[0]
        for t in tables[1:]:
            found = found.unionByName(t)
        return found.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("max_doc").alias("max_doc"))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 6,
    fanout: int = 3,
    hot_docs: int = 1_000,
) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_text``.

    Lines whose key has ``min_chars`` code points or more and is found in
    ``min_docs`` documents or more are dropped from all but the largest document
    that holds the key (there, all its lines stay).

    Null and empty texts are one empty line. Rows that repeat an identifier are one
    document for the counts; each gets its own result row. A null identifier counts
    as one document that ranks below every other. An empty table gives an empty
    result. Other columns of the input are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scratch = Scratch(spark, "line-dedup")
    lines = scratch.write(
        candidate_lines(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).sortWithinPartitions("batch"), "lines"
    )
    state = LevelledRuns(spark, fanout)
    for b in range(batches):
        holders = lines.where(F.col("batch") == b).select("hash", "doc_id").distinct()
        state.add(holders.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("max_doc")))
    frequent = scratch.write(state.totals().where(F.col("docs") >= min_docs), "frequent")
    state.close()

    hot_from = max(hot_docs, lines.count() // HOT_LINES)
    doomed = F.col("doc_id").isNull() | (F.col("doc_id") != F.col("max_doc"))
    hot = frequent.where(F.col("docs") > hot_from).select("hash", F.col("max_doc").alias("hot_max"))
    tagged = lines.join(F.broadcast(hot), "hash", "left")
    hot_drops = tagged.where("hot_max IS NOT NULL").where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("hot_max")))
    cold = frequent.where(F.col("docs") <= hot_from).select("hash", "max_doc")
    cold_drops = tagged.where("hot_max IS NULL").join(cold, "hash").where(doomed)
    columns = ["doc_id", "text_hash", "pos"]
    drops = (
        hot_drops.select(*columns)
        .unionByName(cold_drops.select(*columns))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.col("pos").cast("long")).alias("dropped"))
    )
    drops = scratch.write(drops, "drops").select(F.col("doc_id").alias("drop_id"), "text_hash", "dropped")
    joined = docs.withColumn("th", F.xxhash64("text")).join(
        drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("th") == F.col("text_hash")), "left"
    )
    split = F.split("text", "\n", -1)
    every = F.sequence(F.lit(0).cast("long"), F.size(split).cast("long") - 1)
    # array_except on bigint is a hash lookup: linear in the number of lines.
    kept = F.transform(F.array_except(every, F.col("dropped")), lambda p: F.get(split, p.cast("int")))
    return joined.select(
        "doc_id",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
