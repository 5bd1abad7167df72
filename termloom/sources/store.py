"""Tables of the engine on disk, and intermediate tables that survive lost executors."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import DICTIONARY, ENCODED, NGRAMS, TEXT_STATISTICS


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Tab-separated ``word, tid, count``."""
    dictionary.select("word", "tid", "count").write.mode("overwrite").csv(path, sep="\t", emptyValue="")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=DICTIONARY, sep="\t", quote="", emptyValue="", nullValue="\x00").withColumn("word", F.coalesce("word", F.lit("")))


def write_encoded(encoded: DataFrame, path: str) -> None:
    encoded.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """Encoded lines; the identifier keeps the type it was written with."""
    found = spark.read.parquet(path)
    if found.columns != ENCODED.names:
        raise ValueError(f"not an encoded collection: {found.columns}")
    return found


def write_ngrams(grams: DataFrame, path: str, by_length: bool = False) -> None:
    """One flat relation; ``by_length`` partitions it by ``n``."""
    writer = grams.write.mode("overwrite")
    (writer.partitionBy("n") if by_length else writer).parquet(path)


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*NGRAMS.names)


def write_index(postings: DataFrame, path: str) -> None:
    postings.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_text(statistics: DataFrame, path: str) -> None:
    """Tab-separated ``ngram, support``; never replaces an earlier result."""
    statistics.select("ngram", "support").write.mode("errorifexists").csv(path, sep="\t", emptyValue="")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=TEXT_STATISTICS, sep="\t", quote="", nullValue="\x00")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    A temporary one is used only where that is not set and all runs on one machine, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="termloom-")
    return found.rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries, which it does when the driver's garbage is collected."""
    for _ in range(2):  # what the first round finds lets go of the rest
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


class Levels:
    """Tables of an iteration, written to the shared folder so that lineage stays short."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"
        path, files = self._files(self.path)
        files.mkdirs(path)
        files.deleteOnExit(path)  # results are lazy: their tables must last as long as the application

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, table: str, by: str | None = None) -> DataFrame:
        """``by``: rows of each value of that column are a table by themselves, to be dropped alone."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{table}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}")

    def settle(self, df: DataFrame, table: str, by: str | None = None, key: str | None = None) -> DataFrame:
        """:meth:`keep`, after which the shuffle files behind ``df`` may go: Spark deletes them when the driver's garbage is collected.

        ``key``: the table lies in buckets of that column, so that joins by it need not send its rows.
        """
        kept = self._bucketed(df, table, by, key) if key else self.keep(df, table, by)
        release(self.spark)
        return kept

    def _bucketed(self, df: DataFrame, table: str, by: str | None, key: str) -> DataFrame:
        name = f"termloom_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", f"{self.path}/{table}")
        (writer.partitionBy(by) if by else writer).saveAsTable(name, format="parquet")
        return self.spark.table(name)

    def holds(self, table: str) -> bool:
        path, files = self._files(f"{self.path}/{table}")
        return files.exists(path)

    def drop(self, table: str) -> None:
        path, files = self._files(f"{self.path}/{table}")
        files.delete(path, True)
