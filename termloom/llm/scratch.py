"""Intermediate tables that outlive executors.

Lineage is cut by writing Parquet below the shared folder that the cluster
names in ``spark.checkpoint.dir``; a machine-local folder is chosen only when
that setting is absent (single-machine tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="termloom-")
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Lower the session's Arrow batches to ``rows`` rows, if they are larger.

    Batches are held by the JVM, off its heap, and by the Python worker at once; with
    whole texts as rows, the default of 10,000 takes hundreds of MB in every executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


class Scratch:
    """A folder of intermediate Parquet tables for one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"
        path, files = self._files(self.path)
        files.mkdirs(path)
        files.deleteOnExit(path)  # results are lazy: their tables must last as long as the application

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, table: str, codec: str = "snappy") -> DataFrame:
        """Write ``df`` once and return the table read back (no recomputation later)."""
        at = f"{self.path}/{table}"
        df.write.mode("overwrite").option("compression", codec).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, table: str) -> None:
        """Delete a table that no later action reads."""
        path, files = self._files(f"{self.path}/{table}")
        files.delete(path, True)
