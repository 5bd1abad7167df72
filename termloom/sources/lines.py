"""Lines of text: the scope that n-grams do not cross."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, where the table is a scan of fewer partitions than there are cores.

    A small file of one row group would otherwise be worked on by one task. Tables that
    are themselves computed, and scans of enough partitions, stay as they are.
    """
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def lines_from_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``doc_id, line_no, line`` of text files.

    A line's identity is the file and its place there, so files never collide: ``doc_id``
    is a hash of the path and the split, ``line_no`` the line's order in it.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("doc_id"),
        F.monotonically_increasing_id().alias("__order"),
    )
    # Within one task a split's lines come in order; the order's low bits number them.
    return raw.select("doc_id", F.col("__order").bitwiseAND((1 << 31) - 1).cast("int").alias("line_no"), "line")


def lines_from_table(df: DataFrame, id_cols: str | list[str] = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, line`` of a table; several identifier columns become a struct. Null texts have no lines."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    doc = F.col(ids[0]) if len(ids) == 1 else F.struct(*ids)
    rows = spread(df.where(F.col(text_col) != "").select(doc.alias("doc_id"), F.col(text_col).alias("text")))
    # A line ends with \n, \r\n or \r; the last one may do without.
    text = F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", "\r\n?", "\n")).otherwise(F.col("text"))
    whole = F.expr("if(endswith(text, '\n'), left(text, char_length(text) - 1), text)")
    found = rows.select("doc_id", text.alias("text")).select("doc_id", F.posexplode(F.split(whole, "\n")).alias("line_no", "line"))
    return found.select("doc_id", F.col("line_no").cast("int"), "line")
