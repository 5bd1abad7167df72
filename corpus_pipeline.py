"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return
the columns of ``documents``. A stage works on everything that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm.exact_dedup import drop_exact_copies
from termloom.llm.mixing import label_domains, mixed_documents
from termloom.llm.near_dedup import drop_near_copies
from termloom.llm.packing import pack
from termloom.llm.quality import keep_quality
from termloom.llm.queries import TARGETS
from termloom.llm.scratch import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_quality(docs, _labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the domains ask."""
    return mixed_documents(docs, label_domains(_labels(spark, sf_dir)), TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learned classifier and a tokenizer have no SQL form.
ORACLE_SQL = None
