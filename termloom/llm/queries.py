"""Thin queries of the training-data operators over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .language_model import score_texts
from .line_dedup import line_dedup
from .mixing import label_domains, mix
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import pack
from .quality import score_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


#: Wanted shares of tokens by domain.
TARGETS = {"clean": 0.96, "toxic": 0.02, "low": 0.02}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = label_domains(_table(spark, sf_dir, "labels"))
    found = mix(_table(spark, sf_dir, "documents"), known, TARGETS)
    shares = [F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(sorted(TARGETS))]
    return found.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_chat_format, op3_mixing, op4_quality, op5_neighbours, op6_language_model, op7_exact_dedup, op8_line_dedup, op9_near_dedup, op10_html_text)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": r"""
            WITH d AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
            )
            SELECT doc_id,
                   min(doc_id) OVER g AS keep_id,
                   count(*) OVER g AS group_size,
                   doc_id = min(doc_id) OVER g AS kept,
                   sha256(norm) AS text_sha256
            FROM d WINDOW g AS (PARTITION BY norm)
        """,
        "op8_line_dedup": r"""
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
            lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
            keyed AS (
                SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                FROM lines
            ),
            frequent AS (
                SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 40
                GROUP BY key HAVING count(DISTINCT doc_id) >= 5
            ),
            marked AS (
                SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.max_doc AS dropped
                FROM keyed k LEFT JOIN frequent f ON k.key = f.key
            )
            SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
            FROM marked GROUP BY doc_id
        """,
    }
