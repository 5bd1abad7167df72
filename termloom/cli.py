"""Command line: convert text, compute n-grams, decode results.

    python -m termloom.cli convert TEXT COLLECTION
    python -m termloom.cli compute COLLECTION RESULT MIN_SUPPORT MAX_LENGTH [--type 0|1|2] [--method suffix]
    python -m termloom.cli decode RESULT COLLECTION STATISTICS
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.blocks import block_counts, decode_blocks, decoded_lines, word_blocks
from .operators.dictionary import build_dictionary
from .plans.api import ngram_statistics_lines
from .sources import store
from .sources.lines import lines_from_files
from .types import EMPTY_TOKENS, METHODS, Params


def convert(spark: SparkSession, text: str, collection: str, empty_token: str = "drop") -> None:
    """Text files to a dictionary and encoded lines below ``collection``."""
    levels = store.Levels(spark, "convert")
    blocks = levels.keep(word_blocks(lines_from_files(spark, text), empty_token, ids=True), "words")
    store.write_dictionary(build_dictionary(block_counts(blocks)), f"{collection}/dic")
    store.write_encoded(decoded_lines(blocks, store.read_dictionary(spark, f"{collection}/dic")), f"{collection}/seq")
    levels.drop("words")
    store.release(spark)


def compute(spark: SparkSession, collection: str, result: str, params: Params) -> None:
    """N-grams of a collection, as term ids."""
    dictionary = store.read_dictionary(spark, f"{collection}/dic")
    store.write_ngrams(ngram_statistics_lines(store.read_encoded(spark, f"{collection}/seq"), dictionary, params), result)
    store.release(spark)


def decode_result(spark: SparkSession, result: str, collection: str, statistics: str) -> None:
    """N-grams as text."""
    levels = store.Levels(spark, "decode")
    store.write_text(decode_blocks(store.read_ngrams(spark, result), store.read_dictionary(spark, f"{collection}/dic"), levels), statistics)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="termloom", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert")
    c.add_argument("text")
    c.add_argument("collection")
    c.add_argument("--empty-token", choices=EMPTY_TOKENS, default="drop")
    c = commands.add_parser("compute")
    c.add_argument("collection")
    c.add_argument("result")
    c.add_argument("min_support", type=int)
    c.add_argument("max_length", type=int)
    c.add_argument("--type", type=int, choices=(0, 1, 2), default=0)
    c.add_argument("--method", choices=METHODS, default="suffix")
    c = commands.add_parser("decode")
    c.add_argument("result")
    c.add_argument("collection")
    c.add_argument("statistics")
    a = parser.parse_args(args)
    params = Params(a.min_support, a.max_length, a.type, a.method) if a.command == "compute" else None
    spark = SparkSession.builder.appName("termloom").getOrCreate()
    if a.command == "convert":
        convert(spark, a.text, a.collection, a.empty_token)
    elif a.command == "compute":
        compute(spark, a.collection, a.result, params)
    else:
        decode_result(spark, a.result, a.collection, a.statistics)


if __name__ == "__main__":
    main()
