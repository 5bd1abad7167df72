"""N-gram statistics by any of the four methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import block_levels
from ..operators.apriori_index import apriori_index_ngrams
from ..operators.apriori_scan import apriori_scan_ngrams
from ..operators.block_levels import mine_levels, put_out
from ..operators.block_spans import mine_spans
from ..operators.blocks import block_counts, block_ngrams, decode_blocks, encoded_blocks, list_blocks, word_blocks
from ..operators.closure import restrict
from ..operators.decode import decode
from ..operators.dictionary import build_dictionary, tokens, word_counts
from ..operators.encode import explode_lines, frequent_tokens, frequent_words
from ..operators.naive import naive_ngrams
from ..operators.suffix import LONG, suffix_ngrams
from ..sources.store import Levels, release
from ..types import NGramType, Params

_METHODS = {"suffix": suffix_ngrams, "naive": naive_ngrams, "apriori_scan": apriori_scan_ngrams, "apriori_index": apriori_index_ngrams}


def mine(frequent: DataFrame, params: Params) -> DataFrame:
    """``gram, n, support`` from the frequent tokens of an encoded collection."""
    grams = _METHODS[params.method](frequent, params.min_support, params.max_length)
    grams = restrict(grams, params.kind)
    return grams.select("gram", F.size("gram").alias("n"), "support")


def encode_in_blocks(lines: DataFrame, min_support: int, levels: Levels, empty_token: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Blocks of the ids of frequent words, and the dictionary of these words; both are written to ``levels``."""
    blocks = levels.keep(word_blocks(lines, empty_token), "words")
    frequent = levels.keep(build_dictionary(block_counts(blocks).where(F.col("count") >= min_support)), "frequent")
    return _encoded(blocks, frequent, frequent, levels), frequent


def _encoded(blocks: DataFrame, dictionary: DataFrame, counts: DataFrame, levels: Levels) -> DataFrame:
    """Encoded blocks, written to ``levels``; of many tokens, so that joins leave them where they are."""
    large = (counts.agg(F.sum("count")).first()[0] or 0) > block_levels.SMALL
    if large:
        release(levels.spark)
    encoded = levels.settle(encoded_blocks(blocks, dictionary), "encoded", key="block" if large else None)
    levels.drop("words")
    return encoded


def ngram_statistics_lines(lines: DataFrame, dictionary: DataFrame, params: Params) -> DataFrame:
    """:func:`ngram_statistics_encoded` from lines (``doc_id, line_no, tids``); the suffix method holds them as blocks."""
    if params.method != "suffix" or params.max_length > LONG:
        return ngram_statistics_encoded(explode_lines(lines), dictionary, params.min_support, params.max_length, params.kind, params.method)
    levels = Levels(lines.sparkSession, "blocks")
    blocks = levels.keep(list_blocks(lines.where(F.size("tids") > 0).select(F.col("tids").cast("array<string>").alias("words"))), "words")
    counts = dictionary.where(F.col("count") >= params.min_support)
    encoded = _encoded(blocks, counts.select(F.col("tid").cast("string").alias("word"), "tid"), counts, levels)
    return _mined(encoded, params, levels, decoded=False)


def _mined(encoded: DataFrame, params: Params, levels: Levels, decoded: bool) -> DataFrame:
    """N-grams of blocks, up to ``LONG`` terms or without a limit."""
    if params.max_length:
        made = mine_levels(encoded, params.min_support, params.max_length, params.kind, levels)
    else:
        made = mine_spans(encoded, params.min_support, params.kind, levels)
    found = put_out(encoded, made, params.kind, levels, decoded, rectangles=not params.max_length and params.kind is NGramType.ALL)
    return found if decoded else found.select("gram", F.size("gram").alias("n"), "support")


def ngram_statistics(
    lines: DataFrame,
    min_support: int,
    max_length: int,
    kind: NGramType | int = NGramType.ALL,
    method: str = "suffix",
    empty_token: str = "drop",
    decoded: bool = True,
) -> DataFrame:
    """N-grams of ``lines (doc_id, line_no, line)`` with their collection frequency.

    Every n-gram up to ``max_length`` terms (0: unlimited) that occurs ``min_support``
    times or more; CLOSED and MAXIMAL are relative to that set. Returns ``ngram, n,
    support``, or ``gram, n, support`` with term ids if not ``decoded``.
    """
    params = Params(min_support, max_length, kind, method)
    if method == "suffix":
        levels = Levels(lines.sparkSession, "blocks")
        encoded, frequent = encode_in_blocks(lines, min_support, levels, empty_token)
        if max_length <= LONG:
            return _mined(encoded, params, levels, decoded)
        grams = restrict(block_ngrams(encoded, frequent, min_support, max_length, levels), params.kind)
        return decode_blocks(grams, frequent, levels) if decoded else grams.select("gram", F.size("gram").alias("n"), "support")
    words = tokens(lines, empty_token)
    # Infrequent words can be in no result: they never get an id.
    frequent = build_dictionary(word_counts(words).where(F.col("count") >= min_support))
    grams = mine(frequent_words(words, frequent, min_support), params)
    return decode(grams, frequent) if decoded else grams


def ngram_statistics_encoded(
    encoded: DataFrame, dictionary: DataFrame, min_support: int, max_length: int, kind: NGramType | int = NGramType.ALL, method: str = "suffix"
) -> DataFrame:
    """``gram, n, support`` of a stored collection (``doc_id, line_no, pos, tid``) and its dictionary."""
    params = Params(min_support, max_length, kind, method)
    return mine(frequent_tokens(encoded, dictionary, min_support), params)
