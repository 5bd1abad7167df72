"""Normalisation and tokenisation of a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import EMPTY_TOKENS


KEPT = "[a-z0-9']"


def normalize(line: Column) -> Column:
    """Lower case; each character but a-z, 0-9 and the apostrophe becomes a space."""
    return F.regexp_replace(F.lower(line), "[^a-z0-9']", " ")


def tokenize(line: Column, empty_token: str = "drop") -> Column:
    """Words of a line.

    ``drop`` leaves out empty strings. ``reference`` keeps the one that a split at white
    space gives for a line that begins with a removed character, or that is blank; a
    line of removed characters alone has no words.
    """
    if empty_token not in EMPTY_TOKENS:
        raise ValueError(f"empty_token must be one of {', '.join(EMPTY_TOKENS)}")
    s = F.lower(line)
    # The words are the runs of kept characters: found in one pass, without the normalised line.
    words = F.regexp_extract_all(s, F.lit(f"{KEPT}+"), F.lit(0))
    if empty_token == "drop":
        return words
    begins_removed = F.rlike(s, F.lit(KEPT)) & ~F.rlike(s, F.lit(f"^{KEPT}"))
    return F.concat(F.when((s == "") | begins_removed, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), words)
