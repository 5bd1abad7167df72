import random
from collections import Counter

import numpy as np
import pytest

from termloom import NGramType, ngram_statistics
from termloom.operators import blocks
from termloom.plans.api import encode_in_blocks
from termloom.sources.store import Levels

from .test_ngrams import brute, lines


def test_packed_numbers_come_back():
    for a in ([], [0], [0, 1, 255, 256, 2**40], list(range(1000))):
        assert blocks.unpack(blocks.pack(np.array(a, np.int64))).tolist() == a


@pytest.mark.parametrize("length", [2, 4, 10, 0])
def test_many_small_blocks_give_every_ngram(spark, monkeypatch, length):
    rng = random.Random(length)
    copied = " ".join(rng.choices("abcdefgh", k=30))
    texts = [" ".join(rng.choices("abcdefgh", [9, 7, 5, 3, 2, 1, 1, 1], k=rng.randint(0, 14))) for _ in range(60)] + [copied] * 4 + ["z " + copied]
    for name, value in (("BLOCK", 17), ("COUNTED", 40), ("DECODED", 9), ("CELLS", 50)):
        monkeypatch.setattr(blocks, name, value)
    for kind in NGramType:
        rows = ngram_statistics(lines(spark, texts), 3, length, kind).collect()
        assert {tuple(r["ngram"].split(" ")): r["support"] for r in rows} == brute(texts, 3, length, kind)
        assert len({r["ngram"] for r in rows}) == len(rows) and all(r["n"] == len(r["ngram"].split(" ")) for r in rows)


def test_suffixes_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 11)
    texts = ["a b c a b", "x a b c", "", "a b once c a", "a b c a b"]
    levels = Levels(spark, "test")
    encoded, words = encode_in_blocks(lines(spark, texts), 2, levels)
    name = {r["tid"]: r["word"] for r in words.collect()}
    got = {" ".join(name[t] for t in r["suffix"]): r["count"] for r in blocks.all_suffixes(encoded, 3).collect()}
    want = Counter()
    for run in ("a b c a b", "a b c", "a b", "c a", "a b c a b"):
        w = run.split()
        want.update(" ".join(w[i : i + 3]) for i in range(len(w)))
    assert got == want
