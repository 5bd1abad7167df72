import random
from collections import Counter

import pytest

from termloom import NGramType, ngram_statistics
from termloom.operators import block_levels, blocks
from termloom.plans.api import encode_in_blocks
from termloom.sources.store import Levels

from .test_ngrams import brute, lines


def _small(monkeypatch):
    for name, value in (("BLOCK", 60), ("COUNTED", 150), ("CELLS", 50)):
        monkeypatch.setattr(blocks, name, value)


@pytest.mark.parametrize("kind", list(NGramType))
def test_ngrams_by_levels(spark, monkeypatch, kind):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdef", [9, 7, 5, 3, 2, 1], k=rng.randint(0, 12))) for _ in range(40)]
    _small(monkeypatch)
    for support, length in ((2, 5), (4, 1)):
        rows = ngram_statistics(lines(spark, texts), support, length, kind).collect()
        assert len(rows) == len({r["ngram"] for r in rows})
        assert {tuple(r["ngram"].split(" ")): r["support"] for r in rows} == brute(texts, support, length, kind)


@pytest.mark.parametrize("support", [1, 3])
def test_suffixes_by_levels(spark, monkeypatch, support):
    rng = random.Random(support)
    texts = [" ".join(rng.choices("abcdefghijkl", [9, 7, 5, 3, 2, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 9))) for _ in range(40)] + ["once twice thrice"]
    _small(monkeypatch)
    levels = Levels(spark, "test")
    encoded, _ = encode_in_blocks(lines(spark, texts), support, levels)
    made = block_levels.mine_levels(encoded, support, 4, NGramType.ALL, levels, suffixes=True)
    rows = block_levels.put_out(encoded, made, NGramType.ALL, levels).collect()
    counts = Counter(w for t in texts for w in t.split())
    want = Counter()
    for t in texts:
        for run in " ".join(w if counts[w] >= support else "|" for w in t.split()).split("|"):
            w = run.split()
            want.update(" ".join(w[i : i + 4]) for i in range(len(w)))
    assert {r["ngram"]: r["support"] for r in rows} == want and len(rows) == len(want)
