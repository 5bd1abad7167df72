import random

import numpy as np
import pytest

from termloom import NGramType, ngram_statistics
from termloom.operators import block_levels, block_spans, blocks

from .test_ngrams import brute, lines


@pytest.mark.parametrize("finished", [0, 40, 1 << 21])
def test_unlimited_ngrams_by_rounds(spark, monkeypatch, finished):
    rng = random.Random(finished)
    monkeypatch.setattr(block_spans, "FINISHED", finished)
    for name, value in (("BLOCK", 60), ("COUNTED", 40), ("CELLS", 50)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(block_levels, "RECTANGLES", 7)
    copied = rng.choices("abcdefgh", k=18)
    near = [" ".join(w if rng.random() > 0.08 else "x" for w in copied) for _ in range(6)]
    texts = ["a b a b a b a", "a a a a a", *near, " ".join(copied), " ".join(copied[4:]), *(" ".join(rng.choices("abc", [6, 3, 1], k=rng.randint(0, 9))) for _ in range(25))]
    for support in (1, 4) if finished > 40 else (3,):
        for kind in NGramType:
            rows = ngram_statistics(lines(spark, texts), support, 0, kind).collect()
            assert {tuple(r["ngram"].split(" ")): r["support"] for r in rows} == brute(texts, support, 0, kind), (support, kind)
            assert len({r["ngram"] for r in rows}) == len(rows) and all(r["n"] == len(r["ngram"].split(" ")) for r in rows)


def test_rounds_do_not_follow_the_length(spark, monkeypatch):
    """Copies of a text with different ends, so long that a round for each length would not end."""
    text = " ".join(f"w{i}" for i in range(3000))
    texts = [f"{text} x"] * 3 + [f"{text} y"] * 3
    monkeypatch.setattr(block_spans, "FINISHED", 0)
    made, write = [], block_spans.Levels.keep
    monkeypatch.setattr(block_spans.Levels, "keep", lambda self, df, table, by=None: (made.append(table), write(self, df, table, by))[1])
    got = {r["n"]: r["support"] for r in ngram_statistics(lines(spark, texts), 3, 0, NGramType.CLOSED).select("n", "support").collect()}
    assert got == {3000: 6, 3001: 3} and sum(t.startswith("round-") for t in made) <= 4


@pytest.mark.parametrize("kind", list(NGramType))
def test_items_parted_into_tasks(spark, monkeypatch, kind):
    rng = random.Random(5)
    monkeypatch.setattr(block_spans, "FINISHED", 60)
    monkeypatch.setattr(block_spans, "PARTED", 2)
    monkeypatch.setattr(blocks, "BLOCK", 70)
    monkeypatch.setattr(blocks, "COUNTED", 40)
    texts = []
    for g in range(6):
        text = [f"w{g}{rng.randint(0, 5)}" for _ in range(8)]
        texts += [" ".join(w if rng.random() > 0.06 else "x" for w in text) for _ in range(5)]
    parted, real = [], block_spans._parted_items
    monkeypatch.setattr(block_spans, "_parted_items", lambda *a: parted.append(real(*a)) or parted[-1])
    rows = ngram_statistics(lines(spark, texts), 2, 0, kind).collect()
    assert {tuple(r["ngram"].split(" ")): r["support"] for r in rows} == brute(texts, 2, 0, kind) and len({r["ngram"] for r in rows}) == len(rows)
    assert parted and parted[-1] is not None


def test_rectangles():
    given = [np.array(x) for x in ([3, 10], [2, 1], [5, 6], [2, 1], [2, 3])]
    rows = [tuple(map(int, r)) for piece in block_levels._spread(*given, 4) for r in zip(*piece, strict=True)]
    assert sorted(rows) == [(3, 2, 5), (3, 3, 5), (4, 1, 5), (4, 2, 5), (10, 1, 6), (10, 2, 6), (10, 3, 6)]
