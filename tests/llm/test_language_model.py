import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from termloom.llm.language_model import CLASSES, RARE, TOP, UNITS, LogBilinear, Text, Unigram, log_probability, score_texts, token_scores, without_empty, word_shares

from .conftest import LONG


def corpus(n=400):
    rng = random.Random(6)
    vocabulary = {lang: [f"{lang}{i}{end}" for i, end in enumerate(["ing", "ed", "er", "ly"] * 30)] for lang in "ab"}
    return [" ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(3, 60))) for lang in rng.choices("ab", k=n)]


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def test_base_counts_and_a_better_model(docs_of):
    texts = [*corpus(), "", None, LONG, "A\x0bB c É", "rare unseen words"]
    ids = [*range(len(texts) - 1), 3]
    out = score_texts(docs_of(texts, ids), block_tokens=3_000).collect()
    assert len(out) == len(texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    counts = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (i, h, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))
        for i, h, w in zip(ids, held, map(tokens, texts), strict=True)
    )
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n}
    new = [r for r in out if r["held_out"] and r["n_tokens"] > 3]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)
    assert all(r["score"] < 0 for r in out)


def test_null_ids_empty_table_and_no_training_rows(docs_of):
    assert score_texts(docs_of([])).collect() == []
    out = score_texts(docs_of(["a b", None], [None, None])).collect()
    assert sorted((r["n_tokens"], r["held_out"], r["train_tokens"]) for r in out) == [(1, False, 4), (3, False, 4)]
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = score_texts(docs_of(["a b"], [only])).collect()
    assert (row["held_out"], row["train_tokens"], row["n_known"], row["base_score"], row["score"]) == (True, 0, 0, 0.0, 0.0)


def log_probabilities(model, contexts):
    p = model.predict(contexts)
    logs = lambda s: s - np.log(np.exp(s).sum(1, keepdims=True))
    classes = logs(model.class_scores(p))
    with np.errstate(all="ignore"):
        units = [logs(model.unit_scores(p, k)) + classes[:, k : k + 1] for k in range(CLASSES)]
    return np.nan_to_num(np.concatenate(units, 1), nan=-np.inf)


def test_training_helps_and_batches_agree_with_single_contexts():
    rng = np.random.default_rng(8)
    units = np.tile(np.array([1, 200, 3, 4_000], np.uint16), 20_000)
    units[::9] = rng.integers(1, 9, len(units[::9]))
    sizes = np.full(len(units) // 100, 100)
    mass = np.bincount(units, minlength=UNITS).astype(float)
    unigram = Unigram(mass)
    model = LogBilinear.untrained(unigram)
    before = token_scores(model, units, sizes).mean()
    model.train(Text(units, sizes), rng.permutation(len(units)), unigram, rng)
    assert token_scores(model, units, sizes).mean() > before + 0.2
    direct = log_probabilities(model, Text(units, sizes).contexts(np.arange(500)))[np.arange(500), units[:500]] / np.log(10)
    assert np.allclose(direct, token_scores(model, units, sizes)[:500], atol=1e-4)


def test_probabilities_of_all_words_and_one_unknown_sum_to_one():
    rng = np.random.default_rng(2)
    # The end, 500 words of their own, words of three suffix units, 40 words seen once, one unknown.
    unit = np.concatenate([[0], 1 + np.arange(500), TOP + 1 + rng.integers(0, 3, 60), np.full(41, RARE)])
    c = np.concatenate([[300], rng.integers(8, 99, 500), rng.integers(2, 9, 60), np.ones(40, int), [0]])
    mass = np.bincount(unit, c, UNITS)
    model = LogBilinear.untrained(Unigram(mass))
    stream = rng.choice(unit[:-1], 40_000, p=c[:-1] / c.sum()).astype(np.uint16)
    sizes = np.full(400, 100)
    model.train(Text(stream, sizes), rng.permutation(len(stream)), Unigram(mass), rng)
    units = log_probabilities(LogBilinear(without_empty(model.flat, mass)), list(rng.choice(unit, (3, 50))))
    words = units[:, unit] / np.log(10) + word_shares(c, unit, mass)
    assert (10.0**words).sum(1) == pytest.approx(np.ones(50), rel=1e-4)


def test_scores_do_not_depend_on_the_partitioning(docs_of):
    df = docs_of([*corpus(300), None, ""])
    parts = [{r["doc_id"]: r["score"] for r in score_texts(d, block_tokens=n, shard_tokens=2_000).collect()} for d, n in ((df.coalesce(1), 10_000), (df.repartition(7), 900))]
    assert parts[0].keys() == parts[1].keys()
    assert all(parts[0][i] == pytest.approx(parts[1][i], rel=1e-5) for i in parts[0])


def test_gradients_of_the_contrastive_loss():
    from termloom.llm.language_model import _contrast

    rng = np.random.default_rng(3)
    p, q, b = rng.standard_normal((7, 4)), rng.standard_normal((6, 4)), rng.standard_normal(6)
    own, starts, noise, share = np.sort(rng.integers(0, 6, 7)), np.array([0, 3]), np.array([[1, 1, 4], [0, 5, 2]]), np.log(rng.dirichlet(np.ones(6)))

    def loss():
        ours = (p * q[own]).sum(1) + b[own] - np.log(3) - share[own]
        others = [p[i:j] @ q[k].T + b[k] - np.log(3) - share[k] for i, j, k in ((0, 3, noise[0]), (3, 7, noise[1]))]
        return np.log1p(np.exp(-ours)).sum() + sum(np.log1p(np.exp(x)).sum() for x in others)

    dp, used, dq, db = _contrast(p, q, b, own, starts, noise, share.astype(np.float32))
    for value, grads in ((p, {(i, j): dp[i, j] for i in range(7) for j in range(4)}), (q, {(u, j): dq[k, j] for k, u in enumerate(used) for j in range(4)}), (b, {(u,): db[k] for k, u in enumerate(used)})):
        for at, want in grads.items():
            before = value[at]
            value[at] = before + 1e-5
            up = loss()
            value[at] = before - 1e-5
            down = loss()
            value[at] = before
            assert (up - down) / 2e-5 == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_log_probabilities_of_any_size():
    for scale in (1, 1e4):
        s = np.random.default_rng(4).standard_normal((5, 7)) * scale
        top = s - s.max(1, keepdims=True)
        want = (top - np.log(np.exp(top).sum(1, keepdims=True)))[np.arange(5), 2]
        assert np.allclose(log_probability(s.copy(), np.full(5, 2)), want)


def test_contexts_stop_at_document_starts():
    got = Text(np.array([5, 6, 7, 800, 9, 8, 7], np.uint16), np.array([3, 1, 0, 3])).contexts(np.arange(7))
    assert np.stack(got, 1).tolist() == [[0, 0, 0], [5, 0, 0], [6, 5, 0], [0, 0, 0], [0, 0, 0], [9, 0, 0], [8, 9, 0]]
