import random
import zlib

import numpy as np

from termloom.llm.quality import CHUNK, ByteNet, cut, keep_quality, score_quality

from .conftest import LONG


def corpus(n=260):
    rng = random.Random(4)
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 300))]
        bad = rng.random() < 0.4
        texts.append(" ".join(w + "!!" for w in words).upper() if bad else " ".join(words) + ".")
        labels.append(int(not bad))
    return texts, labels


def test_held_out_accuracy_and_cases(spark, docs_of):
    texts, labels = corpus()
    odd = ["", None, LONG, "é" * 2_000, texts[0]]
    df = docs_of([*texts, *odd], [*range(len(texts) + 4), 0])
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (7, None)], "doc_id long, quality int")
    out = score_quality(df, known).collect()
    assert len(out) == len(texts) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < len(texts)]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.9
    kept = keep_quality(df.withColumnRenamed("kept", "a b.c"), known).withColumnRenamed("a b.c", "kept")
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in out)


def test_labels_of_the_held_fold_are_not_learned(spark, docs_of):
    texts, labels = corpus(120)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    df = docs_of(texts)
    scores = []
    for flip in (False, True):
        y = [1 - v if flip and i in held else v for i, v in enumerate(labels)]
        known = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
        scores.append({r["doc_id"]: r["score"] for r in score_quality(df, known).collect()})
    assert scores[0] == scores[1]


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in score_quality(docs_of(["a", None]), none).collect()] == [0.5, 0.5]
    assert score_quality(docs_of([]), none).collect() == []


def test_chunks_cover_the_text_and_gradients_are_right():
    for n in (0, 1, 511, 512, 513, 900, 5_000):
        text = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        chunks = cut(text)
        assert chunks.shape[1] == CHUNK
        step = 384
        whole = b"".join(bytes(c[:step]) for c in chunks[:-1]) + bytes(chunks[-1])
        assert whole[:n] == text and not any(whole[n:])
    rng = np.random.default_rng(1)
    net = ByteNet.untrained(rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    chunks, doc = rng.integers(1, 255, (3, CHUNK), dtype=np.uint8), np.array([0, 2])
    y, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = net.combine(net.pool(chunks)[0], doc)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = net.gradients(chunks, doc, y, weight)
    for name in ("w1", "b", "v", "o", "d", "c"):
        at = tuple(rng.integers(0, s) for s in net.w[name].shape)
        before = net.w[name][at]
        net.w[name][at] = before + 1e-6
        up = loss()
        net.w[name][at] = before - 1e-6
        down = loss()
        net.w[name][at] = before
        assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-4 + 1e-2 * abs(grads[name][at]), name


def test_score_does_not_depend_on_the_batch():
    net = ByteNet.untrained(np.random.default_rng(2))
    texts = [b"", b"abc", b"x y " * 4_000, "ü".encode() * 700]
    together = net.score(texts)
    assert np.allclose(together, [net.score([t])[0] for t in texts], atol=1e-6)
    assert np.allclose(together, net.score(texts, budget=3), atol=1e-6)


def test_network_by_plain_loops():
    """Every layer, computed chunk by chunk and place by place."""
    from termloom.llm.quality import CHUNK, FILTERS, HIDDEN, STEP, WIDE, ByteNet, cut

    net = ByteNet.untrained(np.random.default_rng(5))
    w = net.w
    texts = [b"", b"short text", bytes(np.random.default_rng(6).integers(1, 256, 1_500, dtype=np.uint8))]
    got = net.score(texts, budget=2)
    for text, score in zip(texts, got, strict=True):
        hidden = []
        for chunk in cut(text):
            vectors = [w["e"][b] for b in chunk]
            responses = []
            for at in range(0, CHUNK - STEP, STEP):
                first, second = np.concatenate(vectors[at : at + STEP]), np.concatenate(vectors[at + STEP : at + 2 * STEP])
                assert len(first) == WIDE
                responses.append([max(0.0, first @ w["w1"][:, f] + second @ w["w2"][:, f] + w["b"][f]) for f in range(FILTERS)])
            used = sum(b != 0 for b in chunk)
            pooled = [*np.max(responses, 0), *(np.sum(responses, 0) / max(1, used / STEP)), used / CHUNK]
            hidden.append([np.tanh(sum(p * v for p, v in zip(pooled, w["v"][:, h], strict=True)) + w["c"][h]) for h in range(HIDDEN)])
        both = [*np.mean(hidden, 0), *np.max(hidden, 0)]
        assert abs(1 / (1 + np.exp(-(np.dot(both, w["o"][:, 0]) + w["d"][0]))) - score) < 1e-4
