"""Document quality by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned
byte vectors pass learned filters (8 bytes wide, every 4 bytes); each filter's
responses are max-pooled, and averaged, over the chunk; a hidden layer reads the pooled
responses; the chunks' hidden vectors are averaged and max-pooled over the document
and give one probability.

Training uses a sample of labelled rows that ``per_class`` and ``max_chunks`` bound;
its rows are weighted back to the labels' own frequencies. Scoring reads every byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches

CHUNK, HOP, STEP, DIM, FILTERS, HIDDEN = 512, 384, 4, 8, 32, 16
WIDE = STEP * DIM
PLACES = CHUNK // STEP - 1


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of ``n`` bytes begin; together they cover all bytes. One chunk if there are none."""
    return np.arange(0, max(1, n - (CHUNK - HOP)), HOP) if n > CHUNK else np.zeros(1, np.int64)


def cut(text: bytes) -> np.ndarray:
    """Chunks (rows of CHUNK bytes, zero-padded)."""
    starts = chunk_starts(len(text))
    padded = np.zeros(int(starts[-1]) + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[starts]


class ByteNet:
    """Weights: byte vectors ``e``, filters ``w1 w2 b``, hidden ``v c``, output ``o d``."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def untrained(cls, rng: np.random.Generator) -> ByteNet:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        e = draw(256, DIM, scale=0.5)
        e[0] = 0
        pooled = 2 * FILTERS + 1
        return cls(
            {
                "e": e,
                "w1": draw(WIDE, FILTERS, scale=0.25),
                "w2": draw(WIDE, FILTERS, scale=0.25),
                "b": np.zeros(FILTERS, np.float32),
                "v": draw(pooled, HIDDEN, scale=pooled**-0.5),
                "c": np.zeros(HIDDEN, np.float32),
                "o": draw(2 * HIDDEN, 1, scale=0.3),
                "d": np.zeros(1, np.float32),
            }
        )

    def pool(self, chunks: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Pooled filter responses of each chunk."""
        w, n = self.w, len(chunks)
        m = w["e"][chunks].reshape(n, CHUNK // STEP, WIDE)
        y = m[:, :-1] @ w["w1"]
        y += m[:, 1:] @ w["w2"]
        y += w["b"]
        np.maximum(y, 0, out=y)
        used = (chunks != 0).sum(1).astype(np.float32)
        places = np.maximum(1, used / STEP)
        top = y.max(1)
        return np.concatenate([top, y.sum(1) / places[:, None], used[:, None] / CHUNK], 1), (chunks, m, y, top, places)

    def combine(self, pooled: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probability per document; doc: the first chunk of each document."""
        w = self.w
        h = np.tanh(pooled @ w["v"] + w["c"])
        count = np.diff(np.append(doc, len(h))).astype(np.float32)[:, None]
        both = np.concatenate([np.add.reduceat(h, doc) / count, np.maximum.reduceat(h, doc)], 1)
        z = (both @ w["o"] + w["d"])[:, 0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (pooled, h, count, both)

    def score(self, texts: list[bytes], budget: int = 256) -> np.ndarray:
        """Probability of each text; ``budget``: chunks that are convolved at once."""
        cuts = [chunk_starts(len(t)) for t in texts]
        pooled = np.empty((sum(map(len, cuts)), 2 * FILTERS + 1), np.float32)
        at, held = 0, []
        done = 0

        def run() -> None:
            nonlocal at, held
            if held:
                block = held[0] if len(held) == 1 else np.concatenate(held)
                pooled[at : at + len(block)] = self.pool(block)[0]
                at += len(block)
                held = []

        for t in texts:
            chunks = cut(t)
            for i in range(0, len(chunks), budget):
                held.append(chunks[i : i + budget])
                done += len(held[-1])
                if done >= budget:
                    run()
                    done = 0
        run()
        return self.combine(pooled, np.cumsum([0, *map(len, cuts[:-1])]))[0] if texts else np.zeros(0)

    def gradients(self, chunks: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        pooled, (_, m, act, top, places) = self.pool(chunks)
        p, (_, h, count, both) = self.combine(pooled, doc)
        dz = ((p - y) * weight / len(y)).astype(np.float32)[:, None]
        g = {"o": both.T @ dz, "d": dz.sum(0)}
        dboth = dz @ w["o"].T
        owner = np.repeat(np.arange(len(doc)), count[:, 0].astype(int))
        dh = (dboth[:, :HIDDEN] / count)[owner]
        peak = h == np.maximum.reduceat(h, doc)[owner]
        dh = dh + dboth[:, HIDDEN:][owner] * peak / np.maximum(1, np.add.reduceat(peak.astype(np.float32), doc))[owner]
        da = dh * (1 - h * h)
        g |= {"v": pooled.T @ da, "c": da.sum(0)}
        dp = da @ w["v"].T
        # The maximum's place gets the pooled gradient; the mean's is spread.
        dy = np.repeat((dp[:, FILTERS : 2 * FILTERS] / places[:, None])[:, None], PLACES, 1)
        where = act.argmax(1)
        i, f = np.indices(where.shape)
        dy[i, where, f] += dp[:, :FILTERS]
        dy *= act > 0
        flat = dy.reshape(-1, FILTERS)
        g |= {"w1": m[:, :-1].reshape(-1, WIDE).T @ flat, "w2": m[:, 1:].reshape(-1, WIDE).T @ flat, "b": flat.sum(0)}
        dm = np.zeros_like(m)
        dm[:, :-1] += dy @ w["w1"].T
        dm[:, 1:] += dy @ w["w2"].T
        by = dm.reshape(-1, DIM)
        codes = chunks.ravel()
        g["e"] = np.stack([np.bincount(codes, by[:, k], 256) for k in range(DIM)], 1).astype(np.float32)
        g["e"][0] = 0
        return g

    def fit(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int, rng: np.random.Generator, batch: int) -> None:
        """Adam on the weighted cross-entropy; docs: each document's chunks."""
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, steps = 0, epochs * -(-len(docs) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(docs), batch):
                pick = order[at : at + batch]
                chunks = np.concatenate([docs[i] for i in pick])
                doc = np.cumsum([0, *[len(docs[i]) for i in pick[:-1]]])
                grads = self.gradients(chunks, doc, y[pick], weight[pick])
                step += 1
                rate = 0.006 * (1 - step / (steps + 1))
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chunks: int, folds: int, held_fold: int) -> list[tuple[float, float, list[np.ndarray]]]:
    """(label, share of rows with it, documents' chunks) of a bounded sample of the learning folds."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold != held_fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                found = cut(text.encode("utf-8", "replace"))
                if len(found) > max_chunks:
                    found = found[np.sort(np.random.default_rng(zlib.crc32(str(i).encode())).choice(len(found), max_chunks, replace=False))]
                out.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.binary())], ["label", "chunks"])

    # Two sorts of at most per_class rows: the ids fit a broadcast by construction.
    # Of rows that share an identifier, the first text is learned from: what is collected is bounded by per_class, too.
    known = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = known.select("doc_id", "text", "label").mapInArrow(chunks, "label int, chunks binary").collect()
    rows = sorted((r["label"], bytes(r["chunks"])) for r in rows)
    total = sum(counts.get(v, 0) for v in (0, 1))
    return [
        (value, counts.get(value, 0) / max(1, total), [np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for v, c in rows if v == value])
        for value in (0, 1)
    ]


def train(sample: list[tuple[float, float, list[np.ndarray]]], epochs: int = 8, least_steps: int = 600, seed: int = 3, batch: int = 24) -> ByteNet | None:
    """A network for the sample; none if a class is missing. Small samples get more epochs."""
    if not all(docs for _, _, docs in sample):
        return None
    docs = [d for _, _, part in sample for d in part]
    y = np.concatenate([np.full(len(part), v, np.float32) for v, _, part in sample])
    weight = np.concatenate([np.full(len(part), share * len(docs) / len(part), np.float32) for _, share, part in sample])
    rng = np.random.default_rng(seed)
    net = ByteNet.untrained(rng)
    net.fit(docs, y, weight, max(epochs, -(-least_steps * batch // len(docs))), rng, batch)
    return net


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 800,
    max_chunks: int = 24,
    folds: int = 5,
    held_fold: int = 0,
    threshold: float = 0.3,
    carry: bool = False,
    rows: int = 64,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; with ``carry`` also the input's columns as ``row``.

    ``labels`` (identifier, 0/1) are learned only from identifiers whose crc32, modulo
    ``folds``, is not ``held_fold``; at most ``per_class`` rows of each class, those with
    the smallest hashes, and ``max_chunks`` chunks of each are learned from. Without
    rows of both classes every score is 0.5.

    Null texts count as empty; empty texts get the score of a chunk without bytes.
    Labels that are null or have a null identifier are left out; of several labels of a
    document the largest counts, and of several rows of an identifier the first text in
    alphabetical order is learned from. Null identifiers are scored, and are not held out.
    Repeated rows are scored one by one; an empty table gives an empty result. Other
    columns are not read unless carried.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    net = train(_sample(source, known, per_class, max_chunks, folds, held_fold))
    weights = net.w if net else None
    if carry:  # the text travels in the row
        source = docs.select(F.col(id_col).alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text_col)
    kept = [source.schema["doc_id"], *([source.schema["row"]] if carry else [])]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteNet(weights) if weights else None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = part.column(1).field(place) if carry else part.column(1)
                texts = [(t or "").encode("utf-8", "replace") for t in found.to_pylist()]
                scores = net.score(texts) if net else np.full(len(texts), 0.5)
                row = [part.column(1)] if carry else []
                yield pa.RecordBatch.from_arrays([part.column(0), *row, pa.array(scores.astype(np.float64))], ["doc_id", *(["row"] if carry else []), "score"])

    scored = source.mapInArrow(run, schema)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return scored.select(
        "doc_id",
        *(["row"] if carry else []),
        F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents predicted good, with the input's columns."""
    return score_quality(docs, labels, carry=True, **options).where("predicted = 1").select("row.*")
