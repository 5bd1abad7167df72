"""Mixing to target weights with soft domain membership.

1. A classifier learned from a table of labelled documents gives every document a
   posterior over domains: logistic regression on the hashed words that tell the
   domains apart in a bounded sample, and on a few proportions of the text.
2. Nonnegative rates, how often each document is used, are fitted by projected-gradient
   least squares, so that the expected tokens of each domain match their targets. The
   gradient needs one number per domain; each step is one aggregation over all
   documents, with rates recomputed from the steps so far. Starting from rate 1, the
   steps change rates as little as the targets need.
3. A rate becomes a whole number of copies: its floor, and one more with the
   probability of its fraction, decided by a hash of the identifier.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, small_batches

BUCKETS = 1 << 16
DENSE = 6


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        b = self[word] = zlib.crc32(word) % BUCKETS
        return b


def read_text(text: bytes, buckets: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Words, distinct word buckets, proportions."""
    words = text.lower().translate(None, b".,;:!?").split()
    n = len(words)
    found = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, n))
    b = np.frombuffer(text, np.uint8)
    size = max(1, len(b))
    upper = np.count_nonzero((b >= 65) & (b <= 90))
    letters = upper + np.count_nonzero(((b >= 97) & (b <= 122)) | (b >= 128))
    repeats = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    dense = np.array([upper / size, letters / size, repeats / max(1, n - 1), len(found) / max(1, n), np.log1p(n) / 8, 1.0])
    return n, found, dense


class DomainClassifier:
    """Multinomial logistic regression over selected buckets and proportions."""

    def __init__(self, selected: np.ndarray, weights: np.ndarray):
        self.weights = weights  # (selected + DENSE, domains)
        self.place = np.full(BUCKETS, -1, np.int64)
        self.place[selected] = np.arange(len(selected))
        self.chosen = len(selected)

    def posterior(self, found: np.ndarray, dense: np.ndarray) -> np.ndarray:
        at = self.place[found]
        z = self.weights[at[at >= 0]].sum(0) + dense @ self.weights[self.chosen :]
        p = np.exp(z - z.max())
        return p / p.sum()

    @classmethod
    def fit(cls, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: np.ndarray, features: int = 512, epochs: int = 30, seed: int = 9) -> DomainClassifier:
        """Docs: (buckets, proportions); share: each domain's share of all labelled rows."""
        domains = len(share)
        held = np.array([np.bincount(np.concatenate([docs[i][0] for i in np.flatnonzero(y == d)] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for d in range(domains)], float)
        sizes = np.maximum(1, np.bincount(y, minlength=domains))[:, None]
        rates = (held + 0.5) / (sizes + 1)
        overall = rates.mean(0)
        spread = (((rates - overall) ** 2) * sizes / (overall * (1 - np.minimum(overall, 0.999)))).sum(0) * (held.sum(0) >= 3)
        selected = np.sort(np.argsort(-spread, kind="stable")[:features])
        model = cls(selected, np.zeros((len(selected) + DENSE, domains)))
        x = np.zeros((len(docs), len(selected) + DENSE))
        for i, (found, dense) in enumerate(docs):
            at = model.place[found]
            x[i, at[at >= 0]] = 1
            x[i, len(selected) :] = dense
        # Rows are weighted so that domains count by their share of the labels.
        weight = (share / sizes[:, 0])[y] * len(docs) if share.sum() else np.ones(len(docs))
        rng, past = np.random.default_rng(seed), np.full_like(model.weights, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(docs), 32):
                pick = order[at : at + 32]
                z = x[pick] @ model.weights
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                g = x[pick].T @ (p * weight[pick, None]) / len(pick) + 1e-4 * model.weights
                past += g * g
                model.weights -= 0.3 * g / np.sqrt(past)
        return model


def _learn(source: DataFrame, known: DataFrame, names: list[str], per_domain: int) -> DomainClassifier | None:
    known = known.where(F.col("domain").isin(names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    picked = None
    for name in names:
        part = known.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            found, dense = [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                _, f, d = read_text(text, buckets)
                found.append(f.astype("<u2").tobytes())
                dense.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary()), pa.array(dense, pa.binary())], ["domain", "found", "dense"])

    # At most per_domain rows of each domain; a row is at most 2 bytes for each of the 65,536 buckets.
    # Of rows that share an identifier, the first text is learned from.
    texts = source.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    rows = texts.select("text", "domain").mapInArrow(run, "domain string, found binary, dense binary").collect()
    if not rows:
        return None
    rows = sorted((r["domain"], bytes(r["found"]), bytes(r["dense"])) for r in rows)
    docs = [(np.frombuffer(f, "<u2").astype(np.int64), np.frombuffer(d)) for _, f, d in rows]
    y = np.array([names.index(r[0]) for r in rows])
    share = np.array([counts.get(n, 0) for n in names], float)
    return DomainClassifier.fit(docs, y, share / max(1.0, share.sum()))


def posteriors(docs: DataFrame, known: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", per_domain: int = 1_000, carry: bool = False, rows: int = 256) -> DataFrame:
    """``doc_id, n_tokens, p`` (posterior in the order of ``names``), and the input's columns as ``row`` if carried.

    ``known``: ``doc_id, domain``. Without any labelled document, domains are equally likely.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    source = docs.select(F.col(id_col).alias("doc_id"), text)
    model = _learn(source, known, names, per_domain)
    if carry:  # the text travels in the row
        source = docs.select(F.col(id_col).alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index(text_col)
    kept = [source.schema["doc_id"], *([source.schema["row"]] if carry else [])]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    even = np.full(len(names), 1 / len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                n, p = [], []
                texts = part.column(1).field(place) if carry else part.column(1)
                for t in texts.cast(pa.binary()).to_pylist():
                    count, found, dense = read_text(t or b"", buckets)
                    n.append(count)
                    p.append(model.posterior(found, dense) if model else even)
                row = [part.column(1)] if carry else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *row, pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["doc_id", *(["row"] if carry else []), "n_tokens", "p"]
                )

    return source.mapInArrow(run, schema)


def rate_after(steps: list[list[float]], p: Column) -> Column:
    """The rate that projected-gradient steps from 1 lead to; a step has one number per domain."""
    if not steps:
        return F.lit(1.0)
    path = F.array(*[F.array(*map(F.lit, g)) for g in steps])
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(path, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def fit_rates(
    table: DataFrame, targets: list[float], budget: float | None = None, repeats: float = 1.0, tolerance: float = 1e-3, most_steps: int = 40
) -> list[list[float]]:
    """Steps of the fit over ``table (n_tokens, p)``.

    ``targets`` are weights of the domains, ``budget`` the tokens to reach: by default, the
    domain of the largest weight keeps all its tokens. A domain that has too few for its
    target gets ``repeats`` times its tokens instead.
    """
    weights = np.array(targets, float) / sum(targets)
    domains = range(len(weights))
    n = F.col("n_tokens").cast("double")

    pairs = [(d, e) for d in domains for e in domains if e >= d]

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by domain, and the Gram matrix of the documents that are in use."""
        used = table.select(n.alias("n"), "p", rate_after(steps, F.col("p")).alias("r"))
        p, active = F.col("p"), F.when(F.col("r") > 0, F.col("n")).otherwise(0.0)
        sums = [F.sum(F.col("n") * p[d] * F.col("r")) for d in domains] + [F.sum(active * p[d] * p[e]) for d, e in pairs]
        got = [x or 0.0 for x in used.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]
        gram = np.zeros((len(weights), len(weights)))
        for (d, e), x in zip(pairs, got[len(weights) :], strict=True):
            gram[d, e] = gram[e, d] = x
        return np.array(got[: len(weights)]), gram

    supply, gram = totals([])
    if not supply.sum():
        return []
    if budget is None:
        budget = supply[weights.argmax()] / weights.max()
    goal = np.minimum(weights * budget, repeats * supply)
    steps: list[list[float]] = []
    now, pace = supply, 1.0
    off = np.abs(now - goal).max()
    while len(steps) < most_steps and off > tolerance * budget:
        # The gradient in the metric of the documents' own tokens, scaled by the domains' Gram matrix.
        ridge = np.diag(1e-3 * np.maximum(supply, supply.max() * 1e-6))
        steps.append((pace * np.linalg.solve(gram + ridge, now - goal)).tolist())
        now, gram = totals(steps)
        before, off = off, np.abs(now - goal).max()
        pace = max(0.1, pace / 2) if off > before else min(1.0, pace * 1.5)
    return steps


def mix(
    docs: DataFrame,
    known: DataFrame,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: float | None = None,
    repeats: float = 1.0,
    per_domain: int = 1_000,
    carry: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, p, rate, copies``; with ``carry`` the input's columns as ``row``.

    ``targets`` are the domains' weights, ``budget`` and ``repeats`` as for :func:`fit_rates`.

    Null and empty texts have no tokens: they match no target, and their rate follows
    their posterior. Rows that repeat an identifier are documents of their own, with equal
    copies if their texts are equal. A null identifier is a valid one. Labels that are null
    or name no target are left out; of several labels of a document the first in
    alphabetical order counts, and of several rows of a labelled identifier the first text.
    Tokens are words between white space. An empty table gives an empty result. Other columns are not
    read unless carried.
    """
    names = sorted(targets)
    scratch = Scratch(docs.sparkSession, "mixing")
    table = scratch.write(posteriors(docs, known, names, id_col, text_col, per_domain, carry), "posteriors")
    steps = fit_rates(table.select("n_tokens", "p"), [targets[n] for n in names], budget, repeats)
    rated = table.withColumn("rate", rate_after(steps, F.col("p")))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    floor = F.floor("rate")
    copies = (floor + (draw < F.col("rate") - floor).cast("long")).cast("int")
    return rated.select("doc_id", *(["row"] if carry else []), "n_tokens", "p", "rate", copies.alias("copies"))


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of a table of quality and toxicity marks: low, toxic or clean."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def mixed_documents(docs: DataFrame, known: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The documents as often as their copies say, with the input's columns."""
    used = mix(docs, known, targets, carry=True, **options).where("copies > 0")
    return used.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
