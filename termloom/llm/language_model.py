"""Log-bilinear language model, trained with noise-contrastive estimation in numpy.

Output units are the text end, the most frequent words, and, for all other words,
classes by their last bytes; words seen once share the last unit with the unknown word.
Units have vectors of their own, as context and as prediction, and lie in classes by
frequency: p(word | context) = p(class | context) p(unit | class, context) p(word | unit),
of which the first two are learned. Scores are exactly normalised, over the V distinct
training tokens and one unknown, by matrix products over whole batches of contexts.

1. Tasks split texts into words and write blocks of documents with a dictionary of
   their own (word, training count).
2. Dictionary entries meet by word in one shuffle, which gives every entry the count
   over all training documents; they return to their blocks by a second one. The
   vocabulary is never gathered or broadcast; only unit tables of fixed size are.
3. Training documents are dealt to shards by a hash, in an order of their own, so that
   the model does not depend on how rows were partitioned. Training is data-parallel
   over all shards, where the shuffle leaves them: each takes NCE steps from the common
   parameters, which are averaged by a distributed sum (``rounds`` times, each with its
   part of the tokens).
4. Every document is scored with the final parameters.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches

CLASSES, SLOTS = 128, 128
UNITS, END = CLASSES * SLOTS, 0
TOP = UNITS - SLOTS - 1  # words with a unit of their own: all classes but the last, without the end
RARE = UNITS - 1
SUFFIXES = SLOTS - 1  # the last class: words by suffix, and the rare ones
LEAST = 8  # occurrences of a word with a unit of its own
CONTEXT, DIM, NOISE, OWN_NOISE, BATCH, RUN = 3, 16, 24, 10, 3_072, 32
PAST = 0.1  # sum of squares that steps start with
RATE, LAST_RATE = 0.3, 0.15  # of the first round's steps
UNKNOWN_SHARE = 0.5  # of the last unit; the words seen once share the rest
PIECE = 1 << 14  # parameters that are summed together
ROW_TOKENS = 100_000  # of a block's documents in one row, or one document's


class Unigram:
    """Shares of classes, and of units in their class."""

    def __init__(self, mass: np.ndarray):
        mass = (mass + 1e-3).reshape(CLASSES, SLOTS)
        by_class = mass.sum(1)
        self.classes = by_class / by_class.sum()
        self.units = mass / by_class[:, None]
        self.steps = np.cumsum(self.units, 1)

    def draw(self, classes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Noise units (n, OWN_NOISE) of each class."""
        at = np.sort(rng.random((len(classes), OWN_NOISE)), 1)
        flat = np.searchsorted((self.steps + np.arange(CLASSES)[:, None]).ravel(), at + classes[:, None])
        return np.clip(flat, classes[:, None] * SLOTS, classes[:, None] * SLOTS + SLOTS - 1)


class Text:
    """Units of some documents, one after the other."""

    def __init__(self, units: np.ndarray, sizes: np.ndarray):
        self.units = units
        # How many units of its document are before each one; more than the context does not matter.
        self.before = np.full(len(units), CONTEXT, np.uint8)
        starts = np.cumsum(sizes) - sizes
        for j in range(CONTEXT - 1, -1, -1):
            self.before[starts[sizes > j] + j] = j

    def contexts(self, places: np.ndarray) -> list[np.ndarray]:
        """The previous units by distance, the nearest first; before a document stand ends."""
        before = self.before[places]
        return [np.where(before > j, self.units[np.maximum(places - j - 1, 0)], np.uint16(END)) for j in range(CONTEXT)]


class LogBilinear:
    """Vectors of context units, weights of their positions, vectors and biases of predicted classes and units."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        at = 0

        def take(*shape: int) -> np.ndarray:
            nonlocal at
            at += (n := int(np.prod(shape)))
            return flat[at - n : at].reshape(shape)

        self.r, self.d = take(UNITS, DIM), take(CONTEXT, DIM)
        self.qc, self.bc = take(CLASSES, DIM), take(CLASSES)
        self.q, self.b = take(UNITS, DIM), take(UNITS)
        self.size = at

    @classmethod
    def untrained(cls, unigram: Unigram, seed: int = 5) -> LogBilinear:
        """Starts as the unigram model of the units."""
        rng = np.random.default_rng(seed)
        size = 2 * UNITS * DIM + CONTEXT * DIM + CLASSES * (DIM + 1) + UNITS
        net = cls((rng.standard_normal(size) * 0.1).astype(np.float32))
        net.d[:] = 1 / np.arange(1, CONTEXT + 1)[:, None]
        net.bc[:] = np.log(unigram.classes)
        net.b[:] = np.log(unigram.units).ravel()
        return net

    def predict(self, contexts: list[np.ndarray]) -> np.ndarray:
        """Predicted vectors; contexts: CONTEXT arrays of units, the nearest first."""
        out = self.r[contexts[0]] * self.d[0]
        for j in range(1, CONTEXT):
            out += self.r[contexts[j]] * self.d[j]
        return out

    def class_scores(self, predicted: np.ndarray) -> np.ndarray:
        """Of every class, not yet normalised."""
        s = predicted @ self.qc.T
        s += self.bc
        return s

    def unit_scores(self, predicted: np.ndarray, k: int) -> np.ndarray:
        """Of every unit of class ``k``, not yet normalised."""
        own = slice(k * SLOTS, (k + 1) * SLOTS)
        s = predicted @ self.q[own].T
        s += self.b[own]
        return s

    def train(self, text: Text, pick: np.ndarray, unigram: Unigram, rng: np.random.Generator, rate: float = RATE, last: float = LAST_RATE) -> None:
        """Steps for the tokens at the places ``pick``, in this order. Noise-contrastive estimation over mini-batches, of the class and of the unit in it (AdaGrad, from ``rate`` to ``last``).

        A batch shares its noise classes, and for each class its noise units.
        """
        log_class, log_unit = np.log(unigram.classes).astype(np.float32), np.log(unigram.units).astype(np.float32).ravel()
        start = lambda n: np.full(n, PAST, np.float32)
        past_c, past_u, past_bc, past_b, past_r, past_d = (start(n) for n in (CLASSES, UNITS, CLASSES, UNITS, UNITS, CONTEXT))
        for at in range(0, len(pick), BATCH):
            pace = rate + (last - rate) * at / len(pick)
            places = pick[at : at + BATCH]
            places = places[np.argsort(text.units[places], kind="stable")]  # by unit, hence by class
            ctx, own = text.contexts(places), text.units[places].astype(np.int64)
            kind = own // SLOTS
            before = [self.r[c] for c in ctx]
            p = before[0] * self.d[0]
            for j in range(1, CONTEXT):
                p += before[j] * self.d[j]
            noise = rng.choice(CLASSES, (1, NOISE), p=unigram.classes)
            dr, used, dq, db = _contrast(p, self.qc, self.bc, kind, np.zeros(1, np.int64), noise, log_class)
            starts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            noise = unigram.draw(kind[starts], rng)
            more, its, dqu, dbu = _contrast(p, self.q, self.b, own, starts, noise, log_unit)
            dr += more
            dd = np.stack([np.einsum("ij,ij->j", dr, x) for x in before]) / len(own)
            rows = np.concatenate([dr * self.d[j] for j in range(CONTEXT)])
            _step(self.qc, past_c, used, dq, pace)
            _step(self.bc, past_bc, used, db, pace)
            _step(self.q, past_u, its, dqu, pace)
            _step(self.b, past_b, its, dbu, pace)
            _step(self.d, past_d, np.arange(CONTEXT), dd, pace * 0.1)
            _step(self.r, past_r, *_sum_by(np.concatenate(ctx), rows), pace)


def log_probability(scores: np.ndarray, chosen: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of each row's softmax at the chosen column; ``room``, as many rows or more, is overwritten."""
    own = scores[np.arange(len(scores)), chosen]
    with np.errstate(over="ignore"):
        z = np.exp(scores, out=None if room is None else room[: len(scores)]).sum(1)
    if not (z.min() > 1e-30 and np.isfinite(z).all()):
        top = scores.max(1)
        own, z = own - top, np.exp(scores - top[:, None]).sum(1)
    return own - np.log(z)


def _contrast(p: np.ndarray, q: np.ndarray, b: np.ndarray, own: np.ndarray, starts: np.ndarray, noise: np.ndarray, log_share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the contrastive loss by the predictions ``p``; the rows ``used`` of ``q`` and ``b``, and gradients by them.

    ``own``, the targets, are sorted; groups of them begin at ``starts`` and share a row of ``noise``.
    """
    stops = [*starts[1:].tolist(), len(own)]
    log_noise = np.float32(np.log(noise.shape[1])) + log_share
    mine, others = q[own], q[noise]
    z = np.empty((len(own), noise.shape[1]), p.dtype)
    for g, (i, j) in enumerate(zip(starts.tolist(), stops, strict=True)):
        np.matmul(p[i:j], others[g].T, out=z[i:j])
    z += np.repeat(b[noise] - log_noise[noise], np.diff([*starts, len(own)]), axis=0)
    d_noise = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    d_own = -1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", p, mine) + b[own] - log_noise[own], -30, 30)))
    dp = d_own[:, None] * mine
    d_others = np.empty(others.shape, p.dtype)
    for g, (i, j) in enumerate(zip(starts.tolist(), stops, strict=True)):
        dp[i:j] += d_noise[i:j] @ others[g]
        np.matmul(d_noise[i:j].T, p[i:j], out=d_others[g])
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    rows = np.concatenate([np.add.reduceat(d_own[:, None] * p, first, axis=0), d_others.reshape(-1, p.shape[1])])
    biases = np.concatenate([np.add.reduceat(d_own, first), np.add.reduceat(d_noise, starts, axis=0).ravel()])
    used, both = _sum_by(np.concatenate([own[first], noise.ravel()]), np.concatenate([rows, biases[:, None]], 1))
    return dp, used, both[:, :-1], both[:, -1]


def _sum_by(units: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct units, and the sum of each one's rows."""
    order = np.argsort(units, kind="stable")
    found = units[order]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    return found[first], np.add.reduceat(rows[order], first, axis=0)


def _step(value: np.ndarray, past: np.ndarray, used: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """One AdaGrad step of the rows ``used``, with one sum of squares for each row."""
    total = past[used] + (grad * grad if grad.ndim == 1 else np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1]))
    past[used] = total
    pace = np.float32(rate) / np.sqrt(total)
    value[used] -= pace * grad if grad.ndim == 1 else pace[:, None] * grad


def places_of(size: int, seed: int, part: int, parts: int) -> np.ndarray:
    """One of ``parts`` of the places below ``size``, in a random order of runs: neighbours in the text are read together."""
    runs = np.random.default_rng(seed).permutation(-(-size // RUN))[part::parts]
    places = (runs[:, None] * RUN + np.arange(RUN)).ravel().astype(np.int32)
    return places[places < size]


def _blocks(source: DataFrame, folds: int, held_fold: int, block_tokens: int) -> DataFrame:
    """Rows with ``idx``: a block's dictionary; rows with ``ids``: some of its documents."""
    import zlib

    id_type = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        docs: list = []
        held: list[bool] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        total, id_kind = 0, None

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal block, total
            words = list(index)
            counts = np.zeros(len(words), np.int64)
            for x, out in zip(ids, held, strict=True):
                if not out:
                    counts += np.bincount(x, minlength=len(words)) if len(x) * 20 > len(words) else 0
                    if len(x) * 20 <= len(words):
                        np.add.at(counts, x, 1)
            for at in range(0, len(words), 50_000):
                n = len(part := words[at : at + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(part, pa.binary()), pa.array(counts[at : at + n])]
                    + [pa.nulls(n, k) for k in (pa.list_(id_kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())],
                    names,
                )
            stops = np.cumsum(np.array(sizes) + 1)
            edges = [0, *(np.flatnonzero(np.diff(stops // ROW_TOKENS)) + 1).tolist(), len(docs)]
            for i, j in zip(edges, edges[1:], strict=False):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()),
                        pa.array([docs[i:j]], pa.list_(id_kind)), pa.array([held[i:j]], pa.list_(pa.bool_())), pa.array([sizes[i:j]], pa.list_(pa.int32())),
                        pa.array([np.concatenate(ids[i:j]).astype("<i4").tobytes()], pa.binary()),
                    ],
                    names,
                )
            for kept in (index, docs, held, sizes, ids):
                kept.clear()
            pa.default_memory_pool().release_unused()
            block += 1
            total = 0

        names = ["block", "idx", "word", "n", "docs", "held", "sizes", "ids"]
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = text.lower().split()
                ids.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                docs.append(doc)
                held.append(doc is not None and zlib.crc32(str(doc).encode()) % folds == held_fold)
                sizes.append(len(words))
                total += len(words) + 1
                if total >= block_tokens:
                    yield from finish()
        if docs:
            yield from finish()

    schema = f"block long, idx int, word binary, n long, docs array<{id_type}>, held array<boolean>, sizes array<int>, ids binary"
    return source.mapInArrow(run, schema)


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    block_tokens: int = 1_500_000,
    shard_tokens: int = 5_000_000,
    rounds: int = 1,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents whose identifier's crc32, modulo ``folds``, is ``held_fold`` are scored but
    not learned from. Tokens are the words between ASCII white space, A-Z in lower case,
    and one end. ``base_score`` is the add-one unigram's log10 probability, ``score`` the
    network's. Counts cover every training token; so do the network's steps, in which each
    round takes its own part of every shard. Scores do not depend on the partitioning.

    Null and empty texts are the end alone. Rows that repeat an identifier are documents
    of their own. Null identifiers are learned from. Without training documents both
    scores are 0. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema[0].dataType.simpleString()
    small_batches(spark)
    scratch = Scratch(spark, "language-model")
    blocks = scratch.write(_blocks(source, folds, held_fold, block_tokens), "blocks")

    same = Window.partitionBy("h", "word")
    entries = (
        blocks.where("idx IS NOT NULL").select("block", "idx", "word", "n", F.xxhash64("word").alias("h"))
        .select(
            "block", "idx",
            F.when(F.sum("n").over(same) >= LEAST, F.col("h")).alias("h"),
            F.sum("n").over(same).alias("c"),
            (F.min("block").over(same) == F.col("block")).alias("first"),
            F.pmod(F.xxhash64(F.expr("substring(word, -3, 3)")), F.lit(SUFFIXES)).cast("byte").alias("suffix"),
        )
    )
    entries = scratch.write(entries, "entries")
    distinct = entries.where("first AND c > 0")
    ends = blocks.where("ids IS NOT NULL").select(F.explode("held").alias("held")).where("NOT held").count()
    known = distinct.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = known["n"] + ends, known["v"] + (ends > 0)
    # Counts in steps of 9 %: only words about as frequent as the last one wanted are sorted.
    often, step = distinct.where(F.col("c") >= LEAST), F.floor(F.log2("c") * 8)
    held, least = 0, 0
    for r in sorted(often.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held, least = held + r["count"], r["step"]
        if held >= TOP:
            break
    top = [r["h"] for r in often.where(step >= least).orderBy(F.desc("c"), "h").limit(TOP).collect()]
    ranks = spark.createDataFrame([(h, 1 + i) for i, h in enumerate(top)], "h long, rank int")
    unit = F.coalesce("rank", F.when(F.col("c") <= 1, RARE).otherwise(F.col("suffix") + TOP + 1)).cast("short")
    placed = entries.join(F.broadcast(ranks), "h", "left").withColumn("unit", unit)
    mass = np.zeros(UNITS)
    for r in placed.where("first").groupBy("unit").agg(F.sum("c").alias("c")).collect():
        mass[r["unit"]] = r["c"]
    mass[END] = ends

    log_total = np.log10(tokens + types + 1)
    coded_schema = f"doc_id {id_type}, held boolean, n_tokens long, n_known long, base double, inner double, units binary"

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        """Per block: each document's units (with the end), and its sums that need no context."""
        if not left.num_rows:
            return arrow_schema.empty_table()
        size = right.num_rows
        c, unit = np.zeros(size, np.int64), np.zeros(size, np.uint16)
        idx = right.column("idx").to_numpy()
        c[idx], unit[idx] = right.column("c").to_numpy(), right.column("unit").to_numpy()
        inner = word_shares(c, unit, mass)
        base = np.log10(c + 1.0) - log_total
        made = []
        for row in range(left.num_rows):
            ids = np.frombuffer(left.column("ids")[row].as_py(), "<i4")
            sizes = np.array(left.column("sizes")[row].as_py(), np.int64)
            stop = np.cumsum(sizes)

            def by_doc(values: np.ndarray, sizes: np.ndarray = sizes, stop: np.ndarray = stop) -> np.ndarray:
                out = np.zeros(len(sizes), values.dtype)
                full = np.flatnonzero(sizes)
                if len(full):
                    out[full] = np.add.reduceat(values, (stop - sizes)[full])
                return out

            raw = np.insert(unit[ids], stop, END).astype("<u2").tobytes()
            ends_at = np.append(0, stop + np.arange(1, len(sizes) + 1))
            made.append(
                pa.RecordBatch.from_arrays(
                    [
                        left.column("docs")[row].values, left.column("held")[row].values,
                        pa.array(sizes + 1), pa.array(by_doc((c > 0)[ids].astype(np.int64)) + (ends > 0)),
                        pa.array(by_doc(base[ids]) + np.log10(ends + 1.0) - log_total), pa.array(by_doc(inner[ids])),
                        pa.array([raw[2 * i : 2 * j] for i, j in zip(ends_at[:-1].tolist(), ends_at[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    schema=arrow_schema,
                )
            )
        return pa.Table.from_batches(made, arrow_schema)

    left = blocks.where("ids IS NOT NULL").select("block", "docs", "held", "sizes", "ids")
    right = placed.select("block", "idx", "c", "unit")
    arrow_schema = _arrow_schema(spark, coded_schema)
    coded = scratch.write(left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(join, coded_schema), "coded")
    scratch.drop("blocks")
    scratch.drop("entries")

    unigram = Unigram(mass)
    flat = LogBilinear.untrained(unigram).flat
    if tokens:
        shards = _shards(coded, max(1, -(-tokens // shard_tokens)))
        for k in range(rounds):
            flat = _train_round(shards, shard_tokens * 2, flat, unigram, k, rounds)
    final = spark.sparkContext.broadcast(without_empty(flat, mass))  # of fixed size
    trained = tokens > 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = LogBilinear(final.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(2).to_numpy()
            units = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u2")
            total = batch.column(5).to_numpy() + np.add.reduceat(token_scores(net, units, sizes), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), batch.column(3),
                    pa.array(np.full(len(sizes), tokens, np.int64)), batch.column(4), pa.array(total if trained else np.zeros(len(sizes))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return coded.mapInArrow(
        score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def token_scores(net: LogBilinear, units: np.ndarray, sizes: np.ndarray, batch: int = 16_384, rows: int = 1_024) -> np.ndarray:
    """log10 p(unit | context) of each token; scores of ``rows`` contexts at a time stay in the processor's cache."""
    out = np.empty(len(units))
    text = Text(units, sizes)
    room = np.empty((rows, max(CLASSES, SLOTS)), net.flat.dtype)
    for at in range(0, len(units), batch):
        places = at + np.argsort(units[at : at + batch], kind="stable")  # by unit, hence by class
        own = units[places].astype(np.int64)
        kind = own // SLOTS
        p = net.predict(text.contexts(places))
        score = np.empty(len(p))
        for i in range(0, len(p), rows):
            j = min(len(p), i + rows)
            score[i:j] = log_probability(net.class_scores(p[i:j]), kind[i:j], room[:, :CLASSES])
        edges = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True):
            k = int(kind[a])
            for i in range(a, b, rows):
                j = min(b, i + rows)
                score[i:j] += log_probability(net.unit_scores(p[i:j], k), own[i:j] - k * SLOTS, room[:, :SLOTS])
        out[places] = score
    return out / np.log(10)


def _shards(coded: DataFrame, count: int) -> DataFrame:
    """``shard, units`` of the training documents, dealt and ordered by their content."""
    order = F.xxhash64("doc_id", "units")
    rows = coded.where("NOT held").select(F.pmod(order, F.lit(count)).alias("shard"), order.alias("order"), "doc_id", "units")
    return rows.repartition("shard").sortWithinPartitions("shard", "order", "doc_id", "units").select("shard", "units")


def _train_round(shards: DataFrame, most: int, flat: np.ndarray, unigram: Unigram, k: int, rounds: int) -> np.ndarray:
    """The shards' parameters after a round, averaged by their tokens; a shard of ``most`` tokens or more is trained in parts."""
    start = shards.sparkSession.sparkContext.broadcast(flat)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weight = np.zeros(len(flat)), 0
        held: list[bytes] = []
        total, shard = 0, None

        def train() -> None:
            nonlocal sums, weight, total
            sizes = np.array([len(x) // 2 for x in held], np.int64)
            units = np.frombuffer(b"".join(held), "<u2")
            held.clear()
            total = 0
            pick = places_of(len(units), len(sizes), k, rounds)
            if len(pick):
                net = LogBilinear(start.value.copy())
                net.train(Text(units, sizes), pick, unigram, np.random.default_rng([2, k, len(units)]), RATE / (1 + k), LAST_RATE / (1 + k))
                sums += net.flat * np.float64(len(pick))
                weight += len(pick)

        for batch in batches:
            for s, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (s != shard or total >= most):
                    train()
                shard = s
                held.append(units)
                total += len(units) // 2
            del batch
            pa.default_memory_pool().release_unused()
        if held:
            train()
        if weight:
            yield pieces(TaskContext.get().partitionId() % 32, sums, weight)

    def pieces(salt: int, total: np.ndarray, weight: int) -> pa.RecordBatch:
        values = [total[at : at + PIECE].tobytes() for at in range(0, len(total), PIECE)]
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, salt, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, weight, np.int64)), pa.array(values, pa.binary())], ["salt", "i", "weight", "v"]
        )

    def add(rows: pa.Table) -> pa.Table:
        total = 0
        for v in rows.column("v").to_pylist():
            total = total + np.frombuffer(v, np.float64)
        return pa.table({"salt": rows.column("salt").slice(0, 1), "i": rows.column("i").slice(0, 1), "weight": pa.array([sum(rows.column("weight").to_pylist())], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    schema = "salt int, i int, weight long, v binary"
    sums = shards.mapInArrow(run, schema).groupBy("i", "salt").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema)
    rows = sorted(sums.collect(), key=lambda r: r["i"])  # one row for each piece of the parameters
    if not rows:  # fewer runs than rounds
        return flat
    return (np.concatenate([np.frombuffer(r["v"], np.float64) for r in rows]) / rows[0]["weight"]).astype(np.float32)


def word_shares(c: np.ndarray, unit: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 p(word | unit) of words with these training counts; the rare unit's words are those seen once, and the unknown."""
    out = np.log10(np.maximum(c, 1)) - np.log10(np.maximum(mass[unit], 1))
    rare, once = unit == RARE, mass[RARE]
    out[rare & (c > 0)] = np.log10((1 - UNKNOWN_SHARE) / max(1.0, once))
    out[rare & (c == 0)] = np.log10(UNKNOWN_SHARE if once else 1.0)
    return out


def without_empty(flat: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The parameters, with probability 0 for units that no word has."""
    net = LogBilinear(flat.copy())
    empty = mass == 0
    empty[RARE] = False
    net.b[empty] = -1e9
    net.bc[empty.reshape(CLASSES, SLOTS).all(1)] = -1e9
    return net.flat


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)
