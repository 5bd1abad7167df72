"""Lexical retrieval packing into fixed windows.

1. Every document is tokenised once; ids go to a scratch table, and with them each
   task's document frequencies of the vocabulary's terms (token ids), which count
   whole documents.
2. Full windows of long documents are sequences as they are; what is left of each
   document (less than a window) is packed with lexical neighbours.
3. Remainders are routed by a MinHash of their informative terms and range-partitioned
   by (route, salt) with sampled splitters: shards are of equal size whatever the
   distribution of routes, since a hot route is cut between salts.
4. Each shard builds a BM25 inverted index (document frequencies: whole corpus,
   lengths: against the mean of all remainders). The longest unused remainder seeds a
   window; the index returns its unused neighbours, best first, 64 at a time. Those
   that fit whole are placed, then the best one that does not fit is cut to fill the
   window, and its rest stays unused. When all 64 are used, the next best follow; then
   those that share only terms of very many documents, by an index of these terms;
   any other document only when none with a score is left.

Only the last window of a shard is padded. The vocabulary is the tokenizer's, so what
the driver gathers and broadcasts has its size, not the corpus's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .tokens import release, serialised_tokenizer, tokenizer_of

PIECES = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, ids_crc32 long"
K1, B = 1.2, 0.75
WHOLE = 1 << 62  # set in the sequence ids of windows that one document fills


class ShardIndex:
    """BM25 inverted index over the documents of one shard, for the terms of positive weight."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.count = len(docs)
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        known = np.flatnonzero(idf[flat] > 0)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)[known]
        key, tf = np.unique(flat[known].astype(np.int64) * max(1, len(docs)) + owner, return_counts=True)
        self.docs = (key % max(1, len(docs))).astype(np.int32)
        term = key // max(1, len(docs))
        norm = K1 * (1 - B + B * lengths[self.docs] / max(1.0, mean_length))
        self.weights = (idf[term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        self.terms, self.starts = np.unique(term, return_index=True)
        self.ends = np.append(self.starts[1:], len(key))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document for the query's distinct terms."""
        at = np.searchsorted(self.terms, query)
        at = at[at < len(self.terms)] if len(self.terms) else at[:0]
        at = at[np.isin(self.terms[at], query)]
        begin, size = self.starts[at], self.ends[at] - self.starts[at]
        total = int(size.sum())
        if not total:
            return np.zeros(self.count)
        stop = np.cumsum(size)
        rows = np.arange(total) + np.repeat(begin - (stop - size), size)
        return np.bincount(self.docs[rows], self.weights[rows], self.count)


def best_first(scores: np.ndarray, found: np.ndarray, most: int = 64) -> np.ndarray:
    """The ``most`` best of ``found`` (and ties of the last), best first, ties to the earlier."""
    if len(found) > most:
        found = found[scores[found] >= np.partition(scores[found], -most)[-most]]
    return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int, common: np.ndarray | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, first id, length) that hold every id of ``docs`` once.

    Neighbours by the terms that are not ``common`` (a mask) come before those by the
    common ones. Ties in score go to the earlier document.
    """
    weights = [idf] if common is None else [np.where(common, 0, idf), np.where(common, idf, 0)]
    indexes: list[ShardIndex] = []  # made when first needed

    def neighbours(level: int, seed: int) -> np.ndarray:
        """Scores of the unused documents."""
        if level == len(indexes):
            indexes.append(ShardIndex(docs, weights[level], mean_length))
        terms = np.unique(docs[seed]).astype(np.int64)
        return indexes[level].scores(terms[weights[level][terms] > 0]) * (left > 0)

    first = np.zeros(len(docs), np.int64)
    left = np.fromiter(map(len, docs), np.int64, len(docs))
    out = []
    for seed in np.argsort(-left, kind="stable"):
        # A document may have been cut since the order was made: its rest is a seed of its own.
        if not left[seed]:
            continue
        parts, room = [], window

        def place(d: int, n: int) -> None:
            nonlocal room
            parts.append((int(d), int(first[d]), int(n)))
            first[d] += n
            left[d] -= n
            room -= n

        place(seed, min(left[seed], room))
        if room:
            level, scores = 0, neighbours(0, seed)
            near = best_first(scores, np.flatnonzero(scores))
            while room:
                if not len(near):
                    # These neighbours are used up: the next best.
                    scores[left == 0] = 0
                    near = best_first(scores, np.flatnonzero(scores))
                while not len(near) and level + 1 < len(weights):
                    level += 1
                    scores = neighbours(level, seed)
                    near = best_first(scores, np.flatnonzero(scores))
                if not len(near):
                    # No unused neighbour is left: any unused document, the earliest first.
                    near = np.flatnonzero(left)[:1]
                    if not len(near):
                        break
                fits = np.flatnonzero(left[near] <= room)
                d = near[fits[0]] if len(fits) else near[0]
                place(d, min(left[d], room))
                near = near[near != d]
        out.append(parts)
    return out


def _tokenise(source: DataFrame, tokenizer: str, window: int, rows: int, with_ids: bool) -> DataFrame:
    """kind 0: a document, with checksums (and ids, if wanted) of its full windows and the ids of its rest; kind 1: terms and their counts."""
    id_type = source.schema[0].dataType.simpleString()
    names = ["kind", "doc_id", "n", "crcs", "full", "rest", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_of(tokenizer)
        vocabulary = encode.tokenizer.get_vocab_size()
        small = "<u2" if vocabulary <= 1 << 16 else "<u4"
        df = np.zeros(vocabulary, np.int64)
        seen, few = np.zeros(vocabulary, np.uint8), np.zeros(vocabulary, np.uint8)  # few: counts of up to 255 documents
        docs = rested = tokens = 0
        id_field = None
        for batch in batches:
            id_field = batch.schema.field(0)
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sizes, crcs, full, rests = [], [], [], []
                for x in encode.encode_batch(part.column(1).to_pylist()):
                    x = np.append(x, np.uint32(1)).astype("<u4")
                    stop = len(x) - len(x) % window
                    raw, rest = x[:stop].tobytes(), x[stop:]
                    sizes.append(len(x))
                    crcs.append([zlib.crc32(raw[i : i + 4 * window]) for i in range(0, len(raw), 4 * window)])
                    full.append(raw if with_ids and raw else None)
                    rests.append(rest.astype(small).tobytes())
                    seen[x] = 1
                    few += seen
                    seen[x] = 0
                    docs += 1
                    if docs % 255 == 0:
                        df += few
                        few[:] = 0
                    rested += len(rest) > 0
                    tokens += len(rest)
                n = len(sizes)
                columns = [pa.array(np.zeros(n, np.int8)), part.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
                columns += [pa.array(full, pa.binary()), pa.array(rests, pa.binary()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
        if docs:
            df += few
            terms = np.flatnonzero(df)
            counts = np.stack([np.append(terms, [-1, -2, -3]), np.append(df[terms], [docs, tokens, rested])]).astype("<i8").tobytes()
            columns = [pa.array([1], pa.int8()), pa.nulls(1, id_field.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64()))]
            columns += [pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, f"kind tinyint, doc_id {id_type}, n long, crcs array<long>, full binary, rest binary, counts binary")


def _term_counts(encoded: DataFrame) -> dict[int, int]:
    """Document frequency by term; -1: documents, -2: tokens of remainders, -3: remainders. As many rows as the vocabulary at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for t, c in zip(*np.frombuffer(raw, "<i8").reshape(2, -1).tolist(), strict=True):
                    total[t] = total.get(t, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    sums = encoded.where("kind = 1").select("counts").mapInArrow(add, "term long, n long")
    return {r["term"]: r["n"] for r in sums.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    shard_tokens: int = 1_000_000,
    stop_share: float = 0.1,
    rows: int = 128,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, padded_length, ids_crc32, ids``.

    A document's ids are the tokenizer's, then id 1; each lies in exactly one piece.
    ``ids`` (only ``with_ids``) are little-endian unsigned 32-bit, ``ids_crc32`` their
    checksum. ``padded_length`` is the window, or the sequence's length where that is a
    power of two. Terms in more than ``stop_share``
    of all documents count only where others find no neighbour. A shard's memory is in
    proportion to ``shard_tokens``: a larger partition is packed in several shards.

    Null and empty texts are the one id 1. Repeated rows and rows that share an
    identifier are packed one by one. Null identifiers are kept. An empty table gives
    an empty result. Other columns of the input are not read.
    """
    spark = docs.sparkSession
    tokenizer = serialised_tokenizer(tokenizer_path)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema[0].dataType.simpleString()
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    encoded = scratch.write(_tokenise(source, tokenizer, window, rows, with_ids), "encoded")
    counts = _term_counts(encoded)
    total, tokens, rested = counts.pop(-1, 0), counts.pop(-2, 0), counts.pop(-3, 0)
    vocabulary = max(counts, default=0) + 1
    idf, common = np.zeros(max(vocabulary, 1 << 16), np.float64), np.zeros(max(vocabulary, 1 << 16), bool)
    for t, n in counts.items():
        common[t] = n > max(1, stop_share * total)
        idf[t] = np.log(1 + (total - n + 0.5) / (n + 0.5))
    mean_length = tokens / max(1, rested)
    route_of = np.where((idf > 0) & ~common, np.random.default_rng(11).permutation(len(idf)), len(idf)).astype(np.int64)
    unpack = "<u2" if tokenizer_of(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    fixed = spark.sparkContext.broadcast((idf, route_of, common))
    body = encoded.where("kind = 0")
    schema = PIECES.format(id=id_type) + (", ids binary" if with_ids else "")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "ids_crc32", *(["ids"] if with_ids else [])]

    def piece_batch(id_field: pa.Field, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        columns.insert(7, [zlib.crc32(x) for x in columns[7]])
        kinds = [id_field.type, *[pa.int64()] * 7, *([pa.binary()] if with_ids else [])]
        columns = columns[: len(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema=pa.schema([pa.field(n, k) for n, k in zip(names, kinds, strict=True)]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        routes = fixed.value[1]
        for batch in batches:
            found = [int(routes[np.frombuffer(x, unpack)].min()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "route"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weights, _, common = fixed.value
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size, id_field = 0, None

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, size
            out: list[tuple] = []
            for parts in pack_shard([h[1] for h in held], weights, mean_length, window, common):
                offset, filled = 0, sum(p[2] for p in parts)
                padded = filled if filled & (filled - 1) == 0 else window
                for d, at, n in parts:
                    doc, ids, tokens_of = held[d]
                    start = tokens_of - len(ids) + at
                    out.append((doc, start, n, tokens_of, sequence, offset, padded, ids[at : at + n].astype("<u4").tobytes()))
                    offset += n
                sequence += 1
                if len(out) >= 2_000:
                    yield piece_batch(id_field, out)
                    out = []
            if out:
                yield piece_batch(id_field, out)
            held.clear()
            size = 0

        for batch in batches:
            id_field = batch.schema.field(0)
            for doc, raw, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(raw, unpack)
                held.append((doc, ids, n))
                size += len(ids)
                if size >= shard_tokens:
                    yield from finish()
        if held:
            yield from finish()

    rest = body.where(F.col("n") % window > 0).select("doc_id", F.col("rest").alias("ids"), "n")
    routed = rest.mapInArrow(route, f"doc_id {id_type}, ids binary, n long, route long").withColumn("salt", F.xxhash64("doc_id", "ids"))
    # As many partitions as shards, but not more than the cluster's tasks ask for.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = routed.repartitionByRange(max(1, min(tasks, -(-tokens // shard_tokens))), "route", "salt").sortWithinPartitions("route", "salt", "doc_id", "n")
    packed = dealt.select("doc_id", "ids", "n").mapInArrow(shards, schema)
    whole = body.where(F.col("n") >= window).select("doc_id", "n", *(["full"] if with_ids else []), F.posexplode("crcs").alias("i", "ids_crc32"))
    at = F.col("i").cast("long") * window
    filled = whole.select(
        "doc_id",
        at.alias("start"),
        F.lit(window).cast("long").alias("length"),
        F.col("n").alias("doc_tokens"),
        (F.monotonically_increasing_id() + WHOLE).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(window).cast("long").alias("padded_length"),
        "ids_crc32",
        *([F.substring("full", (at * 4 + 1).cast("int"), F.lit(4 * window)).alias("ids")] if with_ids else []),
    )
    return filled.unionByName(packed)
