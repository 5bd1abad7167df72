"""Encoded lines in blocks, and n-grams from them with little to shuffle.

A block is a row that holds some million tokens as numbers. Its words get their ids by
a join of the block's distinct words, so tokens themselves are never shuffled. Pairs are
counted exactly by sorted lists of each block's distinct ones. Longer n-grams need a
frequent triple at their beginning: blocks send hashed triples and get a bit for each
of them back, so only positions of frequent triples are sent as suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.store import Levels

#: Tokens of a block, entries of a task that counts n-grams, n-grams that are decoded at once.
BLOCK, COUNTED, DECODED = 1 << 21, 1 << 21, 1 << 16
#: Cells of the suffixes that are put out at once.
CELLS = 1 << 20
#: Suffixes are sorted in their block by so many terms.
SORTED = 16
_ODD = 0x9E3779B97F4A7C15


def pack(a: np.ndarray) -> bytes:
    """Integers, byte planes apart, compressed; negative ones take all planes."""
    width = 8 if a.min(initial=0) < 0 else max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width])
    made = planes.tobytes()
    return len(a).to_bytes(8, "little") + len(planes).to_bytes(1, "little") + pa.Codec("zstd", 1).compress(made, asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n, planes = int.from_bytes(b[:8], "little"), b[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        made = pa.Codec("zstd", 1).decompress(b[9:], n * planes, asbytes=True)
        out[:, :planes] = np.frombuffer(made, np.uint8).reshape(planes, n).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _batch(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def word_blocks(lines: DataFrame, empty_token: str = "drop", ids: bool = False) -> DataFrame:
    """``block, words, counts, codes``: a block's distinct words, the most frequent first, and its lines as their numbers from 1, each followed by 0.

    ``ids``: then ``docs, numbers`` too, the lines' identifiers (which must be whole numbers).
    """
    words = lines.select(tokenize(F.col("line"), empty_token).alias("words"), *(["doc_id", "line_no"] if ids else []))
    return list_blocks(words.where(F.size("words") > 0), ids)


def list_blocks(lists: DataFrame, ids: bool = False) -> DataFrame:
    """:func:`word_blocks` of ``words``, lists that are not empty, and of ``doc_id, line_no`` with ``ids``."""
    schema = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()), *((c, pa.binary()) for c in (("docs", "numbers") if ids else ()))])
    limit = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        keys: list[pa.RecordBatch] = []
        held = 0
        block = TaskContext.get().partitionId() << 33

        def out() -> pa.RecordBatch:
            found = pa.concat_arrays(words).dictionary_encode()
            codes = found.indices.to_numpy()
            counts = np.bincount(codes, minlength=len(found.dictionary))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(1, len(order) + 1)
            lines = np.concatenate(sizes)
            made = np.zeros(len(codes) + len(lines), np.int64)
            made[np.arange(len(codes)) + np.repeat(np.arange(len(lines)), lines)] = rank[codes]
            return _batch(schema, [block], [found.dictionary.take(pa.array(order)).to_pylist()], [counts[order]], [pack(made)], *([[pack(np.concatenate([k.column(c).to_numpy().astype(np.int64) for k in keys]))] for c in (1, 2)] if ids else []))

        for batch in batches:
            lists = batch.column(0)
            edges = lists.offsets.to_numpy()
            at = 0
            while at < len(lists):
                # Whole lines up to the limit, at least one.
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + limit - held, "right")) - 1)
                words.append(lists.values.slice(edges[at], edges[to] - edges[at]))
                sizes.append(np.diff(edges[at : to + 1]))
                if ids:
                    keys.append(batch.slice(at, to - at))
                held += int(edges[to] - edges[at])
                at = to
                if held >= limit or at < len(lists):
                    yield out()
                    block += 1
                    words.clear()
                    sizes.clear()
                    keys.clear()
                    held = 0
        if held:
            yield out()

    return lists.mapInArrow(run, "block long, words array<string>, counts array<long>, codes binary" + ", docs binary, numbers binary" * ids)


def decoded_lines(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id, line_no, tids`` of blocks with ``ids``, all of whose words are in the dictionary."""
    words = blocks.select("block", F.posexplode("words").alias("i", "word"))
    found = words.join(dictionary.select("word", "tid"), "word").groupBy("block").agg(F.collect_list(F.struct("i", "tid")).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, docs, numbers = (unpack(batch.column(c)[k].as_py()) for c in ("codes", "docs", "numbers"))
                names = batch.column("names")[k].values
                table = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
                table[names.field("i").to_numpy() + 1] = names.field("tid").to_numpy()
                ends = np.flatnonzero(codes == 0)
                edges = np.append(0, ends - np.arange(len(ends)))
                tids = table[codes[codes > 0]]
                for a in range(0, len(docs), 10_000):
                    b = min(len(docs), a + 10_000)
                    part = pa.ListArray.from_arrays(pa.array((edges[a : b + 1] - edges[a]).astype(np.int32)), pa.array(tids[edges[a] : edges[b]]))
                    yield pa.RecordBatch.from_arrays([pa.array(docs[a:b]), pa.array(numbers[a:b].astype(np.int32)), part], ["doc_id", "line_no", "tids"])

    return blocks.select("block", "codes", "docs", "numbers").join(found, "block").mapInArrow(run, "doc_id long, line_no int, tids array<int>")


def block_counts(blocks: DataFrame) -> DataFrame:
    """``word, count``."""
    each = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts")
    return each.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("count"))


def encoded_blocks(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``block, n, most, tids, names``: ids of the words in the dictionary; one 0 for anything between runs of them. ``names``: the words of the ids."""
    words = blocks.select("block", F.posexplode("words").alias("i", "word"))
    ids = words.join(dictionary.select("word", "tid"), "word").groupBy("block").agg(F.collect_list(F.struct("i", "tid", "word")).alias("names"))
    names = pa.list_(pa.struct([("tid", pa.int32()), ("word", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, codes, found = (batch.column(c)[k] for c in ("block", "codes", "names"))
                codes, found = unpack(codes.as_py()), found.values
                table = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
                tids = found.field("tid")
                table[found.field("i").to_numpy() + 1] = tids.to_numpy()
                codes = table[codes]
                kept = codes > 0
                kept[1:] |= codes[:-1] > 0
                codes = codes[kept]
                pairs = pa.StructArray.from_arrays([tids.cast(pa.int32()), found.field("word").cast(pa.string())], ["tid", "word"])
                lists = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs).cast(names)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([len(codes)]), pa.array([int(codes.max(initial=0))]), pa.array([pack(codes)]), lists], ["block", "n", "most", "tids", "names"])

    return blocks.select("block", "codes").join(ids, "block").mapInArrow(run, "block long, n long, most long, tids binary, names array<struct<tid:int,word:string>>")


def _keys(tids: np.ndarray, k: int, bits: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows of ``k`` terms, and their keys below ``2 ** bits``: exact and evenly spread for pairs, hashed for more."""
    whole = tids[: max(0, len(tids) - k + 1)] > 0
    for j in range(1, k):
        whole &= tids[j : j + len(whole)] > 0
    at = np.flatnonzero(whole)
    u = tids.astype(np.uint64)
    odd = np.uint64(_ODD)
    if k == 2:
        return at, ((u[at] * np.uint64(terms) + u[at + 1]) * odd) & np.uint64(2**bits - 1)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = (h + u[at + j]) * odd
        h ^= h >> np.uint64(31)
    return at, (h * odd) >> np.uint64(64 - bits)


def _sent(encoded: DataFrame, k: int, bits: int, terms: int, parts_bits: int) -> DataFrame:
    """``part, block, keys, counts``: sorted distinct keys of each block, by range."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tids in zip(batch.column("block").to_pylist(), batch.column("tids"), strict=True):
                keys, counts = np.unique(_keys(unpack(tids.as_py()), k, bits, terms)[1], return_counts=True)
                part = (keys >> np.uint64(bits - parts_bits)).astype(np.int64)
                edges = np.searchsorted(part, np.arange((1 << parts_bits) + 1))
                rows = [p for p in range(1 << parts_bits) if edges[p] < edges[p + 1]]
                mine = [keys[edges[p] : edges[p + 1]].astype(np.int64) for p in rows]
                yield _batch(schema, rows, [block] * len(rows), [pack(np.diff(x, prepend=0)) for x in mine], [pack(counts[edges[p] : edges[p + 1]]) for p in rows])

    return encoded.mapInArrow(run, "part int, block long, keys binary, counts binary")


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys and their sums; each row's places in them, and the rows' edges."""
    keys = [np.cumsum(unpack(b)) for b in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(b) for b in table.column("counts").to_pylist()])
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, weights=counts).astype(np.int64), inverse, list(np.cumsum([0, *map(len, keys)]))


def block_pairs(encoded: DataFrame, min_support: int, terms: int, tokens: int) -> DataFrame:
    """``gram, support`` of pairs with enough support. ``terms``: a number above all ids."""
    bits = max(8, (terms * terms).bit_length())
    undo = pow(_ODD, -1, 1 << bits)
    parts = min(bits, max(0, tokens // COUNTED).bit_length())

    def run(table: pa.Table) -> pa.Table:
        keys, sums, _, _ = _met(table)
        often = sums >= min_support
        pairs = (keys[often].astype(np.uint64) * np.uint64(undo)) & np.uint64(2**bits - 1)
        both = np.stack([pairs // np.uint64(terms), pairs % np.uint64(terms)], 1).astype(np.int32).reshape(-1)
        grams = pa.ListArray.from_arrays(pa.array(np.arange(len(pairs) + 1, dtype=np.int32) * 2), pa.array(both))
        return pa.table({"gram": grams, "support": pa.array(sums[often])})

    return _sent(encoded, 2, bits, terms, parts).groupBy("part").applyInArrow(run, "gram array<int>, support long")


def _cut(tids: np.ndarray, begins: np.ndarray, more: int, max_length: int) -> Iterator[pa.RecordBatch]:
    """``suffix, count`` of the places marked, up to ``more`` terms behind the first one not marked."""
    at = np.flatnonzero(begins)
    if not len(at):
        return
    stops = np.flatnonzero(~begins)
    length = stops[np.searchsorted(stops, at)] - at + more
    if max_length:
        length = np.minimum(length, max_length)
    padded = np.concatenate([tids, np.zeros(SORTED, np.int32)])
    width = min(SORTED, max_length or SORTED)
    heads = [np.where(j < length, padded[at + j], 0) for j in range(width)]
    order = np.lexsort(heads[::-1])
    at, length = at[order], length[order]
    counts = np.ones(len(at), np.int64)
    if max_length and max_length <= SORTED:  # equal ones are side by side
        new = np.ones(len(at), bool)
        new[1:] = np.logical_or.reduce([h[order][1:] != h[order][:-1] for h in heads])
        first = np.flatnonzero(new)
        counts, at, length = np.diff(np.append(first, len(at))), at[first], length[first]
    ends = np.cumsum(length)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
        n = length[a:b]
        edges = np.concatenate([[0], np.cumsum(n)])
        places = np.arange(edges[-1]) + np.repeat(at[a:b] - edges[:-1], n)
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(tids[places]))
        yield pa.RecordBatch.from_arrays([lists, pa.array(counts[a:b])], ["suffix", "count"])
        a = b


def all_suffixes(encoded: DataFrame, max_length: int) -> DataFrame:
    """``suffix, count``: distinct suffixes of the runs of frequent terms, cut to ``max_length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                tids = unpack(packed.as_py()).astype(np.int32)
                yield from _cut(tids, np.append(tids > 0, False), 0, max_length)

    return encoded.select("tids").mapInArrow(run, "suffix array<int>, count long").groupBy("suffix").agg(F.sum("count").alias("count"))


def block_suffixes(encoded: DataFrame, min_support: int, max_length: int, tokens: int) -> DataFrame:
    """``suffix, count`` of the places where a triple with enough support begins, cut where the next one has not and at ``max_length`` (0: not cut).

    Triples are told apart by hashed keys: one that is taken for frequent by mistake only
    makes suffixes longer.
    """
    bits = min(62, max(16, tokens.bit_length() + 6))
    parts = max(0, tokens // COUNTED).bit_length()

    def count(table: pa.Table) -> pa.Table:
        _, sums, inverse, edges = _met(table)
        often = sums[inverse] >= min_support
        bitmaps = [np.packbits(often[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "bits": pa.array(bitmaps, pa.binary())})

    replies = _sent(encoded, 3, bits, 0, parts).groupBy("part").applyInArrow(count, "block long, part int, bits binary")
    replies = replies.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("replies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tids, reply in zip(batch.column("tids"), batch.column("replies").to_pylist(), strict=True):
                tids = unpack(tids.as_py())
                at, keys = _keys(tids, 3, bits, 0)
                keys, inverse = np.unique(keys, return_inverse=True)
                sizes = np.bincount((keys >> np.uint64(bits - parts)).astype(np.int64), minlength=1 << parts)
                often = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=sizes[r["part"]]) for r in reply])
                begins = np.zeros(len(tids) + 1, bool)
                begins[at[often[inverse] > 0]] = True
                yield from _cut(tids.astype(np.int32), begins, 2, max_length)

    return encoded.select("block", "tids").join(replies, "block").mapInArrow(run, "suffix array<int>, count long")


def block_ngrams(encoded: DataFrame, dictionary: DataFrame, min_support: int, max_length: int, levels: Levels) -> DataFrame:
    """``gram, support`` of n-grams with enough support, written to ``levels``; ``dictionary`` has the frequent words."""
    from .suffix import stack_ngrams

    tokens = encoded.agg(F.sum("n")).first()[0] or 0
    terms = (dictionary.agg(F.max("tid")).first()[0] or 0) + 1
    found = dictionary.select(F.array("tid").alias("gram"), F.col("count").alias("support"))
    if max_length != 1 and tokens:
        found = found.unionByName(block_pairs(encoded, min_support, terms, tokens))
    if max_length not in (1, 2) and tokens:
        longer = stack_ngrams(block_suffixes(encoded, min_support, max_length, tokens), min_support)
        found = found.unionByName(longer.where(F.size("gram") > 2))
    return levels.settle(found, "grams")


def decode_blocks(grams: DataFrame, dictionary: DataFrame, levels: Levels) -> DataFrame:
    """``ngram, n, support``: n-grams as text; the words of some thousand n-grams are looked up at once, each once."""
    held = pa.schema([("chunk", pa.int64()), ("tids", pa.list_(pa.int32())), ("places", pa.binary()), ("sizes", pa.binary()), ("supports", pa.binary())])
    limit = DECODED

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = cells = 0

        def out() -> pa.RecordBatch:
            terms, sizes, supports = (np.concatenate(x) for x in zip(*parts, strict=True))
            tids, places = np.unique(terms, return_inverse=True)
            return _batch(held, [chunk], [tids], [pack(places)], [pack(sizes)], [pack(supports)])

        for batch in batches:
            lists = batch.column(0)
            edges = lists.offsets.to_numpy()
            a = 0
            while a < len(lists):
                b = max(a + 1, min(a + limit - rows, int(np.searchsorted(edges, edges[a] + CELLS - cells, "right")) - 1))
                parts.append((lists.values.slice(edges[a], edges[b] - edges[a]).to_numpy(), np.diff(edges[a : b + 1]), batch.column(1).slice(a, b - a).to_numpy()))
                rows, cells, a = rows + b - a, cells + int(edges[b] - edges[a]), b
                if rows >= limit or cells >= CELLS or a < len(lists):
                    yield out()
                    parts.clear()
                    chunk += 1
                    rows = cells = 0
        if parts:
            yield out()

    chunks = levels.settle(grams.select("gram", "support").mapInArrow(gather, "chunk long, tids array<int>, places binary, sizes binary, supports binary"), "chunks")
    terms = chunks.select("chunk", F.posexplode("tids").alias("i", "tid")).join(dictionary.select("tid", "word"), "tid", "left")
    word = F.coalesce("word", F.raise_error(F.concat(F.lit("unknown term id "), F.col("tid").cast("string"))).cast("string"))
    words = terms.groupBy("chunk").agg(F.collect_list(F.struct("i", word.alias("word"))).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                places, sizes, supports = (unpack(batch.column(c)[k].as_py()) for c in ("places", "sizes", "supports"))
                found = batch.column("words")[k].values
                order = np.argsort(found.field("i").to_numpy())
                names = found.field("word").take(pa.array(order)).take(pa.array(places))
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), names), " ")
                for a in range(0, len(sizes), 10_000):
                    yield pa.RecordBatch.from_arrays([texts.slice(a, 10_000), pa.array(sizes[a : a + 10_000].astype(np.int32)), pa.array(supports[a : a + 10_000])], ["ngram", "n", "support"])

    return chunks.select("chunk", "places", "sizes", "supports").join(words, "chunk").mapInArrow(run, "ngram string, n int, support long")
