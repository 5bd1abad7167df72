"""N-grams of blocks, one term longer at a time, without sending any n-gram.

At each length a block sends the distinct keys of its n-grams with their counts, as a
sorted list, and gets the number and the support of the frequent ones back. A key is the
pair of the numbers of the two n-grams that are one shorter, so it is exact. One of the
blocks that hold an n-gram owns it and puts it out from its own words; tables hold only
places, lengths and supports.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Levels
from ..types import NGramType
from . import blocks
from .blocks import _batch, _met, pack, unpack

#: A block's places with their n-grams' numbers and supports; what it puts out; what it says is not maximal.
STATE, OUT, LONGER = 0, 1, 2
_ROW = "kind int, block long, n long, top long, a binary, b binary, c binary, d binary, e binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("top", pa.int64()), *((c, pa.binary()) for c in "abcde")])
_ODD = 0x9E3779B97F4A7C15
#: Up to so many tokens, shuffle files may stay until the end.
SMALL = 1 << 24
#: Rectangles that are spread at once.
RECTANGLES = 1 << 12


def _row(kind: int, block: int, *arrays: np.ndarray, top: int = 0, n: int | None = None) -> pa.RecordBatch:
    cells = [pack(a) for a in arrays]
    return _batch(_SCHEMA, [kind], [block], [len(arrays[0]) if n is None else n], [top], *([x] for x in cells + [pack(arrays[0][:0])] * (5 - len(cells))))


def _terms(tids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of terms, their distinct keys below ``2 ** bits`` in order, and which of them each has."""
    at = np.flatnonzero(tids)
    mine = tids[at]
    used = np.flatnonzero(np.bincount(mine))
    keys = (used.astype(np.uint64) * np.uint64(_ODD)) & np.uint64(2**bits - 1)
    order = np.argsort(keys)
    rank = np.zeros(int(mine.max(initial=0)) + 1, np.int64)
    rank[used[order]] = np.arange(len(used))
    return at, keys[order], rank[mine]


def _singles(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, which term each has, and the terms' numbers and supports, of a state that holds only these (0: not frequent) beside the terms."""
    at, _, index = _terms(unpack(row["tids"]), bits)
    ids, supports = unpack(row["c"]), unpack(row["d"])
    often = ids > 0
    kept = often[index]
    return at[kept], (np.cumsum(often) - 1)[index[kept]], ids[often], supports[often]


def _candidates(at: np.ndarray, ids: np.ndarray, ended: np.ndarray | None, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places go on, and their keys below ``2 ** bits``; those ``ended`` go on by themselves."""
    after = np.zeros(len(at), np.int64)
    if len(at) > 1:
        near = at[1:] == at[:-1] + 1
        after[:-1][near] = ids[1:][near]
    goes = after > 0
    if ended is not None:
        goes |= ended
        after[ended] = 0
    which = np.flatnonzero(goes)
    keys = ids[which].astype(np.uint64) * np.uint64(most) + after[which].astype(np.uint64)
    return which, (keys * np.uint64(_ODD)) & np.uint64(2**bits - 1)


def _replies(sent: DataFrame, min_support: int, part_bits: int) -> DataFrame:
    """``block, replies``: for each key of a block whether it is frequent; of those that are, number, support, and whether the block owns it."""

    def count(table: pa.Table) -> pa.Table:
        found, sums, inverse, edges = _met(table)
        part = table.column("part")[0].as_py()
        often = sums >= min_support
        number = np.cumsum(often)
        first = _marked(len(inverse), _first(inverse, len(found)))
        rows = [(inverse[a:b], first[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        bits = [np.packbits(often[i]).tobytes() for i, _ in rows]
        ids = [pack(np.diff(number[i[often[i]]], prepend=0)) for i, _ in rows]
        supports = [pack(sums[i[often[i]]] * 2 + f[often[i]]) for i, f in rows]
        return pa.table({"block": table.column("block"), "part": pa.array([part] * len(rows), pa.int32()), "bits": pa.array(bits, pa.binary()), "ids": pa.array(ids, pa.binary()), "supports": pa.array(supports, pa.binary())})

    replies = sent.groupBy("part").applyInArrow(count, "block long, part int, bits binary, ids binary, supports binary")
    return replies.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "bits", "ids", "supports"))).alias("replies"))


def _parted(keys: np.ndarray, bits: int, part_bits: int) -> np.ndarray:
    return np.searchsorted((keys >> np.uint64(bits - part_bits)).astype(np.int64), np.arange((1 << part_bits) + 1))


def _send(block: int, keys: np.ndarray, bits: int, part_bits: int, schema: pa.Schema) -> pa.RecordBatch:
    keys, counts = np.unique(keys, return_counts=True)
    edges = _parted(keys, bits, part_bits)
    rows = [p for p in range(1 << part_bits) if edges[p] < edges[p + 1]]
    mine = [keys[edges[p] : edges[p + 1]].astype(np.int64) for p in rows]
    return _batch(schema, rows, [block] * len(rows), [pack(np.diff(x, prepend=0)) for x in mine], [pack(counts[edges[p] : edges[p + 1]]) for p in rows])


def _answer(keys: np.ndarray, replies: list[dict] | None, bits: int, part_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct key the number and twice the support, and 1 if the block owns it; 0 if it is not frequent."""
    edges = _parted(keys, bits, part_bits)
    ids, supports = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for r in replies or []:
        a, b = edges[r["part"]], edges[r["part"] + 1]
        often = a + np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a))
        ids[often] = (np.cumsum(unpack(r["ids"])) << part_bits) | r["part"]
        supports[often] = unpack(r["supports"])
    return ids, supports


def _first(index: np.ndarray, size: int) -> np.ndarray:
    """Where each number below ``size`` stands first."""
    out = np.zeros(size, np.int64)
    out[index[::-1]] = np.arange(len(index))[::-1]
    return out


def _marked(size: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(size, bool)
    out[at] = True
    return out


def mine_levels(encoded: DataFrame, min_support: int, max_length: int, kind: NGramType, levels: Levels, suffixes: bool = False) -> list[tuple[int, str]]:
    """Writes, for each length, the tables of what blocks put out; returns lengths and tables' names.

    ``suffixes``: instead of n-grams, the distinct runs of terms cut to ``max_length`` with
    their counts: a place goes on while its beginning occurs twice, and alone it is put out.
    """
    kind = NGramType(kind)
    sent_schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    least = 2 if suffixes else min_support
    tokens, most = encoded.agg(F.sum("n"), F.max("most")).first()
    if not tokens:
        return []
    most, places = most + 1, tokens
    state, made, n, first_bits = None, [], 0, max(12, most.bit_length())
    write = partial(levels.settle, key="block") if tokens > SMALL else levels.keep
    while places and (not max_length or n < max_length):
        bits = max(12, (most * most).bit_length()) if n else first_bits
        if bits > 63:
            raise ValueError("too many n-grams for exact keys")
        part_bits = min(bits, max(0, places // blocks.COUNTED).bit_length())
        length, last = n, bool(max_length) and n + 1 == max_length

        def begun(row: dict, length=length, most=most, bits=bits) -> tuple:
            """Terms; places, which of the block's n-grams each has, their numbers and supports; where runs end; which places go on, and their keys."""
            tids = unpack(row["tids"]) if length == 0 or suffixes else None
            if length == 0:
                at, keys, index = _terms(tids, bits)
                return tids, at, None, None, None, None, np.arange(len(at)), keys[index]
            if length == 1:
                at, index, ids, supports = _singles(row, first_bits)
            else:
                at, index, ids, supports = np.cumsum(unpack(row["a"])), unpack(row["b"]), unpack(row["c"]), unpack(row["d"])
            ended = np.append(tids, 0)[at + length] == 0 if suffixes else None
            return tids, at, index, ids, supports, ended, *_candidates(at, ids[index], ended, most, bits)

        def send(batches: Iterator[pa.RecordBatch], begun=begun, bits=bits, part_bits=part_bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    yield _send(row["block"], begun(row)[-1], bits, part_bits, sent_schema)

        def step(batches: Iterator[pa.RecordBatch], begun=begun, bits=bits, part_bits=part_bits, length=length, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    block = row["block"]
                    tids, at, index, ids, supports, ended, which, keys = begun(row)
                    found, inverse = np.unique(keys, return_inverse=True)
                    numbers, sums = _answer(found, row["replies"], bits, part_bits)
                    more, longer = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    more[which], longer[which] = numbers[inverse], sums[inverse]
                    goes = more > 0
                    begins = which[_first(inverse, len(found))[sums & 1 > 0]]  # of longer ones that the block owns
                    if suffixes:
                        over = ended if length else np.zeros(len(at), bool)
                        done = ~goes  # alone
                        given = _marked(len(at), begins) & over
                        goes = goes & ~over
                        put = done | given
                        count = np.where(given, longer >> 1, 1)
                        run = np.flatnonzero(np.append(tids, 0) == 0)
                        size = run[np.searchsorted(run, at)] - at
                        size = np.minimum(size, max_length) if max_length else size
                        yield _row(OUT, block, np.diff(at[put], prepend=0), size[put], count[put])
                    elif length:
                        right, left = longer >> 1, np.zeros(len(at), np.int64)
                        if len(at) > 1:
                            near = at[1:] == at[:-1] + 1
                            left[1:][near] = right[:-1][near]
                        put = _marked(len(at), _first(index, len(ids))[supports & 1 > 0])
                        ids, supports = ids[index], supports[index] >> 1
                        if kind is not NGramType.ALL:
                            put &= np.maximum(left, right) < supports
                        if kind is NGramType.MAXIMAL:
                            put &= np.maximum(left, right) == 0
                            # Its owner says of an n-gram that its two parts are not maximal.
                            v = begins
                            parts = np.unique(np.concatenate([ids[v][right[v] < supports[v]], ids[v + 1][right[v] < supports[v + 1]]]))
                            yield _row(LONGER, block, np.diff(parts, prepend=0))
                        yield _row(OUT, block, np.diff(at[put], prepend=0), np.full(int(put.sum()), length), supports[put], ids[put])
                    if last:
                        put = np.flatnonzero(_marked(len(at), begins) & goes)
                        yield _row(OUT, block, np.diff(at[put], prepend=0), np.full(len(put), length + 1), longer[put] >> 1, np.zeros(len(put), np.int64))
                    elif not length and goes.any():  # places and their terms are those of the block
                        yield _row(STATE, block, at[:0], at[:0], numbers, sums, top=int(numbers.max()), n=int(goes.sum()))
                    elif goes.any():
                        some = np.zeros(len(found), bool)
                        some[inverse[goes[which]]] = True
                        index = np.zeros(len(at), np.int64)
                        index[which] = (np.cumsum(some) - 1)[inverse]
                        yield _row(STATE, block, np.diff(at[goes], prepend=0), index[goes], numbers[some], sums[some], top=int(numbers[some].max()))

        held = encoded.select("block", "tids") if state is None else state.select("block", *"abcd")
        if n == 1 or suffixes and n:
            held = held.join(encoded.select("block", "tids"), "block")
        replies = _replies(held.mapInArrow(send, "part int, block long, keys binary, counts binary"), least, part_bits)
        name = f"level-{n + 1}"
        table = write(held.join(replies, "block", "left").mapInArrow(step, _ROW), name, by="kind")
        if n:
            levels.drop(f"level-{n}/kind={STATE}")
        made.append((n + 1, name))
        n += 1
        state = table.where(F.col("kind") == STATE)
        places, top = state.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("top")).first()
        most = (top or 0) + 1
    return made


def _spread(at: np.ndarray, size: np.ndarray, support: np.ndarray, starts: np.ndarray, stops: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, lengths and supports of rectangles: the first n-gram of each, ``starts`` places from there on, and ``stops`` ends of each."""
    # A row for each start.
    first = np.cumsum(starts) - starts
    move = np.arange(int(starts.sum())) - np.repeat(first, starts)
    at, size, support, stops = np.repeat(at, starts) + move, np.repeat(size, starts) - move, np.repeat(support, starts), np.repeat(stops, starts)
    ends = np.cumsum(stops * size + stops * (stops - 1) // 2)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + cells, "right")))
        n = stops[a:b]
        more = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(at[a:b], n), np.repeat(size[a:b], n) + more, np.repeat(support[a:b], n)
        a = b


def put_out(encoded: DataFrame, made: list[tuple[int, str]], kind: NGramType, levels: Levels, decoded: bool = True, rectangles: bool = False) -> DataFrame:
    """``ngram, n, support``, or ``gram, support`` with term ids: what blocks put out, each from its own words. ``rectangles``: they put out many n-grams as one."""
    spark = levels.spark
    tables = None
    for n, name in made:
        rows = spark.read.schema(_ROW).parquet(f"{levels.path}/{name}")
        rows = rows.select(F.lit(n).alias("level"), "kind", "block", "n", *"abcde")
        tables = rows if tables is None else tables.unionByName(rows)
    schema = "ngram string, n int, support long" if decoded else "gram array<int>, support long"
    if tables is None:
        return spark.createDataFrame([], schema)
    outs = tables.where((F.col("kind") == OUT) & (F.col("n") > 0))
    if NGramType(kind) is NGramType.MAXIMAL:
        outs = _maximal(outs, tables.where((F.col("kind") == LONGER) & (F.col("n") > 0)), levels)
    outs = outs.groupBy("block").agg(F.collect_list(F.struct(*("abcde" if rectangles else "abc"))).alias("outs"))
    cells, some = blocks.CELLS, RECTANGLES

    def pieces(*given: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(0, len(given[0]), some):
            yield from _spread(*(x[a : a + some] for x in given), cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tids = unpack(batch.column("tids")[k].as_py()).astype(np.int32)
                if decoded:
                    own = batch.column("names")[k].values
                    index = np.zeros(int(tids.max(initial=0)) + 1, np.int64)
                    index[own.field("tid").to_numpy()] = np.arange(len(own))
                    words = own.field("word")
                for out in batch.column("outs")[k].as_py():
                    given = np.cumsum(unpack(out["a"])), *(unpack(out[c]) for c in list(out)[1:])
                    for at, size, support in pieces(*given) if rectangles else [given]:
                        ends = np.cumsum(size)
                        a = 0
                        while a < len(at):
                            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + cells, "right")))
                            edges = np.concatenate([[0], np.cumsum(size[a:b])])
                            terms = tids[np.arange(edges[-1]) + np.repeat(at[a:b] - edges[:-1], size[a:b])]
                            values = words.take(pa.array(index[terms])) if decoded else pa.array(terms)
                            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)
                            if not decoded:
                                yield pa.RecordBatch.from_arrays([lists, pa.array(support[a:b])], ["gram", "support"])
                            else:
                                texts = pc.binary_join(lists, " ")
                                for c in range(0, b - a, 10_000):
                                    yield pa.RecordBatch.from_arrays([texts.slice(c, 10_000), pa.array(size[a:b][c : c + 10_000].astype(np.int32)), pa.array(support[a:b][c : c + 10_000])], ["ngram", "n", "support"])
                            a = b

    return encoded.select("block", "tids", *(["names"] if decoded else [])).join(outs, "block").mapInArrow(run, schema)


def _maximal(outs: DataFrame, longer: DataFrame, levels: Levels) -> DataFrame:
    """Without the n-grams that another block has extended: numbers are met by their level."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, packed in zip(batch.column("level").to_pylist(), batch.column("a").to_pylist(), strict=True):
                ids = np.cumsum(unpack(packed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), level, np.int32)), pa.array(ids)], ["level", "id"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, size, support, ids = np.cumsum(unpack(row["a"])), unpack(row["b"]), unpack(row["c"]), unpack(row["d"])
                level = np.full(len(at), row["level"], np.int32)  # number 0 is no n-gram's: nothing can take it away
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(ids), pa.array(np.full(len(at), row["block"])), pa.array(at), pa.array(size.astype(np.int32)), pa.array(support)], ["level", "id", "block", "at", "size", "support"])

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, size, support = (table.column(c).to_numpy() for c in ("at", "size", "support"))
        return pa.table({"block": table.column("block").slice(0, 1), "a": [pack(np.diff(at, prepend=0))], "b": [pack(size.astype(np.int64))], "c": [pack(support)]})

    met = outs.select("level", "block", *"abcd").mapInArrow(places, "level int, id long, block long, at long, size int, support long")
    left = met.join(longer.select("level", "a").mapInArrow(numbers, "level int, id long").distinct(), ["level", "id"], "left_anti")
    return levels.settle(left.groupBy("block").applyInArrow(gather, "block long, a binary, b binary, c binary"), "maximal")
