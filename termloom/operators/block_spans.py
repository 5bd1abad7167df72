"""N-grams of blocks without a limit on their length, in few rounds.

A run of frequent terms is a sequence of items: spans of the text with a number and a
support each, at first its terms. Each round counts the pairs of adjacent items as
:mod:`block_levels` does. Items that always stand side by side (equal supports, also of
the pair) are joined to one; the frequent pairs of what is left are the next items. So a
text with many copies is one item after some rounds, however long it is.

All occurrences of an n-gram are within items at the same place, and a term before or
after an item tells which item it belongs to. An item is therefore closed if neither
pair with its neighbours has its support, and maximal if it has no frequent pair. N-grams
that lie in an item but in none of the items that it is made of have the item's support:
they are rectangles of starts and ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Levels
from ..types import NGramType
from . import blocks
from .block_levels import _ODD, _ROW, LONGER, OUT, SMALL, STATE, _answer, _first, _marked, _parted, _replies, _row, _send, _singles, _terms
from .blocks import _batch, pack, unpack

#: So many items are worked off by one task, without further exchanges.
FINISHED = 1 << 20
#: After this round, and then each time that their number has doubled, it is tried to part more items into tasks that share none.
PARTED = 6


class _Items:
    """Items in the order of the text: where they begin, whether each overlaps or touches the one before, and which it is; of distinct ones the number, twice the support (and 1 if owned), and the length."""

    def __init__(self, at: np.ndarray, linked: np.ndarray, index: np.ndarray, ids: np.ndarray, sums: np.ndarray, sizes: np.ndarray):
        self.at, self.linked, self.index, self.ids, self.sums, self.sizes = at, linked, index, ids, sums, sizes

    @classmethod
    def singles(cls, row: dict, bits: int) -> _Items:
        """Terms, of the state after the first round."""
        at, index, ids, sums = _singles(row, bits)
        return cls(at, np.append(False, np.diff(at) == 1)[: len(at)], index, ids, sums, np.ones(len(ids), np.int64))

    @classmethod
    def read(cls, row: dict) -> _Items:
        b = unpack(row["b"])
        return cls(np.cumsum(unpack(row["a"])), b & 1 > 0, b >> 1, *(unpack(row[c]) for c in "cde"))

    def row(self, block: int) -> pa.RecordBatch:
        return _row(STATE, block, np.diff(self.at, prepend=0), self.index * 2 + self.linked, self.ids, self.sums, self.sizes, top=int(self.ids.max()))

    def pairs(self, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Items that have one behind them, and the pairs' keys."""
        which = np.flatnonzero(self.linked[1:])
        one, two = (self.ids[self.index[which + k]].astype(np.uint64) for k in (0, 1))
        return which, ((one * np.uint64(most) + two) * np.uint64(_ODD)) & np.uint64(2**bits - 1)

    def grow(self, kind: NGramType, more: np.ndarray, longer: np.ndarray, begin: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, _Items]:
        """What is put out (items, supports, first lengths, and how many starts and ends from there), numbers that are not maximal, which items the next ones begin with, and these.

        ``more, longer``: of each item's pair with the next one the number and twice the support (and 1 if owned), 0 if it is not frequent.
        """
        n = len(self.at)
        support, right = (self.sums >> 1)[self.index], longer >> 1
        end = self.at + self.sizes[self.index]
        same = np.zeros(n, bool)
        same[:-1] = (more[:-1] > 0) & (support[:-1] == support[1:]) & (right[:-1] == support[:-1])
        first = np.flatnonzero(np.append(True, ~same[:-1]))
        last = np.append(first[1:], n) - 1
        before, behind = np.append(0, right[:-1])[first], right[last]
        owned = _marked(n, _first(self.index, len(self.ids))[self.sums & 1 > 0])
        # The next items: pairs of joined ones.
        pair = np.flatnonzero(more[last] > 0)
        begins, ends, meet = first[pair], last[pair + 1], last[pair]
        ids, at, index = np.unique(more[meet], return_index=True, return_inverse=True)
        linked = np.append(False, np.diff(pair) == 1) if len(pair) else np.zeros(0, bool)
        sizes = end[ends] - self.at[begins]
        grown = _Items(self.at[begins], linked, index, ids, longer[meet][at], sizes[at])
        lost = np.zeros(0, np.int64)
        if kind is NGramType.ALL:
            # Where joined items meet, and where the two of an owned pair meet.
            k = np.flatnonzero(same)
            of = np.searchsorted(first, k, "right") - 1
            k, of = k[owned[first[of]]], of[owned[first[of]]]
            mine = at[grown.sums & 1 > 0]
            i, j = begins[mine], meet[mine]
            put = [(k, support[k], end[k] + 1 - self.at[k], self.at[k + 1] - self.at[k], end[last[of]] - end[k]), (i, right[j], end[j] + 1 - self.at[i], self.at[j + 1] - self.at[i], end[ends[mine]] - end[j])]
            if begin:
                single = np.flatnonzero(owned)
                put.append((single, support[single], *[np.ones(len(single), np.int64)] * 3))
            return tuple(np.concatenate(x) for x in zip(*put, strict=True)), lost, begins, grown
        if kind is NGramType.CLOSED:
            put = owned[first] & (np.maximum(before, behind) < support[first])
        else:
            goes_on = _marked(len(self.ids), self.index[first[(before > 0) | (behind > 0)]])
            put = owned[first] & ~goes_on[self.index[first]]
            # The owner of a pair says of its two parts that they are not maximal, where that is not seen everywhere.
            mine = at[grown.sums & 1 > 0]
            i, j = begins[mine], meet[mine]
            lost = np.unique(self.ids[self.index[np.concatenate([i[right[j] < support[i]], (j + 1)[right[j] < support[j + 1]]])]])
        a, b = first[put], last[put]
        one = np.ones(len(a), np.int64)
        return (a, support[a], end[b] - self.at[a], one, one), lost, begins, grown


def _out(block: int, items: _Items, put: tuple[np.ndarray, ...], kind: NGramType, known: bool = False) -> pa.RecordBatch:
    """``known``: an n-gram is surely maximal, and needs no number."""
    which, support, size, starts, stops = put
    order = np.argsort(items.at[which], kind="stable")
    which, support, size, starts, stops = (x[order] for x in (which, support, size, starts, stops))
    at = np.diff(items.at[which], prepend=0)
    if kind is NGramType.ALL:
        return _row(OUT, block, at, size, support, starts, stops)
    return _row(OUT, block, at, size, support, np.zeros(len(at), np.int64) if known else items.ids[items.index[which]])


def mine_spans(encoded: DataFrame, min_support: int, kind: NGramType, levels: Levels) -> list[tuple[int, str]]:
    """Writes, for each round, the tables of what blocks put out; returns rounds and tables' names. For ALL they hold rectangles."""
    kind = NGramType(kind)
    tokens, most = encoded.agg(F.sum("n"), F.max("most")).first()
    if not tokens:
        return []
    sent = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    most, places, state, made, n, tried = most + 1, tokens, None, [], 0, PARTED
    alone, first_bits, bare = None, max(12, most.bit_length()), tokens > FINISHED
    while places and (not n or places > FINISHED or bare and n == 1):
        if n == tried:
            tried *= 2
            if (alone := _parted_items(state, most, places, levels, n)) is not None:
                break
        write = partial(levels.settle, key="block") if places > SMALL else levels.settle if tokens > SMALL and n % 8 == 0 else levels.keep
        bits = max(12, (most * most).bit_length()) if n else first_bits
        if bits > 63:
            raise ValueError("too many n-grams for exact keys")
        part_bits = min(bits, max(0, places // blocks.COUNTED).bit_length())

        def begun(row: dict, n=n, most=most, bits=bits) -> tuple:
            if n:
                items = _Items.singles(row, first_bits) if bare and n == 1 else _Items.read(row)
                return items, *items.pairs(most, bits)
            at, keys, index = _terms(unpack(row["tids"]), bits)
            return None, at, keys[index]

        def send(batches: Iterator[pa.RecordBatch], begun=begun, bits=bits, part_bits=part_bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    yield _send(row["block"], begun(row)[-1], bits, part_bits, sent)

        def step(batches: Iterator[pa.RecordBatch], n=n, begun=begun, bits=bits, part_bits=part_bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    items, which, keys = begun(row)
                    found, inverse = np.unique(keys, return_inverse=True)
                    ids, sums = _answer(found, row["replies"], bits, part_bits)
                    if not n:
                        often = ids > 0
                        if bare:
                            if often.any():  # places and their terms are those of the block
                                yield _row(STATE, row["block"], which[:0], which[:0], ids, sums, top=int(ids.max()), n=int(often[inverse].sum()))
                            continue
                        which, index = which[often[inverse]], (np.cumsum(often) - 1)[inverse][often[inverse]]
                        linked = np.append(False, np.diff(which) == 1)[: len(which)]
                        grown = _Items(which, linked, index, ids[often], sums[often], np.ones(int(often.sum()), np.int64))
                    else:
                        more, longer = np.zeros(len(items.at), np.int64), np.zeros(len(items.at), np.int64)
                        more[which], longer[which] = ids[inverse], sums[inverse]
                        put, lost, _, grown = items.grow(kind, more, longer, n == 1)
                        yield _out(row["block"], items, put, kind)
                        if kind is NGramType.MAXIMAL:
                            yield _row(LONGER, row["block"], np.diff(lost, prepend=0))
                    if len(grown.at):
                        yield grown.row(row["block"])

        held = encoded.select("block", "tids") if state is None else state.select("block", *"abcde")
        if bare and n == 1:
            held = held.join(encoded.select("block", "tids"), "block")
        replies = _replies(held.mapInArrow(send, "part int, block long, keys binary, counts binary"), min_support, part_bits)
        table = write(held.join(replies, "block", "left").mapInArrow(step, _ROW), f"round-{n}", by="kind")
        if n:
            levels.drop(f"round-{n - 1}/kind={STATE}")
            made.append((n, f"round-{n}"))
        state = table.where(F.col("kind") == STATE)
        places, top = state.agg(F.coalesce(F.sum(F.col("n")), F.lit(0)), F.max("top")).first()
        most = (top or 0) + 1
        n += 1
    if places:
        alone = state.select("block", *"abcde").repartition(1) if alone is None else alone
        levels.keep(alone.mapInArrow(_finish(kind, min_support, n == 1), _ROW), f"round-{n}", by="kind")
        levels.drop(f"round-{n - 1}/kind={STATE}")
        made.append((n, f"round-{n}"))
    return made


def _chains(items: _Items, labels: np.ndarray) -> np.ndarray:
    """The least label of each item's chain of linked items. ``labels``: of the distinct items."""
    begins = np.flatnonzero(~items.linked)
    return np.repeat(np.minimum.reduceat(labels[items.index], begins), np.diff(np.append(begins, len(items.linked))))


def _parted_items(state: DataFrame, most: int, places: int, levels: Levels, n: int) -> DataFrame | None:
    """The items so that those of a partition share none with another's; None if they hang together too much.

    Chains that hold the same item get the same label, the least number of an item that is
    found from one to the other.
    """
    bits = max(12, most.bit_length())
    part_bits = min(bits, max(0, places // blocks.COUNTED).bit_length())
    sent = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("labels", pa.binary())])
    limit = FINISHED

    def read(row: dict) -> tuple[_Items, np.ndarray, np.ndarray]:
        """Items, their order by key, and labels: the least in the block."""
        items = _Items.read(row)
        keys = (items.ids.astype(np.uint64) * np.uint64(_ODD)) & np.uint64(2**bits - 1)
        labels = items.ids.copy()
        if row.get("replies"):
            order, edges = np.argsort(keys), _parted(np.sort(keys), bits, part_bits)
            for r in row["replies"]:
                labels[order[edges[r["part"]] : edges[r["part"] + 1]]] = unpack(r["labels"])
        while True:
            new = labels.copy()
            np.minimum.at(new, items.index, _chains(items, labels))
            if (new == labels).all():
                return items, keys, labels
            labels = new

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                _, keys, labels = read(row)
                order = np.argsort(keys)
                keys, labels = keys[order], labels[order]
                edges = _parted(keys, bits, part_bits)
                some = [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
                yield _batch(sent, [p for p, _, _ in some], [row["block"]] * len(some), [pack(np.diff(keys[a:b].astype(np.int64), prepend=0)) for _, a, b in some], [pack(labels[a:b]) for _, a, b in some])

    def meet(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(b)) for b in table.column("keys").to_pylist()]
        given = np.concatenate([unpack(b) for b in table.column("labels").to_pylist()])
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        least = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, given)
        edges, labels = np.cumsum([0, *map(len, keys)]), least[inverse]
        changed = [int((labels[a:b] != given[a:b]).sum()) for a, b in zip(edges, edges[1:], strict=False)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "labels": pa.array([pack(labels[a:b]) for a, b in zip(edges, edges[1:], strict=False)], pa.binary()), "changed": pa.array(changed, pa.int64())})

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                items, _, labels = read(batch.slice(k, 1).to_pylist()[0])
                found, counts = np.unique(labels[items.index], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["label", "n"])

    def split(batches: Iterator[pa.RecordBatch], tasks: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                items, _, labels = read(row)
                mixed = (labels.astype(np.uint64) * np.uint64(_ODD)) >> np.uint64(33)
                bucket = (mixed % np.uint64(tasks)).astype(np.int64)[items.index]
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(tasks + 1))
                for b in range(tasks):
                    at = order[edges[b] : edges[b + 1]]
                    if len(at):
                        used, index = np.unique(items.index[at], return_inverse=True)
                        part = _Items(items.at[at], items.linked[at], index, items.ids[used], items.sums[used], items.sizes[used])
                        yield pa.RecordBatch.from_arrays([pa.array([b]), *part.row(row["block"]).select(["block", *"abcde"]).columns], ["bucket", "block", *"abcde"])

    held, base = None, state.select("block", *"abcde")
    for k in range(10):
        now = base if held is None else base.join(held, "block")
        met = now.mapInArrow(send, "part int, block long, keys binary, labels binary").groupBy("part").applyInArrow(meet, "block long, part int, labels binary, changed long")
        held = levels.keep(met.groupBy("block").agg(F.collect_list(F.struct("part", "labels")).alias("replies"), F.sum("changed").alias("changed")), f"labels-{n}-{k}")
        changed = held.agg(F.sum("changed")).first()[0]
        held = held.select("block", "replies")
        if k:
            levels.drop(f"labels-{n}-{k - 1}")
        if not changed:
            break
    else:
        return None
    now = base.join(held, "block")
    if now.mapInArrow(sizes, "label long, n long").groupBy("label").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > limit:
        return None
    tasks = -(-places * 4 // limit)
    parts = now.mapInArrow(lambda batches: split(batches, tasks), "bucket long, block long, a binary, b binary, c binary, d binary, e binary")
    return parts.repartition(tasks, "bucket").select("block", *"abcde")


def _finish(kind: NGramType, min_support: int, begin: bool):
    """All further rounds of the items of all blocks."""
    limit = FINISHED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = [], []
        for batch in batches:
            for row in batch.to_pylist():
                names.append(row["block"])
                parts.append(_Items.read(row))
        if not parts:
            return
        home = np.repeat(np.arange(len(parts)), [len(p.at) for p in parts])
        every, at, index = np.unique(np.concatenate([p.ids[p.index] for p in parts]), return_index=True, return_inverse=True)
        sums, sizes = (np.concatenate([x[p.index] for p in parts for x in [getattr(p, c)]])[at] for c in ("sums", "sizes"))
        items = _Items(np.concatenate([p.at for p in parts]), np.concatenate([p.linked for p in parts]), index, every, sums | 1, sizes)
        first, held, rows = begin, [], 0
        while len(items.at):
            which = np.flatnonzero(items.linked[1:])
            found, inverse, counts = np.unique(items.index[which] * len(items.ids) + items.index[which + 1], return_inverse=True, return_counts=True)
            often = counts >= min_support
            more, longer = np.zeros(len(items.at), np.int64), np.zeros(len(items.at), np.int64)
            more[which], longer[which] = np.where(often, np.arange(1, len(found) + 1), 0)[inverse], np.where(often, counts * 2 + 1, 0)[inverse]
            put, _, begins, grown = items.grow(kind, more, longer, first)
            held.append((home[put[0]], items.at[put[0]], *put[1:]))
            rows += len(put[0])
            first, home, items = False, home[begins], grown
            if rows >= limit or not len(items.at):
                yield from given(names, held)
                held, rows = [], 0

    def given(names: list[int], held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        home, at, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, home))
        home, at, rest = home[order], at[order], [x[order] for x in rest]
        edges = np.searchsorted(home, np.arange(len(names) + 1))
        for block, a, b in zip(names, edges, edges[1:], strict=False):
            if a < b:
                support, size, starts, stops = (x[a:b] for x in rest)
                more = (starts, stops) if kind is NGramType.ALL else (np.zeros(b - a, np.int64),)
                yield _row(OUT, block, np.diff(at[a:b], prepend=0), size, support, *more)

    return run
