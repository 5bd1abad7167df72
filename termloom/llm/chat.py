"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is an optional system turn, then user and assistant in
turn, ending with the assistant. Dynamic programming over that automaton chooses, for
each turn, its role (relabelling costs), whether it joins the turn before (merging
costs), and which empty turns come before it (each costs); the sum is the least
possible. The repaired turns are then rendered.

The automaton has four states, so a stretch of turns is a 4 x 4 matrix of least costs.
Turns are range-partitioned by conversation and turn, over as many partitions as the
cluster works on, and cut into parts of bounded size: a long conversation lies in
several parts. Each part reports the matrices of its first and last conversation.
Reports are combined by partition; the driver, with two matrices for each, chooses the
states where partitions meet; then each partition those where its parts meet, and each
part repairs its turns between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scratch import Scratch, small_batches

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
UNKNOWN = 3  # place of an unknown role after ROLES
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
MERGE, RELABEL, GUESS, INSERT = 1, 2, 1, 3  # costs; GUESS: a label for an unknown role


def _inserted() -> dict[tuple[int, int], tuple[int, ...] | None]:
    """Shortest path of empty turns that makes a turn with the second state legal after the first."""
    found: dict[tuple[int, int], tuple[int, ...] | None] = {}
    for a in range(4):
        paths = {b: (()) for b in NEXT[a]}
        frontier = {b: (b,) for b in NEXT[a]}
        while frontier:
            following: dict[int, tuple[int, ...]] = {}
            for b, path in frontier.items():
                for c in NEXT[b]:
                    if c not in paths:
                        paths[c] = path
                        following[c] = (*path, c)
            frontier = following
        for b in range(4):
            found[a, b] = paths.get(b)
    return found


INSERTED = _inserted()


def step(role: int, a: int, b: int) -> tuple[int, bool]:
    """Least cost of a turn that takes state ``a`` to ``b``, and whether it merges. ``role``: its place in ROLES, or UNKNOWN."""
    if b == START:
        return FAR, False
    label = 0 if role == b - 1 else GUESS if role == UNKNOWN else RELABEL
    path = INSERTED[a, b]
    fresh = FAR if path is None else INSERT * len(path)
    if a == b and MERGE < fresh:
        return label + MERGE, True
    return (FAR, False) if fresh >= FAR else (label + fresh, False)


STEP = np.array([[[step(r, a, b)[0] for b in range(4)] for a in range(4)] for r in range(4)], np.int64)
FINAL = np.array([FAR if a == START else INSERT * (0 if a == ASSISTANT else len(INSERTED[a, ASSISTANT]) + 1) for a in range(4)], np.int64)


def combine(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least costs over both stretches."""
    return np.minimum((m[:, :, None] + n[None]).min(1), FAR)


def stretch(roles: list[int]) -> np.ndarray:
    """Least-cost matrix of a stretch of turns."""
    m = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(m, 0)
    for r in roles:
        m = combine(m, STEP[r])
    return m


def repair(roles: list[int], first: int = START, last: int | None = None) -> list[int]:
    """State after each turn, at least cost, from ``first``; to ``last``, or to a legal end. Ties go to the smaller state."""
    cost = np.full(4, FAR, np.int64)
    cost[first] = 0
    back = []
    for r in roles:
        table = cost[:, None] + STEP[r]
        back.append(table.argmin(0))
        cost = np.minimum(table.min(0), FAR)
    state = int((cost + FINAL).argmin()) if last is None else last
    states = []
    for choice in reversed(back):
        states.append(state)
        state = int(choice[state])
    return states[::-1]


def _role(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else UNKNOWN


def _opening(state: int) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n"


CLOSING = "<|im_end|>\n"


def _content(text: str | None) -> str:
    """The turn's text; the format's own marks in it are broken up, so they cannot end a turn."""
    return (text or "").replace("<|im_", "<| im_")


def render(states: list[int], roles: list[int], texts: list[str | None], first: int = START, ends: bool = True) -> Iterator[tuple[str, str, list[str], int, str]]:
    """(role, action, roles of the empty turns before, cost, text) of each turn; the texts joined are the conversation."""
    before = first
    for i, (state, role, text) in enumerate(zip(states, roles, texts, strict=True)):
        cost, merged = step(role, before, state)
        empty = [] if merged else list(INSERTED[before, state])
        out = "\n" if merged else (CLOSING if before != START else "") + "".join(_opening(e) + CLOSING for e in empty) + _opening(state)
        out += _content(text)
        if ends and i == len(states) - 1:
            tail = [] if state == ASSISTANT else [*INSERTED[state, ASSISTANT], ASSISTANT]
            out += CLOSING + "".join(_opening(e) + CLOSING for e in tail)
            cost += INSERT * len(tail)
        action = "+".join([*(["relabel"] if role != state - 1 else []), *(["merge"] if merged else []), *(["insert"] if empty else [])]) or "keep"
        yield ROLES[state - 1], action, [ROLES[e - 1] for e in empty], cost, out
        before = state


def _segments(keys: list) -> list[tuple[int, int]]:
    bounds = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def _chains(rows: list[dict]) -> list[list[dict]]:
    """Reports in order, those of one conversation together. A report: part, places (0: first segment, 1: last), conv, turns, matrix."""
    out: list[list[dict]] = []
    for x in sorted(rows, key=lambda r: (r["part"], min(r["places"]))):
        if out and 0 in x["places"] and out[-1][-1]["conv"] == x["conv"]:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _whole(chain: list[dict]) -> dict:
    """Conversation, turns and matrix of a chain."""
    m = np.array(chain[0]["matrix"], np.int64).reshape(4, 4)
    for x in chain[1:]:
        m = combine(m, np.array(x["matrix"], np.int64).reshape(4, 4))
    return {"conv": chain[0]["conv"], "turns": sum(x["turns"] for x in chain), "matrix": m.ravel().tolist()}


def _settle(chain: list[dict], first: int = START, last: int | None = None, turns: int = 0) -> Iterator[tuple[int, int, int, int | None, int]]:
    """Part, place, state before, state after (None: the end is here) and turns before, of each report of a chain."""
    matrices = [np.array(x["matrix"], np.int64).reshape(4, 4) for x in chain]
    forward = [np.full(4, FAR, np.int64)]
    forward[0][first] = 0
    for m in matrices:
        forward.append(np.minimum((forward[-1][:, None] + m).min(0), FAR))
    states = [int((forward[-1] + FINAL).argmin()) if last is None else last]
    for f, m in zip(forward[-2::-1], matrices[::-1], strict=True):
        states.append(int((f + m[:, states[-1]]).argmin()))
    states.reverse()
    for i, x in enumerate(chain):
        for place in x["places"]:
            yield x["part"], place, states[i], last if i == len(chain) - 1 else states[i + 1], turns
        turns += x["turns"]


def _meet(rows: list[dict], known: dict[int, tuple[int, int | None, int]] | None = None) -> Iterator[tuple[int, int, int, int | None, int]]:
    """Where parts meet; ``known``: the same for all of them together, for what the first (0) and the last chain (1) have outside."""
    found = _chains(rows)
    for i, chain in enumerate(found):
        outer = (known or {}).get(0 if i == 0 else 1 if i == len(found) - 1 else -1)
        if outer or len(chain) > 1:
            yield from _settle(chain, *(outer or ()))


def _cut_into_parts(sorted_rows: DataFrame, part_bytes: int) -> DataFrame:
    """Rows with ``part`` (partition and piece of it) and ``place`` in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, size, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ends = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 40)
            part = (partition << 32) + (ends - 1) // part_bytes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(np.arange(place, place + n))], [*batch.schema.names, "part", "place"])
            size, place = int(ends[-1]), place + n

    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("place", T.LongType())])
    return sorted_rows.mapInArrow(run, schema)


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_bytes: int = 16 << 20
) -> DataFrame:
    """One row per turn: ``conv_id, position, turn, role, new_role, action, inserted, cost, rendered``.

    ``rendered`` of a conversation's turns, joined by ``position``, is its chat text.
    ``inserted`` are the empty turns before; those at the end are in the last turn's text.

    Turns are ordered by turn (null last), then role, then text; equal rows follow one
    another. A role that is null or unknown takes any label at the cost of a guess. Null
    texts are empty. Turns with a null conversation are one conversation. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = turns.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "chat")
    source = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    conv_type, turn_type = (source.schema[i].dataType.simpleString() for i in (0, 1))
    size = source.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 40)).first()[0] or 0
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("tie")]
    tied = source.withColumn("tie", F.xxhash64("text"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = tied.repartitionByRange(max(1, min(tasks, -(-int(size) // part_bytes))), *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    table = scratch.write(_cut_into_parts(dealt.drop("tie"), part_bytes), "turns")

    def report(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        conv, roles = rows.column("conv_id").to_pylist(), [_role(r) for r in rows.column("role").to_pylist()]
        cuts = _segments(conv)
        ends = [(cuts[0], [0, 1])] if len(cuts) == 1 else [(cuts[0], [0]), (cuts[-1], [1])]
        out = [(rows.column("part")[0].as_py(), p, repr(conv[a]), b - a, stretch(roles[a:b]).ravel().tolist()) for (a, b), p in ends]
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.list_(pa.int64())]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("part", "places", "conv", "turns", "matrix"), zip(*out, strict=True), kinds, strict=True)})

    shape = "part long, places array<int>, conv string, turns long, matrix array<long>"
    reports = scratch.write(table.select("part", "place", "conv_id", "role").groupBy("part").applyInArrow(report, shape), "reports")
    by_partition = reports.withColumn("partition", F.shiftright("part", 32))

    def outer(rows: pa.Table) -> pa.Table:
        found = _chains(rows.to_pylist())
        ends = [(found[0], [0, 1])] if len(found) == 1 else [(found[0], [0]), (found[-1], [1])]
        out = [{"part": rows.column("partition")[0].as_py(), "places": p} | _whole(c) for c, p in ends]
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int64()), ("places", pa.list_(pa.int32())), ("conv", pa.string()), ("turns", pa.int64()), ("matrix", pa.list_(pa.int64()))]))

    known: dict[int, dict[int, tuple[int, int | None, int]]] = {}
    for part, place, *bounds in _meet([r.asDict() for r in by_partition.groupBy("partition").applyInArrow(outer, shape).collect()]):  # two rows per partition
        known.setdefault(part, {})[place] = tuple(bounds)
    fixed = spark.sparkContext.broadcast(known)

    def inner(rows: pa.Table) -> pa.Table:
        found = list(_meet(rows.to_pylist(), fixed.value.get(rows.column("partition")[0].as_py())))
        columns = list(zip(*found, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("part", "place", "first", "last", "turns"), columns, strict=True)})

    meet = by_partition.groupBy("partition").applyInArrow(inner, "part long, place long, first long, last long, turns long")

    def run(rows: pa.Table, met: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return arrow_schema.empty_table()
        rows = rows.sort_by("place")
        conv, texts = rows.column("conv_id").to_pylist(), rows.column("text").to_pylist()
        roles = [_role(r) for r in rows.column("role").to_pylist()]
        known = {r["place"]: (r["first"], r["last"], r["turns"]) for r in met.to_pylist()}
        cuts = _segments(conv)
        out, position = [], []
        for i, (a, b) in enumerate(cuts):
            first, last, turn = START, None, 0
            if i == 0 and 0 in known:
                first, last, turn = known[0]
            elif i == len(cuts) - 1 and 1 in known:
                first, last, turn = known[1]
            states = repair(roles[a:b], first, last)
            out += render(states, roles[a:b], texts[a:b], first, last is None)
            position += range(turn, turn + b - a)
        columns = list(zip(*out, strict=True))
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string()]
        made = {n: pa.array(c, k) for n, c, k in zip(("new_role", "action", "inserted", "cost", "rendered"), columns, kinds, strict=True)}
        kept = {n: rows.column(n) for n in ("turn", "role")}
        return pa.table({"conv_id": rows.column("conv_id"), "position": pa.array(position, pa.int64()), **kept, **made})

    schema = f"conv_id {conv_type}, position long, turn {turn_type}, role string, new_role string, action string, inserted array<string>, cost long, rendered string"
    arrow_schema = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return table.groupBy("part").cogroup(meet.groupBy("part")).applyInArrow(run, schema)
