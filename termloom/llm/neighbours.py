"""Approximate nearest neighbours by cosine, with a permutation index.

A vector is represented by its nearest pivots in their order. It is posted, with the
first of them, in the inverted files of its ``post`` nearest pivots. A query reads the
files of its ``probe`` nearest pivots, ranks what is posted there by the footrule
distance of the two orders, and takes the exact cosine of all within a limit.

The number of pivots grows with the square root of the table. How many postings of a
vector, how many files and which limit are needed depends on the data, whether it has
clusters or none. So they are measured in each call, on a bounded sample of queries
whose neighbours are found by brute force: the cheapest setting is taken that finds
``recall`` of them. On clustered data a query reads few files; without any structure it
must read much of the table, and does.

Every row is indexed. Equal vectors are posted once, with the smallest identifiers that
an answer could need, so copies do not multiply work. Files and query lists are cut
into chunks of bounded size; a chunk of queries meets each chunk of the file it reads,
so no task holds a whole hot file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, small_batches

PREFIX, READ, POST = 8, 32, 3  # pivots that a posting and a query keep; files that a vector may be posted in


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _order(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivots by closeness."""
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable").astype(np.int16)


def footrule(orders: np.ndarray, prefixes: np.ndarray, pivots: int) -> np.ndarray:
    """Distance of each query's order of its nearest pivots (n, READ) and each vector's (m, PREFIX): how far the vector's pivots are displaced.

    Pivots that are not among the query's nearest count as the next one.
    """
    place = np.full((len(orders), pivots), orders.shape[1], np.int16)
    place[np.arange(len(orders))[:, None], orders] = np.arange(orders.shape[1], dtype=np.int16)
    out = np.zeros((len(orders), len(prefixes)), np.int16)
    for i in range(prefixes.shape[1]):
        out += np.abs(place[:, prefixes[:, i]] - np.int16(i))
    return out


def best_pairs(vx: np.ndarray, uid: np.ndarray, qx: np.ndarray, allowed: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine) of each query's ``most`` allowed vectors of the largest cosine, ties to the smaller ``uid``.

    All are scored by a product of matrices, whose last digits may vary with its shape;
    what that leaves in question is scored again, alike in every chunk.
    """
    v_norm, q_norm = np.sqrt((vx * vx).sum(1)), np.sqrt((qx * qx).sum(1))
    rough = (qx / q_norm[:, None]) @ (vx / v_norm[:, None]).T
    if allowed is not None:
        rough[~allowed] = -2
    n = min(most, len(vx))
    least = np.maximum(np.partition(rough, -n, axis=1)[:, -n] - 1e-9, -1.5)
    q, v = np.nonzero(rough >= least[:, None])
    score = (vx[v] * qx[q]).sum(1) / (v_norm[v] * q_norm[q])
    order = np.lexsort((uid[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = place < most
    return q[keep], v[keep], score[keep]


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, embedding`` of the rows that can have a cosine: finite, not zero, with an identifier."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(v, lambda x: x != 0)
    )


class Setting:
    """How much of the index is read: postings of a vector, files of a query, largest footrule distance."""

    def __init__(self, post: int, probe: int, limit: int):
        self.post, self.probe, self.limit = post, probe, limit


def measured_setting(asked: np.ndarray, found: list[np.ndarray], pivots: np.ndarray, recall: float) -> Setting:
    """The cheapest setting that finds ``recall`` of the sample's true neighbours (``found``, for each query ``asked``)."""
    m = len(pivots)
    whole = Setting(1, m, PREFIX * READ)
    truth = np.concatenate(found) if found else np.zeros((0, pivots.shape[1]))
    if not len(truth):
        return whole
    owner = np.repeat(np.arange(len(asked)), [len(f) for f in found])
    orders, theirs = _order(asked, pivots), _order(truth, pivots)
    place = np.empty((len(asked), m), np.int32)
    place[np.arange(len(asked))[:, None], orders] = np.arange(m)
    reached = place[owner[:, None], theirs]  # place of the neighbour's pivots in the query's order
    share = recall + (1 - recall) / 2  # found by the files; of those, as much by the limit
    best = whole
    for post in range(1, min(POST, m) + 1):
        probe = int(np.sort(reached[:, :post].min(1))[int(np.ceil(share * len(truth))) - 1]) + 1
        if post * probe < best.post * best.probe:
            best = Setting(post, probe, 0)
    distance = np.concatenate([footrule(orders[i : i + 1, :READ], theirs[owner == i, :PREFIX], m)[0] for i in range(len(asked))])
    best.limit = int(np.sort(distance)[int(np.ceil(share * len(truth))) - 1])
    return best


def _share(uid: Column, wanted: int, rows: int) -> Column:
    """Chooses, by a hash, about ``wanted`` of ``rows`` rows."""
    return F.pmod(F.xxhash64(uid), F.lit(1 << 20)) < min(1 << 20, -(-(wanted << 20) // max(1, rows)))


def _sampled(classes: DataFrame, asked: DataFrame, dim: int, rows: int, k: int, sample: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """About ``sample`` query vectors, and the vectors of their ``k`` nearest other classes, by brute force.

    The driver gets ``sample`` queries and ``k`` vectors for each.
    """
    few = asked.dropDuplicates(["quid"])
    n = few.count()
    drawn = few.where(_share(F.col("quid"), 2 * sample, n)).orderBy(F.xxhash64("quid"), "quid").limit(sample).collect()
    queries = np.array([r["embedding"] for r in drawn], np.float64).reshape(-1, dim)
    if not len(queries):
        return queries, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None  # vectors and identifiers of the best so far, of all queries
        for batch in batches:
            x, uid = _matrix(batch.column(0), dim), batch.column(1).to_numpy()
            if held:
                x, uid = np.concatenate([held[0], x]), np.concatenate([held[1], uid])
            at = np.unique(best_pairs(x, uid, queries, None, k + 1)[1])
            held = x[at], uid[at]
        if held and len(held[0]):
            q, v, score = best_pairs(*held, queries, None, k + 1)
            columns = [pa.array(q), pa.array(held[1][v], pa.int64()), pa.array(score), pa.array([held[0][i].tolist() for i in v], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["q", "uid", "score", "embedding"])

    best = classes.select("embedding", "uid").mapInArrow(run, "q long, uid long, score double, embedding array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "uid"))
    rows_of = best.withColumn("rank", rank).where(F.col("rank") <= k + 1).collect()
    found = []
    for i, x in enumerate(queries):
        # The query's own class is no neighbour.
        other = [r["embedding"] for r in sorted((r for r in rows_of if r["q"] == i), key=lambda r: r["rank"]) if not np.array_equal(r["embedding"], x)]
        found.append(np.array(other[:k], np.float64).reshape(-1, dim))
    return queries, found


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    recall: float = 0.96,
    pivots: int | None = None,
    sample: int = 128,
    setting: Setting | None = None,
    chunk: int = 4_096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` rows per query, nearest first, ties to the smaller identifier.

    ``queries`` are rows of the same shape, by default all of ``vectors``; a query's
    candidates are all rows with another identifier. ``pivots`` is by default half the
    square root of the number of different vectors, 16 to 2,048. Without a ``setting``,
    one is measured on ``sample`` queries to find ``recall`` of the neighbours.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a
    null identifier, take no part; nor do those whose dimension is not the most frequent
    one (the smaller in a tie). Repeated rows count once. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neighbours")
    rows = valid_vectors(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 1
    rows = rows.where(F.size("embedding") == dim)
    # Of equal vectors, k + 1 identifiers at most can be in an answer (one may be the query's own).
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    classes = scratch.write(
        few.groupBy("embedding").agg(F.min("vec_id").alias("uid"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes"
    )
    count = classes.count()
    asked = rows if queries is None else valid_vectors(queries, id_col, vector_col).where(F.size("embedding") == dim)
    # Queries with one vector are one search; 128 bits of it are its name.
    name = F.concat(F.hex(F.xxhash64("embedding")), F.lit("-"), F.hex(F.xxhash64("embedding", F.lit(1))))
    asked = scratch.write(asked.distinct().select(F.col("vec_id").alias("query_id"), name.alias("quid"), "embedding"), "asked")
    m = min(max(1, count), pivots or int(np.clip(np.sqrt(count) / 2, 16, 2_048)))
    chosen = classes.where(_share(F.col("uid"), 2 * m + 64, count)).orderBy(F.xxhash64("uid"), "uid").limit(m).select("embedding").collect()
    pivot = np.array([r["embedding"] for r in chosen], np.float64).reshape(-1, dim)
    pivot /= np.maximum(1e-300, np.sqrt((pivot * pivot).sum(1, keepdims=True)))
    if setting is None:
        setting = measured_setting(*_sampled(classes, asked, dim, count, k, sample), pivot, recall)
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "f4" if single else "f8"  # floats are kept as floats

    def to_files(depth: int, held: int, kind: str, carry: int):
        """Each row once per file, with its ``held`` nearest pivots; the embedding is column 0, the next ``carry`` columns go along."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1_024):
                    part = batch.slice(at, 1_024)
                    x = _matrix(part.column(0), dim)
                    order = _order(x, pivot)
                    n = min(depth, order.shape[1])
                    take = pa.array(np.repeat(np.arange(len(x)), n))
                    raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()).take(take)
                    pre = pa.array([r.tobytes() for r in order[:, :held]], pa.binary()).take(take)
                    own = [part.column(1 + i).take(take) for i in range(carry)]
                    files = pa.array(order[:, :n].ravel().astype(np.int32))
                    yield pa.RecordBatch.from_arrays([raw, pre, *own, files], ["vector", "pivots", *part.schema.names[1 : 1 + carry], "file"])

        return run

    posted = classes.select("embedding", "uid", "ids").mapInArrow(to_files(setting.post, PREFIX, kind, 2), "vector binary, pivots binary, uid long, ids array<long>, file int")
    posted = scratch.write(posted, "posted")
    probes = asked.dropDuplicates(["quid"]).select("embedding", "quid").mapInArrow(to_files(setting.probe, READ, "f8", 1), "vector binary, pivots binary, quid string, file int")
    probes = scratch.write(probes, "probes")
    # One row per file: a table of the pivots' size.
    v_rows = {r["file"]: r["count"] for r in posted.groupBy("file").count().collect()}
    q_rows = {r["file"]: r["count"] for r in probes.groupBy("file").count().collect()}
    sizes = [(f, -(-v_rows[f] // chunk), -(-q_rows[f] // chunk)) for f in sorted(v_rows.keys() & q_rows.keys())]
    parts = [spark.createDataFrame(sizes, "file int, v_parts int, q_parts int") for _ in range(2)]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        probes.join(F.broadcast(parts[0]), "file")
        .withColumn("q_part", F.pmod(F.xxhash64("quid"), F.col("q_parts")).cast("int"))
        .withColumn("v_part", upto("v_parts"))
    )
    right = (
        posted.join(F.broadcast(parts[1]), "file")
        .withColumn("v_part", F.pmod(F.xxhash64("uid"), F.col("v_parts")).cast("int"))
        .withColumn("q_part", upto("q_parts"))
    )
    key = ["file", "q_part", "v_part"]
    limit = setting.limit

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if q.num_rows and v.num_rows:
            decode = lambda t, n, kind: np.frombuffer(b"".join(t.column(n).to_pylist()), kind).reshape(t.num_rows, -1)
            vx, prefixes, uid = decode(v, "vector", kind).astype(np.float64), decode(v, "pivots", np.int16), v.column("uid").to_numpy()
            qx, orders = decode(q, "vector", "f8"), decode(q, "pivots", np.int16)
            for at in range(0, len(qx), 256):
                near = footrule(orders[at : at + 256], prefixes, len(pivot)) <= limit
                some = np.flatnonzero(near.any(0))
                if len(some):
                    i, j, score = best_pairs(vx[some], uid[some], qx[at : at + 256], near[:, some], k + 1)
                    for held, more in zip(out, (i + at, some[j], score), strict=True):
                        held.append(more)
        i, j, score = (np.concatenate(x) for x in out)
        named = lambda t, n, at: t.column(n).combine_chunks().take(pa.array(at))
        return pa.table({"quid": named(q, "quid", i), "uid": named(v, "uid", j), "score": pa.array(score, pa.float64()), "ids": named(v, "ids", j)})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "quid string, uid long, score double, ids array<long>")
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "uid")
    found = found.dropDuplicates(["quid", "uid"]).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    answers = (
        asked.select("query_id", "quid")
        .join(found.select("quid", "score", F.explode("ids").alias("vec_id")), "quid")
        .where(F.col("vec_id") != F.col("query_id"))
        .dropDuplicates(["query_id", "vec_id"])
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
