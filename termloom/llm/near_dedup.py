"""Near-duplicate groups by banded MinHash, odd sketches and exact confirmation.

1. Each document becomes its set of word shingles (64-bit hashes), MinHash samples, and
   an odd sketch: a bitmap in which every (position, sample) flips one bit. The XOR of
   two sketches counts the samples that differ, which estimates high similarities
   closely. A second, finer bitmap has the parity of the shingles themselves: its XOR
   estimates how many shingles differ. Equal sets are one class, known by its digest.
2. Classes that share a band of samples meet in a bucket. In a bucket of up to ``chunk``
   classes, sketches are compared by population count, the finer ones of those that
   pass, and a spanning forest of the likely links is proposed. In a larger one, each
   class is compared with the bucket's first.
3. Proposed links are confirmed on the full sets; confirmed ones give components.
4. Larger buckets that still hold several components are cut by further samples, four
   times over with different ones, until the parts are small, or hold so few classes
   outside their main component that these can visit all of it in chunks.
5. Likely links between different components, which the forest left out, are proposed
   next, more of them in each round, until no list of them is cut and none is
   unconfirmed. So a link can be skipped only inside a component: the components are
   those of all likely links.

Buckets are made of identifiers alone; a sketch travels once to each part or chunk that
compares it. Sizes and main components come from pre-aggregated counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, small_batches

SHINGLE = 5
SAMPLES, BITS = 256, 1024
BANDS, ROWS = 32, 4
CODES = BANDS * ROWS  # samples that are kept, as 16-bit codes
FINE_BITS = 2048
CUTS, CUT_ROWS, DEPTH = 4, 2, 4  # ways to cut a large bucket, samples of each, times in a row

_draw = np.random.default_rng(19)
_MULTIPLY = (_draw.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_POSITION = _draw.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(SHINGLE)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hash of each word; bounded by clearing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(words: list[int]) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words are one shingle."""
    w = np.array(words, np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - SHINGLE + 1)
    out = np.full(n, min(len(w), SHINGLE), np.uint64)
    for j in range(min(SHINGLE, len(w))):
        out = _mix(out + w[j : j + n] * _FACTORS[j])
    return np.unique(out)


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash samples (uint32) of a set of hashes."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * _MULTIPLY + _ADD).min(0), out=out)
    return out


def odd_sketch(sampled: np.ndarray) -> bytes:
    """Parity of the (position, sample) pairs that fall on each bit."""
    bit = (_mix(sampled.astype(np.uint64) + _POSITION) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def fine_sketch(found: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit."""
    bit = ((found >> np.uint64(7)) % np.uint64(FINE_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=FINE_BITS) & 1).astype(np.uint8)).tobytes()


def most_fine_bits(both: np.ndarray, similarity: float, errors: float = 4.5) -> np.ndarray:
    """XOR population count, at most, of fine sketches of linked sets whose sizes add up to ``both``.

    The mean for as many different shingles as a link allows, and some standard errors;
    never more than those shingles, of which each turns one bit.
    """
    differ = both * (1 - similarity) / (1 + similarity)
    one, two = (1 - 2 / FINE_BITS) ** differ, (1 - 4 / FINE_BITS) ** differ
    variance = FINE_BITS / 4 * (1 - two) + FINE_BITS**2 / 4 * (two - one * one)
    return np.minimum(differ + 1e-6, FINE_BITS / 2 * (1 - one) + errors * np.sqrt(np.maximum(variance, 0)) + 1)


def codes(sampled: np.ndarray) -> bytes:
    """16 bits of each sample of the bands."""
    return ((sampled[:CODES] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def most_different_bits(similarity: float) -> int:
    """XOR population count expected of two sketches at this similarity."""
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sketches(source: DataFrame) -> DataFrame:
    id_type = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "n_shingles", "digest", "codes", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, rows = [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    found = shingles([hashes[w] for w in text.lower().split()])
                    n.append(len(found))
                    if len(found):
                        s = samples(found)
                        rows.append((_digest(found), codes(s), odd_sketch(s) + fine_sketch(found)))
                    else:
                        rows.append((None, None, None))
                made = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), *made], names)

    return source.mapInArrow(run, f"doc_id {id_type}, text_hash long, n_shingles long, digest binary, codes binary, sketch binary")


class Sketches:
    """Sketches and set sizes of some classes."""

    def __init__(self, sketch: np.ndarray, size: np.ndarray, similarity: float, most_bits: int):
        words = BITS // 64
        self.coarse, self.fine = np.ascontiguousarray(sketch[:, :words]), np.ascontiguousarray(sketch[:, words:])
        self.size, self.similarity, self.most_bits = size, similarity, most_bits

    def likely(self, i: np.ndarray | int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (places in ``j``) are likely links, and the bits that differ in them."""
        i = np.broadcast_to(i, j.shape)
        x, y = self.size[i], self.size[j]
        near = np.flatnonzero(np.minimum(x, y) >= self.similarity * np.maximum(x, y))
        near = near[np.bitwise_count(self.coarse[i[near]] ^ self.coarse[j[near]]).sum(1, dtype=np.int32) <= self.most_bits]
        bits = np.bitwise_count(self.fine[i[near]] ^ self.fine[j[near]]).sum(1, dtype=np.int32)
        close = bits <= most_fine_bits(x[near] + y[near], self.similarity)
        return near[close], bits[close]


def forest(held: Sketches, places: np.ndarray) -> list[tuple[int, int, bool]]:
    """A spanning forest of the likely links, breadth first from the first places, so that different buckets propose the same links."""
    out: list[tuple[int, int, bool]] = []
    waiting = np.ones(len(places), bool)
    for root in range(len(places)):
        if not waiting[root]:
            continue
        waiting[root] = False
        queue = [root]
        while queue and waiting.any():
            i = queue.pop(0)
            among = np.flatnonzero(waiting)
            near = among[held.likely(places[i], places[among])[0]]
            waiting[near] = False
            out += [(int(places[j]), int(places[i]), False) for j in near]
            queue += near.tolist()
    return out


def between(held: Sketches, places: np.ndarray, label: np.ndarray, guest: np.ndarray, most: int) -> list[tuple[int, int, bool]]:
    """The ``most`` closest likely links for each pair of labels, and whether others of the same labels were left out.

    Two guests are compared in their own chunks only.
    """
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    own, others = label[places], guest[places]
    for k in np.flatnonzero(~others):
        among = np.flatnonzero((own != own[k]) & (others | (np.arange(len(places)) > k)))
        near, bits = held.likely(places[k], places[among])
        for j, differ in zip(among[near].tolist(), bits.tolist(), strict=True):
            key = (min(own[k], own[j]), max(own[k], own[j]))
            found.setdefault(key, []).append((differ, int(places[k]), int(places[j])))
    return [(i, j, len(pairs) > most) for pairs in found.values() for _, i, j in sorted(pairs)[:most]]


def _propose(groups: DataFrame, classes: DataFrame, similarity: float, most_bits: int, most: int | None) -> DataFrame:
    """Distinct proposed links (a > b), and whether one's list was cut; groups: bucket, chunk, cid, label, guest.

    ``most`` None: a spanning forest of each group; otherwise links between labels.
    """

    def links(rows: pa.Table) -> pa.RecordBatch:
        cid, label = (rows.column(n).to_numpy() for n in ("cid", "label"))
        guest = rows.column("guest").to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(cid), -1)
        held = Sketches(sketch, rows.column("n").to_numpy(), similarity, most_bits)
        starts = _starts(rows)
        sizes = np.diff(np.append(starts, len(cid)))
        twos = starts[sizes == 2]
        if most is not None:
            twos = twos[(label[twos] != label[twos + 1]) & ~(guest[twos] & guest[twos + 1])]
        near = held.likely(twos, twos + 1)[0]
        out = [(int(i), int(i) + 1, False) for i in twos[near]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            places = np.arange(at, at + n)
            out += forest(held, places) if most is None else between(held, places, label, guest, most)
        pairs = np.array(out, np.int64).reshape(-1, 3)
        a, b = cid[pairs[:, 0]], cid[pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(pairs[:, 2] > 0)], ["a", "b", "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            starts = _starts(batch)
            last = int(starts[-1])
            if last or (len(held) > 1 and _key(held[-2], -1) != _key(batch, 0)):
                # All groups but the last one are whole.
                held[-1] = batch.slice(0, last)
                yield links(pa.Table.from_batches(held).combine_chunks())
                held = [batch.slice(last)]
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    rows = groups.join(classes.select("cid", "n", "sketch"), "cid").repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "cid")
    rows = rows.select("bucket", "chunk", "cid", "label", "guest", "n", "sketch")
    found = rows.mapInArrow(run, "a long, b long, cut boolean").where("a <> b")
    return found.groupBy("a", "b").agg(F.bool_or("cut").alias("cut"))


def _key(batch: pa.RecordBatch, i: int) -> tuple:
    i %= batch.num_rows
    return batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where the groups of sorted rows begin."""
    bucket, chunk = (rows.column(n).to_numpy() for n in ("bucket", "chunk"))
    return np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])))


def _propose_first(large: DataFrame, classes: DataFrame, similarity: float, most_bits: int) -> DataFrame:
    """Likely links ``a, b`` of the classes of large buckets with the bucket's first; large: cid, leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = b"".join(batch.column(4).to_pylist() + batch.column(5).to_pylist())
            size = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            held = Sketches(np.frombuffer(raw, np.uint64).reshape(2 * n, -1), size, similarity, most_bits)
            near = pa.array(held.likely(np.arange(n), np.arange(n, 2 * n))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near)], ["a", "b"])

    pairs = large.where("cid <> leader").select(F.col("cid").alias("a"), F.col("leader").alias("b")).distinct()
    mine = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.join(mine, "a").join(other, "b").select("a", "b", "na", "nb", "sa", "sb")
    return rows.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b, linked``: the similarity of the full sets, compared without rounding."""
    percent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    mine = sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a"))
    other = sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b"))
    rows = pairs.join(mine, "a").join(other, "b").select("a", "b", "set_a", "set_b")
    return rows.mapInArrow(run, "a long, b long, linked boolean")


def _sets(source: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``cid, set`` of the classes in ``nodes (cid)``, from the text of one of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            cids, found = [], []
            for cid, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                made = shingles([hashes[w] for w in text.lower().split()])
                if _digest(made) == digest:
                    cids.append(cid)
                    found.append(made.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(found, pa.binary())], ["cid", "set"])

    wanted = classes.join(nodes, "cid", "left_semi").select("cid", "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = source.join(wanted, ["doc_id", "text_hash"]).select("cid", "digest", "text")
    return texts.mapInArrow(run, "cid long, set binary").groupBy("cid").agg(F.first("set").alias("set"))


def _labelled(groups: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets with several components, with ``label``; and per such bucket ``size``, the ``main`` component, those ``outside``."""
    named = groups.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    counts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("bucket").agg(
        F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")
    )
    return named, stats.where("outside > 0")


def _cut(large: DataFrame, classes: DataFrame, labels: DataFrame, scratch: Scratch, chunk: int) -> list[DataFrame]:
    """``bucket, cid, parts`` that replace large buckets; parts: chunks that classes outside the main component visit.

    Two classes of a bucket that are linked, with similarity 0.75, share one of the cuts
    with probability 0.96.
    """
    out = []
    rows = large.select("bucket", "band", "cid")
    for depth in range(DEPTH + 1):
        named, stats = _labelled(rows, labels)
        parts = F.ceil(F.col("size") / chunk)
        few = F.lit(depth == DEPTH) | (F.col("outside") * (parts - 1) <= 2 * F.col("size"))
        sized = named.drop("label").join(stats.select("bucket", parts.cast("int").alias("parts"), few.alias("few")), "bucket")
        sized = scratch.write(sized, f"cut-{depth}")
        out.append(sized.where("few").select("bucket", "cid", "parts"))
        rest = sized.where("NOT few")
        if not rest.limit(1).count():
            break
        pairs = []
        for way in range(CUTS):
            place = [(F.col("band") * ROWS + ROWS + F.pmod(F.xxhash64("band", F.lit(depth), F.lit(way), F.lit(j)), F.lit(CODES - ROWS))) % CODES for j in range(CUT_ROWS)]
            pairs.append(F.xxhash64("bucket", F.lit(way), *[F.substring("codes", (p * 2 + 1).cast("int"), F.lit(2)) for p in place]))
        rows = rest.join(classes.select("cid", "codes"), "cid").select("band", "cid", F.explode(F.array(*pairs)).alias("bucket"))
    return out


def _visits(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """``bucket, chunk, cid, label, guest`` of buckets with several components; guests: in all chunks but their own."""
    named, stats = _labelled(groups, labels)
    mixed = named.join(stats.select("bucket", "main"), "bucket").withColumn("chunk", F.pmod(F.xxhash64("bucket", "cid"), F.col("parts")).cast("int"))
    home = mixed.select("bucket", "chunk", "cid", "label", F.lit(False).alias("guest"))
    places = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    guests = mixed.where("parts > 1 AND label <> main").select("bucket", F.col("chunk").alias("home"), "cid", "label", places.alias("chunk"))
    return home.unionByName(guests.where("chunk <> home").select("bucket", "chunk", "cid", "label", F.lit(True).alias("guest")))


def _decisions(docs: DataFrame, id_col: str, text_col: str, similarity: float, margin: float, chunk: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept``."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sketched = scratch.write(_sketches(source), "sketched")
    rows = scratch.write(sketched.select("doc_id", "text_hash", "n_shingles", "digest"), "rows")
    usable = sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = usable.groupBy("digest").agg(first, F.first("n_shingles").alias("n"), F.first("codes").alias("codes"), F.first("sketch").alias("sketch"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    scratch.drop("sketched")

    pieces = F.posexplode(F.array(*[F.substring("codes", 2 * ROWS * b + 1, 2 * ROWS) for b in range(BANDS)])).alias("band", "piece")
    banded = classes.select("cid", pieces).select("cid", F.col("band").cast("int").alias("band"), F.xxhash64("band", "piece").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("leader")).where("size > 1")
    members = scratch.write(banded.join(sizes, "bucket"), "members")
    small, large = members.where(F.col("size") <= chunk), members.where(F.col("size") > chunk)

    most_bits = most_different_bits(similarity - margin)
    alone = small.select("bucket", F.lit(0).alias("chunk"), "cid", F.col("cid").alias("label"), F.lit(False).alias("guest"))
    proposed = _propose(alone, classes, similarity, most_bits, None).select("a", "b")
    proposed = scratch.write(proposed.unionByName(_propose_first(large, classes, similarity, most_bits)).distinct(), "proposed")
    # Those with a likely link; in a large bucket, it may be with another than the first.
    nodes = proposed.select(F.explode(F.array("a", "b")).alias("cid"))
    nodes = scratch.write(nodes.unionByName(large.select("cid")).distinct(), "nodes")
    sets = scratch.write(_sets(source, nodes, classes), "sets")
    confirmed = scratch.write(_confirm(proposed, sets, similarity), "confirmed-0")
    scratch.drop("proposed")
    labels = scratch.write(connected_components(confirmed.where("linked").select("a", "b"), scratch, "links-0"), "labels-0")

    groups = small.join(nodes, "cid", "left_semi").select("bucket", "cid", F.lit(1).alias("parts"))
    for part in _cut(large, classes, labels, scratch, chunk):
        groups = groups.unionByName(part)
    turn, most = 0, 16
    while True:
        known = confirmed.select("a", "b", F.lit(True).alias("known"))
        listed = _propose(_visits(groups, labels), classes, similarity, most_bits, most).join(known, ["a", "b"], "left")
        listed = scratch.write(listed.select("a", "b", "cut", F.col("known").isNull().alias("fresh")), "listed")
        state = listed.agg(F.bool_or("cut").alias("cut"), F.bool_or("fresh").alias("fresh")).first()
        if not state["cut"] and not state["fresh"]:
            break
        if state["fresh"]:
            turn += 1
            found = scratch.write(_confirm(listed.where("fresh").select("a", "b"), sets, similarity), "found")
            joined = bool(found.where("linked").limit(1).count())
            confirmed = scratch.write(confirmed.unionByName(found), f"confirmed-{turn}")
            scratch.drop(f"confirmed-{turn - 1}")
            if joined:
                labels = scratch.write(connected_components(confirmed.where("linked").select("a", "b"), scratch, f"links-{turn}"), f"labels-{turn}")
        most *= 8
    for table in ("members", "nodes", "sets", "listed", "found", f"confirmed-{turn}", *(f"cut-{i}" for i in range(DEPTH + 1))):
        scratch.drop(table)

    known = classes.select("cid", "digest", F.col("first.doc_id").alias("uid")).join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("digest", "uid", F.coalesce("label", "cid").alias("label"))
    least = known.groupBy("label").agg(F.min("uid").alias("component"))
    component = scratch.write(known.join(least, "label").select("digest", "component"), "components")
    scratch.drop("classes")
    joined = rows.join(component, "digest", "left")
    own = F.when(F.col("doc_id").isNull() | F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    return joined.select("doc_id", "text_hash", "n_shingles", own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.75,
    margin: float = 0.13,
    chunk: int = 1_024,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if the Jaccard similarity of their shingle sets is
    ``similarity`` or more, confirmed on the full sets. Two sets at the threshold share
    no band with probability 5e-6, or 4e-5 if all their buckets were cut as often as
    buckets are; their sketches differ by more than ``margin`` (over four standard
    errors), or their fine ones by more than 4.5, with a similar one.

    Identifiers are of any type with an order. Null texts count as empty. Texts without
    words have no shingles and are linked with nothing. Documents of fewer than five
    words are one shingle. Rows that share an identifier are documents of their own: each
    has the links of its text. Rows with a null identifier are linked with nothing and
    kept (``component_id`` null). An empty table gives an empty result. Other columns of
    the input are not read.
    """
    return _decisions(docs, id_col, text_col, similarity, margin, chunk).drop("text_hash")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.75, margin: float = 0.13, chunk: int = 1_024) -> DataFrame:
    """The documents that :func:`near_duplicates` keeps, with the input's columns. Rows with one identifier and text go or stay together."""
    gone = _decisions(docs, id_col, text_col, similarity, margin, chunk).where("NOT kept")
    its, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    return docs.join(gone, (its == gone["doc_id"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == gone["text_hash"]), "left_anti")
