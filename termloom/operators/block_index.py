"""A positional index from blocks: only places of frequent pairs are sent, packed, and once.

Blocks send the distinct keys of their pairs, which are exact, and get a bit for each of
them back. Places of frequent pairs go to the task of their range of keys (a part), which
writes whole posting lists. The words of stored lists are looked up once for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Levels
from . import blocks
from .block_levels import _parted, _send
from .blocks import _ODD, _batch, _met, block_counts, pack, unpack, word_blocks
from .dictionary import build_dictionary

#: Rows that are put out at once.
ROWS = 10_000


def place_in_blocks(lines: DataFrame, min_support: int, levels: Levels, empty_token: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Blocks that keep their lines' identifiers (whole numbers) and all positions, and the dictionary of frequent words; both are written to ``levels``.

    ``block, n, tids, docs, numbers``: 0 ends a line, 1 is an infrequent word, others are ids from 2.
    """
    found = levels.keep(word_blocks(lines, empty_token, ids=True), "words")
    frequent = levels.keep(build_dictionary(block_counts(found).where(F.col("count") >= min_support)), "frequent")
    words = found.select("block", F.posexplode("words").alias("i", "word"))
    ids = words.join(frequent.select("word", "tid"), "word").groupBy("block").agg(F.collect_list(F.struct("i", "tid")).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, names = unpack(batch.column("codes")[k].as_py()), batch.column("names")[k].values
                table = np.ones(int(codes.max(initial=0)) + 1, np.int64)
                table[0] = 0
                table[names.field("i").to_numpy() + 1] = names.field("tid").to_numpy().astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(k, 1), pa.array([len(codes)]), pa.array([pack(table[codes])]), batch.column("docs").slice(k, 1), batch.column("numbers").slice(k, 1)], ["block", "n", "tids", "docs", "numbers"])

    placed = found.select("block", "codes", "docs", "numbers").join(ids, "block").mapInArrow(run, "block long, n long, tids binary, docs binary, numbers binary")
    placed = levels.settle(placed, "placed")
    levels.drop("words")
    return placed, frequent


def pair_lists(placed: DataFrame, dictionary: DataFrame, min_support: int) -> DataFrame:
    """``gram, postings, support, part`` of pairs with enough support, as :func:`apriori_index.posting_lists` has them."""
    tokens = placed.agg(F.sum("n")).first()[0] or 0
    terms = (dictionary.agg(F.max("tid")).first()[0] or 0) + 2
    bits = max(12, (terms * terms).bit_length())
    if bits > 63:
        raise ValueError("too many words for exact keys")
    undo = pow(_ODD, -1, 1 << bits)
    part_bits = min(bits, max(0, tokens // blocks.COUNTED).bit_length())
    sent = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    posted = pa.schema([("part", pa.int32()), ("base", pa.int64()), *((c, pa.binary()) for c in ("keys", "counts", "docs", "numbers", "pos"))])

    def pairs(tids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((tids[:-1] > 1) & (tids[1:] > 1))
        u = tids.astype(np.uint64)
        return at, ((u[at] * np.uint64(terms) + u[at + 1]) * np.uint64(_ODD)) & np.uint64(2**bits - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tids in zip(batch.column("block").to_pylist(), batch.column("tids"), strict=True):
                yield _send(block, pairs(unpack(tids.as_py()))[1], bits, part_bits, sent)

    def count(table: pa.Table) -> pa.Table:
        _, sums, inverse, edges = _met(table)
        often = sums[inverse] >= min_support
        bitmaps = [np.packbits(often[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "bits": pa.array(bitmaps, pa.binary())})

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tids, docs, numbers = (unpack(batch.column(c)[k].as_py()) for c in ("tids", "docs", "numbers"))
                at, keys = pairs(tids)
                found, inverse = np.unique(keys, return_inverse=True)
                edges = _parted(found, bits, part_bits)
                often = np.zeros(len(found), bool)
                for r in batch.column("replies")[k].as_py():
                    a, b = edges[r["part"]], edges[r["part"] + 1]
                    often[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a)
                at, inverse = at[often[inverse]], inverse[often[inverse]]
                order = np.argsort(inverse, kind="stable")
                at = at[order]
                ends = np.flatnonzero(tids == 0)
                line = np.searchsorted(ends, at)
                pos = at - np.append(0, ends + 1)[line]
                counts, kept = np.bincount(inverse, minlength=len(found))[often], found[often]
                edges, upto = _parted(kept, bits, part_bits), np.append(0, np.cumsum(counts))
                for p in range(1 << part_bits):
                    a, b = edges[p], edges[p + 1]
                    if a < b:
                        some = slice(upto[a], upto[b])
                        doc = docs[line[some]]
                        yield _batch(posted, [p], [int(doc.min())], [pack(np.diff(kept[a:b].astype(np.int64), prepend=0))], [pack(counts[a:b])], [pack(doc - doc.min())], [pack(numbers[line[some]])], [pack(pos[some])])

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.repeat(np.cumsum(unpack(r["keys"])), unpack(r["counts"])) for r in rows])
        docs = np.concatenate([unpack(r["docs"]) + r["base"] for r in rows])
        numbers, pos = (np.concatenate([unpack(r[c]).astype(np.int32) for r in rows]) for c in ("numbers", "pos"))
        order = np.lexsort((pos, numbers, docs, keys))
        keys, docs, numbers, pos = (x[order] for x in (keys, docs, numbers, pos))
        gram = np.append(True, keys[1:] != keys[:-1])
        line = gram | np.append(True, (docs[1:] != docs[:-1]) | (numbers[1:] != numbers[:-1]))
        first, begins = np.flatnonzero(line), np.flatnonzero(gram)
        edges = lambda at, n: pa.array(np.append(at, n).astype(np.int32))
        offsets = pa.ListArray.from_arrays(edges(first, len(pos)), pa.array(pos))
        each = pa.StructArray.from_arrays([pa.array(docs[first]), pa.array(numbers[first]), offsets], ["doc_id", "line_no", "offsets"])
        postings = pa.ListArray.from_arrays(edges(np.searchsorted(first, begins), len(first)), each)
        both = (keys[begins].astype(np.uint64) * np.uint64(undo)) & np.uint64(2**bits - 1)
        both = np.stack([both // np.uint64(terms), both % np.uint64(terms)], 1).astype(np.int32).reshape(-1) - 1
        grams = pa.ListArray.from_arrays(pa.array(np.arange(len(begins) + 1, dtype=np.int32) * 2), pa.array(both.astype(np.int32)))
        return pa.table({"gram": grams, "postings": postings, "support": pa.array(np.diff(np.append(begins, len(keys)))), "part": pa.array(np.full(len(begins), rows[0]["part"], np.int32))})

    replies = placed.select("block", "tids").mapInArrow(send, "part int, block long, keys binary, counts binary").groupBy("part").applyInArrow(count, "block long, part int, bits binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("replies"))
    places = placed.join(replies, "block").mapInArrow(post, "part int, base long, keys binary, counts binary, docs binary, numbers binary, pos binary")
    return places.groupBy("part").applyInArrow(gather, "gram array<int>, postings array<struct<doc_id:long,line_no:int,offsets:array<int>>>, support long, part int")


def decoded_positions(index: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``ngram, doc_id, line_no, pos`` of stored lists with their ``part``; every id must be in the dictionary."""
    terms = index.select("part", F.explode("gram").alias("tid")).distinct().join(dictionary.select("tid", "word"), "tid", "left")
    word = F.coalesce("word", F.raise_error(F.concat(F.lit("unknown term id "), F.col("tid").cast("string"))).cast("string"))
    names = terms.groupBy("part").agg(F.collect_list(F.struct("tid", word.alias("word"))).alias("names"))
    schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("tids", "lengths", "sizes", "docs", "numbers", "pos"))])
    cells, step = blocks.CELLS, ROWS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            grams, lists = batch.column("gram"), batch.column("postings")
            offsets = lists.values.field("offsets")
            docs, numbers, pos = lists.values.field("doc_id").to_numpy(), lists.values.field("line_no").to_numpy(), offsets.values.to_numpy()
            of_gram, of_list, of_line = (x.offsets.to_numpy().astype(np.int64) for x in (grams, lists, offsets))
            ends = of_line[of_list]
            stop = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
            a = 0
            while a < len(part):
                b = min(int(stop[np.searchsorted(stop, a, "right")]), max(a + 1, int(np.searchsorted(ends, ends[a] + cells, "right")) - 1))
                x, y = of_list[a], of_list[b]
                times = np.diff(of_line[x : y + 1])
                columns = grams.values.to_numpy()[of_gram[a] : of_gram[b]], np.diff(of_gram[a : b + 1]), np.diff(ends[a : b + 1]), np.repeat(docs[x:y], times), np.repeat(numbers[x:y], times), pos[ends[a] : ends[b]]
                yield _batch(schema, [part[a]], *([pack(c.astype(np.int64))] for c in columns))
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tids, lengths, sizes, docs, numbers, pos = (unpack(batch.column(c)[k].as_py()) for c in ("tids", "lengths", "sizes", "docs", "numbers", "pos"))
                own = batch.column("names")[k].values
                known = own.field("tid").to_numpy()
                order = np.argsort(known)
                words = own.field("word").take(pa.array(order[np.searchsorted(known, tids, sorter=order)]))
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), words), " ")
                which = np.repeat(np.arange(len(sizes)), sizes)
                for a in range(0, len(pos), step):
                    b = a + step
                    yield pa.RecordBatch.from_arrays([texts.take(pa.array(which[a:b])), pa.array(docs[a:b]), pa.array(numbers[a:b].astype(np.int32)), pa.array(pos[a:b].astype(np.int32))], ["ngram", "doc_id", "line_no", "pos"])

    rows = index.select("part", "gram", "postings").mapInArrow(packed, "part int, tids binary, lengths binary, sizes binary, docs binary, numbers binary, pos binary")
    return rows.join(names, "part").select(*schema.names, "names").mapInArrow(run, "ngram string, doc_id long, line_no int, pos int")
