import random

import pytest
from pyspark.sql import functions as F

from termloom import NGramType, ngram_statistics
from termloom.operators import block_levels, block_spans, blocks
from termloom.operators.blocks import unpack
from termloom.plans.api import encode_in_blocks
from termloom.sources.store import Levels

from .test_ngrams import brute, lines


def _texts() -> list[str]:
    rng = random.Random(11)
    copied = rng.choices("abcdefgh", k=12)
    return ["a a a a", " ".join(copied), " ".join(copied[2:]), *(" ".join(rng.choices("abcd", [6, 3, 2, 1], k=rng.randint(0, 8))) for _ in range(20))]


@pytest.fixture
def large(monkeypatch):
    """Tables of any size are written as large ones are."""
    for module, name, value in ((blocks, "BLOCK", 40), (blocks, "COUNTED", 60), (block_levels, "SMALL", 0), (block_spans, "SMALL", 0), (block_spans, "FINISHED", 30)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr("termloom.sources.store.release", lambda spark: None)


def test_joins_leave_bucketed_tables_where_they_are(spark, tmp_path):
    table = Levels(spark, "test").settle(spark.range(50).withColumn("kind", F.col("id") % 2), "t", by="kind", key="id")
    other = spark.range(90).groupBy("id").count().hint("merge")
    joined = table.where("kind = 0").join(other, "id", "left")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and joined.count() == 25


@pytest.mark.parametrize("kind", list(NGramType))
@pytest.mark.parametrize("length", [0, 4])
def test_ngrams_of_large_tables(spark, large, kind, length):
    rows = ngram_statistics(lines(spark, _texts()), 2, length, kind).collect()
    assert {tuple(r["ngram"].split(" ")): r["support"] for r in rows} == brute(_texts(), 2, length, kind) and len({r["ngram"] for r in rows}) == len(rows)


def test_first_state_holds_no_places(spark, large, monkeypatch):
    """They are those of the block, which is kept anyway."""
    kept, write = [], Levels.drop
    monkeypatch.setattr(Levels, "drop", lambda self, table: (kept.extend(self.spark.read.parquet(f"{self.path}/{table}").collect() if table.startswith("level-1/") else []), write(self, table))[1])
    levels = Levels(spark, "test")
    encoded, _ = encode_in_blocks(lines(spark, _texts()), 2, levels)
    block_levels.mine_levels(encoded, 2, 3, NGramType.ALL, levels)
    assert kept and all(r["n"] > 0 and not len(unpack(r["a"])) and not len(unpack(r["b"])) for r in kept)


def test_first_state_of_spans_holds_no_places(spark, large, monkeypatch):
    kept, write = [], Levels.drop
    monkeypatch.setattr(Levels, "drop", lambda self, table: (kept.extend(self.spark.read.parquet(f"{self.path}/{table}").collect() if table.startswith("round-0/") else []), write(self, table))[1])
    levels = Levels(spark, "test")
    encoded, _ = encode_in_blocks(lines(spark, _texts()), 2, levels)
    block_spans.mine_spans(encoded, 2, NGramType.MAXIMAL, levels)
    assert kept and all(r["n"] > 0 and not len(unpack(r["a"])) and not len(unpack(r["b"])) for r in kept)
