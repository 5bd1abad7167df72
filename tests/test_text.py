import pytest
from pyspark.sql import functions as F

from termloom.functions.text import normalize, tokenize

#: line, words with empties dropped, words as a split at white space leaves them
TABLE = [
    ("", [], [""]),
    ("   ", [], []),
    ("...", [], []),
    (" a b ", ["a", "b"], ["", "a", "b"]),
    ("a  b", ["a", "b"], ["a", "b"]),
    ("It's", ["it's"], ["it's"]),
    ("'", ["'"], ["'"]),
    ("Ünïcode x", ["n", "code", "x"], ["", "n", "code", "x"]),
    ("a\tb", ["a", "b"], ["a", "b"]),
    ("(a) b!", ["a", "b"], ["", "a", "b"]),
]


@pytest.mark.parametrize(("mode", "column"), [("drop", 1), ("reference", 2)])
def test_tokenizer_table(spark, mode, column):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(TABLE)], "i int, line string")
    got = {r["i"]: r["w"] for r in df.select("i", tokenize(F.col("line"), mode).alias("w")).collect()}
    assert [got[i] for i in range(len(TABLE))] == [row[column] for row in TABLE]


def test_normalize_and_bad_mode(spark):
    assert spark.range(1).select(normalize(F.lit("A-b'C é9"))).first()[0] == "a b'c  9"
    with pytest.raises(ValueError):
        tokenize(F.lit("a"), "other")
