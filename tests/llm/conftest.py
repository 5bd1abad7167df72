import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents-like table, with columns whose names clash with results."""

    def make(texts, ids=None, extra=True):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)]
        df = spark.createDataFrame(rows, "doc_id long, text string, kept string, score long")
        return df if extra else df.select("doc_id", "text")

    return make


LONG = "word " * 30_000
