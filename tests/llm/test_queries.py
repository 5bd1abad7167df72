"""The registered queries on the smallest tables: columns, types, and what their contracts say."""

import zlib

import numpy as np
import pytest

from termloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_chat_format": {"conv_id": "bigint", "position": "bigint", "rendered": "string"},
    "op3_mixing": {"doc_id": "bigint", "n_tokens": "bigint", "rate": "double", "copies": "int"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op7_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op8_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op9_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").toPandas()


def result(spark, name):
    df = queries.queries()[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    return df.toPandas()


def test_every_operator_has_a_query():
    assert set(queries.queries()) == set(COLUMNS)


def test_packing_holds_every_token_once(spark, table):
    got, docs = result(spark, "op1_packing"), table("documents")
    assert set(got.doc_id) == set(docs.doc_id)
    for _, g in got.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == g.doc_tokens.iloc[0]
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and filled.sum() >= 0.9 * 2048 * len(filled)


def test_chats_and_mixing_keep_every_row(spark, table):
    assert len(result(spark, "op2_chat_format")) == len(table("conversations"))
    got = result(spark, "op3_mixing")
    assert sorted(got.doc_id) == sorted(table("documents").doc_id)
    assert np.allclose(got.p_clean + got.p_low + got.p_toxic, 1) and (got.rate >= 0).all() and (abs(got.copies - got.rate) < 1).all()


def test_quality_tells_labels_apart(spark, table):
    got = result(spark, "op4_quality")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    known = got.merge(table("labels"), on="doc_id")
    assert known[known.quality == 1].score.mean() > known[known.quality == 0].score.mean() + 0.3


def test_neighbours_are_found(spark, table):
    got, vectors = result(spark, "op5_neighbours"), table("embeddings")
    x, ids = np.array(vectors.embedding.tolist(), float), vectors.vec_id.to_numpy()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = asked = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        score[q] = -2
        hits += len(set(ids[np.argsort(-score)[:5]]) & set(got[got.query_id == ids[q]].vec_id))
        asked += 5
    assert len(got) == asked and hits / asked >= 0.9


def test_language_model_beats_the_base(spark, table):
    got = result(spark, "op6_language_model")
    assert sorted(got.doc_id) == sorted(table("documents").doc_id)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 7 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_near_copies_by_brute_force(spark, table):
    from .test_near_dedup import brute

    docs = table("documents")
    got = result(spark, "op9_near_dedup")
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].to_numpy().tolist())) == brute(docs.text.tolist(), docs.doc_id.tolist())
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_pages_and_deduplication_keep_every_row(spark, table):
    pages = result(spark, "op10_html_text")
    assert sorted(pages.page_id) == sorted(table("pages").page_id) and (pages.n_chars == pages.text.str.len()).all()
    docs = sorted(table("documents").doc_id)
    assert sorted(result(spark, "op7_exact_dedup").doc_id) == docs == sorted(result(spark, "op8_line_dedup").doc_id)
