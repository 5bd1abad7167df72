import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termloom.llm.packing import ShardIndex, pack, pack_shard
from termloom.llm.tokens import WordTokenizer, serialised_tokenizer

from .conftest import LONG

TEXTS = ["The quick brown fox", "", None, "éa 12 don't stop. <|endoftext|>", LONG, "ΣΑΣ İ x y", "same words here", "same words here", "a\x1cb"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(serialised_tokenizer(), capacity=500)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("abcé .,!0'\ńİΣK\x1f", max_size=60), max_size=8))
def test_tokens_equal_the_tokenizer(words, reference, texts):
    assert [list(x) for x in words.encode_batch(texts)] == [reference(t) for t in texts]


def test_texts_longer_than_a_segment(words, reference):
    for text in ("wörter aber " * 90_000, "x " + "y" * (1 << 20), "a" * 10):
        assert list(words.encode_batch([text])[0]) == reference(text)


@pytest.mark.parametrize("window", [8, 2048])
def test_every_id_lies_in_one_piece(spark, docs_of, reference, window):
    df = docs_of(TEXTS, [*range(len(TEXTS) - 1), None])
    rows = pack(df, window=window, shard_tokens=50).toPandas() if window == 8 else pack(df).toPandas()
    by_doc = rows.assign(doc_id=rows.doc_id.fillna(-1)).sort_values("start").groupby("doc_id")
    assert by_doc.ngroups == len(TEXTS)
    for i, text in zip([*range(len(TEXTS) - 1), -1], TEXTS, strict=True):
        g = by_doc.get_group(i)
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in g.ids])
        assert ids.tolist() == [*reference(text), 1]
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert set(g.doc_tokens) == {len(ids)}
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows.itertuples())
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        total = int(g.length.sum())
        assert total <= window and set(g.padded_length) == {total if total & (total - 1) == 0 else window}
    lean = pack(df, window=window, with_ids=False).toPandas()
    assert "ids" not in lean and lean.length.sum() == rows.length.sum()


def test_document_frequencies_cover_every_document(docs_of):
    from pyspark.sql import functions as F

    from termloom.llm.packing import _term_counts, _tokenise

    source = docs_of([f"common {'odd' if i % 3 == 0 else ''}" for i in range(900)]).select("doc_id", "text").coalesce(1)
    encoded = _tokenise(source, serialised_tokenizer(), 2048, 128, False)
    counts = _term_counts(encoded)
    assert (counts[-1], counts[1]) == (900, 900)
    assert sorted(counts.values())[:1] == [300] and encoded.agg(F.sum("n")).first()[0] == counts[-2]


def test_document_frequencies_count_whole_documents(docs_of):
    from termloom.llm.packing import _term_counts, _tokenise

    texts = ["common " + "word " * n for n in range(40)]
    source = docs_of(texts).select("doc_id", "text").coalesce(1)
    large, small = (_term_counts(_tokenise(source, serialised_tokenizer(), window, 128, False)) for window in (2048, 4))
    parts = (-2, -3)
    assert small[-1] == 40 and {t: n for t, n in small.items() if t not in parts} == {t: n for t, n in large.items() if t not in parts}
    assert large[-3] == 40 and 0 < small[-3] < 40 and small[-2] < large[-2]


def test_repeated_rows_and_empty_table(docs_of):
    assert pack(docs_of([])).collect() == []
    rows = pack(docs_of(["a b", "a b"], [1, 1])).collect()
    assert sum(r["length"] for r in rows) == 6


def test_index_scores_are_bm25():
    docs = [np.array(x) for x in ([1, 1, 2], [2, 3], [4], [1, 4, 4, 4])]
    idf = np.array([0, 0.7, 0.4, 1.1, 0.9])
    got = ShardIndex(docs, idf, 2.5).scores(np.array([1, 4]))
    for d, score in zip(docs, got, strict=True):
        want = sum(idf[t] * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / 2.5)) for t in (1, 4))
        assert score == pytest.approx(want, rel=1e-5)


def test_neighbours_share_windows():
    rng = np.random.default_rng(0)
    topics = [rng.choice(np.arange(100 * k, 100 * k + 40), 30) for k in range(4) for _ in range(8)]
    order = rng.permutation(len(topics))
    idf = np.full(500, 1.0)
    windows = pack_shard([topics[i] for i in order], idf, 30.0, 60)
    same = sum(len({order[d] // 8 for d, _, _ in w}) == 1 for w in windows)
    assert same >= 0.8 * len(windows)
    assert sum(n for w in windows for _, _, n in w) == 30 * 32
    assert all(sum(n for *_, n in w) == 60 for w in windows)


def test_neighbours_fill_the_window_however_short():
    # Two topics in turns, 300 documents of 10 ids each: a window has room for more neighbours than are taken at a time.
    docs = [np.repeat([k % 2, 10 + k], [1 + k // 2 % 9, 9 - k // 2 % 9]) for k in range(600)]
    windows = pack_shard(docs, np.full(700, 1.0), 10.0, 2_000)
    assert sum(n for w in windows for _, _, n in w) == 6_000
    assert [{d % 2 for d, _, _ in w} for w in windows] == [{0}, {1}, {0, 1}]


def test_common_terms_count_where_others_find_nothing():
    # All terms are common; documents share one with those of their own kind only.
    docs = [np.array([k % 2] * 10) for k in range(40)]
    windows = pack_shard(docs, np.full(2, 0.5), 10.0, 100, np.ones(2, bool))
    assert all(len({d % 2 for d, _, _ in w}) == 1 for w in windows) and sum(n for w in windows for *_, n in w) == 400


def test_few_documents_have_neighbours(docs_of):
    rows = pack(docs_of([("left " if k % 2 else "right ") * 40 for k in range(12)]), window=128).toPandas()
    for _, g in list(rows.groupby("sequence_id"))[:2]:
        assert len(set(g.doc_id % 2)) == 1


def test_words_with_one_hash_keep_their_own_ids(words, reference):
    # Of a Thue-Morse word and its complement, polynomial hashes modulo 2^64 are equal for every base.
    word = "a"
    while len(word) < 2_048:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    for texts in ([word, other], [other, word, other], [f"{word} x {other}"]):
        assert [list(x) for x in words.encode_batch(texts)] == [reference(t) for t in texts]
