import random

import numpy as np

from termloom.llm.components import connected_components
from termloom.llm.near_dedup import BITS, SAMPLES, drop_near_copies, most_different_bits, most_fine_bits, near_duplicates, odd_sketch, samples, shingles
from termloom.llm.scratch import Scratch

from .conftest import LONG


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(texts, ids):
    found = sets_of(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if found[i] and found[j] and ids[i] is not None and ids[j] is not None:
                both = len(found[i] & found[j])
                if 100 * both >= 75 * (len(found[i]) + len(found[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    return sorted((ids[i], len(found[i]), least[find(i)] if found[i] else ids[i]) for i in range(len(texts)) if ids[i] is not None)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 160))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return texts + ["", None, "a b", "A  b", "a b c", " ", LONG, LONG + "x", texts[0].upper()]


def run(df, **options):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df, **options).collect())


def test_against_brute_force(docs_of):
    for seed, chunk in ((1, 1_024), (2, 4)):  # chunks of 4: buckets are cut, and later rounds join the parts
        texts = corpus(seed)
        ids = random.Random(seed).sample(range(10_000), len(texts))
        assert run(docs_of(texts, ids), chunk=chunk) == brute(texts, ids)


def hidden_link(seed):
    """Two groups joined by the texts 22 and 23 only; closer pairs of them that are no links come first in the lists."""
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n)]
    before, core, one, other = words(28), words(89), words(15), words(14)
    texts = [core + one, *(core + other + words(1) for _ in range(20))]
    texts += [before[5:] + core + one + words(2), before + core + one + words(2), before + core + other + words(3)]
    texts[21][-2:] = texts[22][-2:]
    return [" ".join(t) for t in texts]


def test_a_list_full_of_refuted_pairs_does_not_end_the_rounds(docs_of):
    texts = hidden_link(0)
    want = brute(texts, range(24))
    assert {c for *_, c in want} == {0}
    assert run(docs_of(texts)) == want


def test_rows_that_share_an_identifier_are_documents_of_their_own(docs_of):
    rng = random.Random(3)
    one, other = ([rng.choice("abcdefgh") + rng.choice("uvwxyz") + str(rng.randint(0, 99)) for _ in range(60)] for _ in range(2))
    rows = [(1, one), (1, other), (2, [*other, "end"]), (0, one[:58]), (2, ["alone"] * 9), (2, [*other, "end"])]
    for order in (range(6), (1, 0, 2, 3, 4, 5), (5, 4, 3, 2, 1, 0)):
        ids, texts = [rows[i][0] for i in order], [" ".join(rows[i][1]) for i in order]
        df = docs_of(texts, ids)
        assert run(df) == brute(texts, ids)
        kept = drop_near_copies(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((i, " ".join(w)) for i, w in rows if (i, w) in ((0, one[:58]), (1, other), (2, ["alone"] * 9)))


def test_large_buckets_are_cut(docs_of):
    """Texts that share most of their words, in groups whose links cross the chunks."""
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    shared, texts = words(70), []
    for _ in range(40):
        own = words(rng.randint(18, 40))
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join([*shared, *own[: rng.randint(14, 40)], *words(rng.randint(0, 3))]))
    ids = rng.sample(range(1_000), len(texts))
    assert run(docs_of(texts, ids), chunk=8) == brute(texts, ids)


def test_identifiers_that_are_no_numbers(spark):
    df = spark.createDataFrame([("b", "a b c d e f"), ("a`", "a b c d e f"), ("c", "x")], "`doc id` string, text string")
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df, id_col="doc id").collect()}
    assert out == {("b", "a`", False), ("a`", "a`", True), ("c", "c", True)}


def test_filter_null_ids_and_empty_table(docs_of):
    texts, ids = ["a b c d e f", "a b c d e f", "x", "a b c d e f"], [7, 3, 5, None]
    df = docs_of(texts, ids)
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert out == {(7, 3, False), (3, 3, True), (5, 5, True), (None, None, True)}
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {3, 5, None}
    assert near_duplicates(docs_of([])).collect() == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for share in (0.6, 0.75, 0.9):
        errors = []
        for _ in range(30):
            common, own = rng.integers(0, 1 << 63, int(1_000 * share), dtype=np.uint64), int(1_000 * (1 - share) / 2)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(2))
            x, y = (np.frombuffer(odd_sketch(samples(s)), np.uint8) for s in (a, b))
            bits = int(np.bitwise_count(x ^ y).sum())
            errors.append(1 + BITS / (4 * SAMPLES) * np.log(1 - 2 * bits / BITS) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    assert most_different_bits(0.9) < most_different_bits(0.7)
    assert most_fine_bits(np.array([1e9]), 0.75)[0] >= 1_000  # large sets are always confirmed on the full sets
    assert len(shingles([1, 2, 3])) == 1 and len(shingles([])) == 0


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(501, 500), (500, 501), (502, 502)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(links, Scratch(spark, "test"), "chain").collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}
