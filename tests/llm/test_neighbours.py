import numpy as np

from termloom.llm.neighbours import Setting, footrule, measured_setting, nearest

SCHEMA = "vec_id long, embedding array<float>, score string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, ids, q, k):
    x = np.array(vectors, np.float32).astype(float)
    n = np.sqrt((x * x).sum(1))
    score = x @ x[q] / (n * n[q])
    order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != ids[q]][:k]
    return [ids[i] for i in order], score[order]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1_500, 32))
    df = table(spark, vectors)
    out = nearest(df, df.where("vec_id % 50 = 0")).collect()
    hits = 0
    for q in range(0, 1_500, 50):
        got = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        want, _ = brute(vectors, np.arange(1_500), q, 5)
        hits += len({r["vec_id"] for r in got} & set(want))
        x = vectors.astype(np.float32).astype(float)
        for r in got:
            a, b = x[q], x[r["vec_id"]]
            assert abs(r["score"] - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert hits / (30 * 5) >= 0.9


def test_small_tables_are_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 8)).astype(np.float32)
    vectors = base[rng.integers(0, 6, 80)]
    ids = rng.permutation(80)
    df = table(spark, vectors, ids)
    out = nearest(df, chunk=7).collect()
    for q in range(80):
        want, _ = brute(vectors, ids, q, 5)
        got = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == ids[q]), key=lambda r: r["rank"])]
        assert got == want


def test_invalid_vectors_and_few_rows(spark):
    bad = [None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 2, 3], []]
    df = table(spark, [*bad, [1, 0], [1, 1], [1, 0], [2, 0]], [*range(7), 10, 11, None, 12])
    out = nearest(df).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in out} == {(10, 1, 12), (10, 2, 11), (12, 1, 10), (12, 2, 11), (11, 1, 10), (11, 2, 12)}
    assert nearest(df.where("vec_id = 11")).collect() == []
    assert nearest(df.limit(0)).collect() == []
    twice = df.where("vec_id >= 10").unionByName(df.where("vec_id = 10"))
    assert sorted(map(tuple, nearest(twice).collect())) == sorted(map(tuple, nearest(df).collect()))


def test_nothing_is_missed_where_all_files_are_read_without_limit(spark):
    rng = np.random.default_rng(7)
    loose = rng.standard_normal((800, 32))
    hot = rng.standard_normal(32) * 4 + rng.standard_normal((1_200, 32))
    for vectors in (loose, np.concatenate([loose, hot])):
        # Every query reads every file, and files are of hundreds of vectors: nothing may be missed.
        df, n = table(spark, vectors), len(vectors)
        out = nearest(df, df.where("vec_id % 50 = 0"), pivots=4, setting=Setting(1, 4, 10_000), chunk=600).collect()
        for q in range(0, n, 50):
            want, _ = brute(vectors, np.arange(n), q, 5)
            assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_recall_of_clusters_and_of_a_hot_cluster(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 24)) * 3
    clusters = centres[rng.integers(0, 40, 4_000)] + rng.standard_normal((4_000, 24))
    hot = np.concatenate([rng.standard_normal((2_000, 24)), rng.standard_normal(24) * 4 + rng.standard_normal((2_000, 24))])
    for vectors in (clusters, hot):
        df = table(spark, vectors)
        out = nearest(df, df.where("vec_id % 50 = 0")).collect()
        hits = sum(len({r["vec_id"] for r in out if r["query_id"] == q} & set(brute(vectors, np.arange(4_000), q, 5)[0])) for q in range(0, 4_000, 50))
        assert hits / 400 >= 0.9


def test_setting_reads_little_of_clustered_data():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((64, 24)) * 5
    pivots = centres / np.linalg.norm(centres, axis=1)[:, None]
    near = measured_setting(centres, [c + rng.standard_normal((5, 24)) * 0.3 for c in centres], pivots, 0.95)
    assert near.post * near.probe <= 4
    loose = measured_setting(rng.standard_normal((64, 24)), [rng.standard_normal((5, 24)) for _ in range(64)], pivots, 0.95)
    assert loose.post * loose.probe > 30 and loose.limit > near.limit


def test_footrule_is_the_displacement_of_pivots():
    orders, prefixes = np.array([[2, 0, 1], [4, 3, 2]], np.int16), np.array([[2, 0], [0, 4]], np.int16)
    assert footrule(orders, prefixes, 5).tolist() == [[0, 1 + 2], [2 + 2, 3 + 1]]


def test_queries_that_are_no_rows_of_the_table(spark):
    df = table(spark, [[1, 0], [0, 1], [0.9, 0.1], [0.1, 0.9]])
    asked = table(spark, [[0.2, 1.0], [1.0, 0.2], [1, 0], None], [-7, 7, 0, 5])
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, asked, k=2).collect())
    assert out == [(-7, 1, 3), (-7, 2, 1), (0, 1, 2), (0, 2, 3), (7, 1, 2), (7, 2, 0)]
