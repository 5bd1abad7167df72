import random

import numpy as np

from termloom.llm.mixing import fit_rates, mix, mixed_documents, rate_after

from .conftest import LONG


def brute_rates(p, steps):
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0, r - p @ np.array(g))
    return r


def test_fit_meets_targets_and_equals_numpy(spark):
    rng = np.random.default_rng(2)
    n, p = rng.integers(1, 200, 300), rng.dirichlet([0.3, 0.3, 0.3], 300)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    supply = n @ p
    steps = fit_rates(df, [0.5, 0.3, 0.2], tolerance=1e-4, repeats=1.0, most_steps=100)
    assert len(steps) < 40
    from pyspark.sql import functions as F

    r = np.array([x[0] for x in df.select(rate_after(steps, F.col("p"))).collect()])
    goal = np.minimum(np.array([0.5, 0.3, 0.2]) * supply[0] / 0.5, supply)
    assert (r >= 0).all()
    assert np.abs((n * r) @ p - goal).max() <= 2e-4 * goal.sum()
    assert np.allclose(r, brute_rates(p, steps))
    assert fit_rates(df.where("n_tokens < 0"), [1.0, 1.0, 1.0]) == []


def corpus():
    rng = random.Random(7)
    words = {"good": ["calm", "river", "stone"], "bad": ["spam", "click", "offer"]}
    made = [(rng.choice(["good", "good", "bad"])) for _ in range(300)]
    texts = [" ".join(rng.choice(words[d] + ["the", "of", "and"]) for _ in range(rng.randint(8, 80))) for d in made]
    return texts, made


def test_posteriors_and_copies(spark, docs_of):
    texts, made = corpus()
    odd = ["", None, LONG]
    df = docs_of([*texts, *odd], [*range(len(texts) + 2), None])
    known = spark.createDataFrame([(i, d) for i, d in enumerate(made[:150])] + [(None, "bad"), (3, None), (4, "other")], "doc_id long, domain string")
    out = mix(df, known, {"good": 0.9, "bad": 0.1}).collect()
    assert len(out) == len(texts) + 3
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in out)
    rest = [r for r in out if r["doc_id"] is not None and 150 <= r["doc_id"] < len(texts)]
    assert np.mean([(r["p"][1] > 0.5) == (made[r["doc_id"]] == "good") for r in rest]) > 0.95
    used = np.array([[r["n_tokens"] * r["rate"] * x for x in r["p"]] for r in out]).sum(0)
    assert abs(used[1] / used.sum() - 0.9) < 0.01
    mixed = mixed_documents(df.withColumnRenamed("kept", "a b.c"), known, {"good": 0.9, "bad": 0.1})
    mixed = mixed.withColumnRenamed("a b.c", "kept")
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in out)


def test_empty_table_and_no_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert mix(docs_of([]), none, {"a": 1.0, "b": 1.0}).collect() == []
    (row,) = mix(docs_of(["x y"]), none, {"a": 1.0, "b": 1.0}).collect()
    assert (row["p"], row["rate"], row["copies"]) == ([0.5, 0.5], 1.0, 1)
