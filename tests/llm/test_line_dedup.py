import random
import string

from termloom.llm.line_dedup import LevelledRuns, line_dedup

from .conftest import LONG

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(SPACE).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def brute(texts, ids, chars=40, docs=5):
    holders = {}
    for t, i in zip(texts, ids, strict=True):
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for t, i in zip(texts, ids, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= docs and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(df, **options):
    return sorted(tuple(r) for r in line_dedup(df, **options).select("doc_id", "n_lines", "n_dropped", "kept_text").collect())


def test_against_brute_force(docs_of):
    rng = random.Random(2)
    lines = [f"{'Common line number ' * 3}{i}" for i in range(6)] + [" \t" + "COMMON LINE NUMBER " * 3 + "1\r", "short", "", "é" * 40, "É" * 40, "x" * 39]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["", None, "\n", LONG, "a\n" * 3_000]
    ids = rng.sample(range(10_000), len(texts))
    assert run(docs_of(texts, ids)) == brute(texts, ids)
    assert run(docs_of(texts, ids), hot_docs=3, batches=4, fanout=2) == brute(texts, ids)  # hot lines are broadcast


def test_repeated_rows_count_once_and_empty_table(docs_of):
    line = "y" * 50
    texts = [line] * 6
    assert [r[2] for r in run(docs_of(texts, [1, 1, 2, 3, 4, 4]))] == [0] * 6  # four documents
    assert [r[2] for r in run(docs_of([*texts, line], [1, 1, 2, 3, 4, 4, 5]))] == [1, 1, 1, 1, 1, 1, 0]
    assert run(docs_of([])) == []
    found = line_dedup(docs_of([line] * 6, [None, 1, 2, 3, 4, None])).collect()
    assert sorted(r["n_dropped"] for r in found) == [0, 1, 1, 1, 1, 1]


def test_runs_are_disjoint_and_compacted(spark):
    state = LevelledRuns(spark, fanout=2, buckets=3)
    for i in range(5):
        batch = spark.range(i * 5, i * 5 + 10).selectExpr("unhex(md5(string(id))) AS hash", "1L AS docs", "id AS max_doc")
        state.add(batch)
    assert [len(level) for level in state.levels] == [1, 0, 1]
    runs = state.runs()
    assert sum(r.count() for r in runs) == 30
    totals = {r["docs"] for r in state.totals().collect()}
    assert totals == {1, 2} and state.totals().count() == 30
