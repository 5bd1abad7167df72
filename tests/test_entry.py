import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ANCHORS = {"ngrams_all_suffix": 4339, "ngrams_closed_suffix": 3242, "ngrams_maximal_suffix": 2552, "ngrams_sigma10": 5592}


def test_entry_and_anchors(spark):
    assert entry.entry(spark).count() == ANCHORS["ngrams_closed_suffix"]
    queries = entry.queries()
    for name, rows in ANCHORS.items():
        assert queries[name](spark, SF).count() == rows


def test_every_query_has_sql_with_the_same_columns():
    from termloom.plans import catalogue

    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", ["frequent_runs", "scalar_sequences", "postings_k2", "ngrams_maximal_apriori_index", "benchmark_ngrams", "stored_index", "overwrite_rules", "dropped_tables", "text_scan", "ngrams_reference_tokens", "windows_of_lines", "ngrams_unlimited", "ngrams_unlimited_closed"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_sequences_of_whole_lines(spark, tmp_path):
    texts = ["a b c d e f g h i j", " ".join(["x"] * 12 + ["y"]), "one", "", "...\nx x x x x x x x x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "scalar_sequences"
    for sf in (str(tmp_path), SF):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet{'/*.parquet' if sf != SF else ''}')")
        got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        rows = lambda df: sorted(map(str, df[sorted(want.columns)].itertuples(index=False, name=None)))
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
        if sf != SF:
            found = {(r.doc_id, r.line_no): (r.lcp_shifted, r.b_is_prefix, r.reversed) for r in got.itertuples()}
            assert found[0, 0] == (0, False, "j i h g f e d c b a")
            assert found[1, 0] == (11, False, " ".join(["y"] + ["x"] * 12))
            assert found[2, 0] == (0, True, "one") and found[4, 1][:2] == (8, True)
