import corpus_pipeline

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages_return_documents_and_only_drop_or_repeat(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    schema, counts = docs.dtypes, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.dtypes == schema, name
        rows = docs.collect()
        assert all(texts[r["doc_id"]] == r["text"] for r in rows)
        counts.append(len(rows))
    assert all(a >= b for a, b in zip(counts, counts[1:], strict=False)) and counts[-1] > 0.6 * counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == {r["doc_id"] for r in rows}
    assert pieces.length.sum() == pieces[pieces.start == 0].doc_tokens.sum()


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and {"op7_exact_dedup", "op8_line_dedup"} <= set(entry.oracle_sql())


def test_null_texts_repeated_identifiers_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    good, other = "the river ran past the old mill and nobody spoke for a while " * 3, "a clock on the customs house struck nine and the ferry left for the island " * 3
    rows = [(1, good), (1, good), (2, good), (3, None), (4, ""), (5, other), (5, good + "x"), (None, other + "y"), (6, "word " * 30_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("some", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame([(i, t, "en", "s", 1) for i, t in some], schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        sizes = [docs.count()]
        for stage, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, at)
            if stage != "packing":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
                docs.write.parquet(f"{at}/{stage}")
                docs = spark.read.parquet(f"{at}/{stage}")
                sizes.append(docs.count())
        pieces = docs.toPandas()
        assert sizes == sorted(sizes, reverse=True)
        if not some:
            assert len(pieces) == 0
            continue
        # Without bad examples nothing is rejected; copies of one text and its near copy go. The near
        # copy without an identifier is linked with nothing, and stays.
        assert sizes == [9, 9, 6, 5, 5]
        assert sorted(pieces.doc_id.dropna().unique().tolist()) == [1, 3, 5, 6] and pieces.doc_id.isna().any()
        for _, g in pieces.sort_values("start").groupby("doc_id", dropna=False):
            assert g.length.sum() == g.doc_tokens.iloc[0]
