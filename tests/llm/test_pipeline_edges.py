"""Every stage on empty tables, nulls in any column, repeated rows and columns with clashing names."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, gone int, __gone int, c0 int, `a.b` string"


def test_edges(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    row = lambda i, t: (i, t, None, None, None, "x", 1, 2, 3, "y")
    rows = [row(1, words), row(1, words), row(2, words), row(3, other), row(None, other + " more of it"), row(4, None), row(5, ""), row(6, "word " * 5)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        if name == "quality_rules":
            assert [i for i, _ in got] == [1, 1, 2, 3, None]
        if name == "near_duplicates":
            assert [i for i, _ in got] == [1, 1, 3, 4, 5, 6, None]
        if name == "repeated_strings":
            assert dict((i, t) for i, t in got if i in (1, 2, 4)) == {1: words, 2: "", 4: None}
            assert (None, other + " more of it") in got and len(got) == len(rows)
        if name == "decontamination":
            assert len(got) == len(rows)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert sorted(r["n_tokens"] > 0 for r in last(spark, docs, str(tmp_path)).collect()) == [False] * 2 + [True] * 6
