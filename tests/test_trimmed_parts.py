"""Parts of texts are trimmed of space separators and of nothing else, whatever their place."""

import duckdb

from loomgraph.functions import text
from loomgraph.operators import context
from loomgraph.plans import all_queries, all_sql
from pyspark.sql import functions as F

TEXTS = ["Stone river. 19.37.233.111. 2nd market stands 2, 3 3, 1 2", "\u00a0 \u3000\nEngine\u00a0. \u2003paper signal\u00a0. 1, 21, 11", "a. 1. 1. 2. 3, 1, 2"]


def test_numbers_at_the_ends_stay(spark):
    (r,) = spark.createDataFrame([("x^1a1^2b2^ ^x",)], "t string").select(context.split_keywords(F.col("t")).alias("k")).collect()
    assert r["k"] == ["x", "1a1", "2b2"]
    (r,) = spark.createDataFrame([("w " * 30 + "first. 1 in 1? 2 of 2",)], "t string").select(context.parts_of(F.col("t")).alias("k")).collect()
    assert r["k"][1:] == ["1 in 1?", "2 of 2"]


def test_spaces_are_those_of_the_sql(spark):
    every = [chr(c) + "a" + chr(c) for c in range(1, 0x3010) if not 0xD800 <= c < 0xE000]
    got = [x[0] for x in spark.createDataFrame([(k, s) for k, s in enumerate(every)], "k int, s string").coalesce(1).orderBy("k").select(text.trim(F.col("s"))).collect()]
    assert got == [x[0] for x in duckdb.connect().execute("SELECT trim(s) FROM (SELECT unnest(?) AS s)", [every]).fetchall()]


def test_statements_and_propositions_with_numbers(spark, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("build_statements", "build_prev_statement", "build_supports", "propositions", "context_text", "build_chunks"):
        got = con.execute(all_sql()[name])
        columns = [c[0] for c in got.description]
        want = sorted(got.fetchall(), key=repr)
        assert sorted((tuple(r[c] for c in columns) for r in all_queries()[name](spark, str(tmp_path)).collect()), key=repr) == want and want
