"""Literal cases of what used to be capped or simplified: budgets, path lengths, long metadata, hop classes, CSV quotes, stored graphs."""

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import processors, triples
from loomgraph.operators.graph import Graph
from loomgraph.sources import readers


def test_a_budget_pays_for_more_than_ten_thousand_statements(spark):
    df = spark.range(20_000).select(F.lit("s").alias("source_id"), F.lit("t").alias("topic"), F.format_string("x%05d", "id").alias("statement"), (F.col("id") % 977).cast("double").alias("score"))
    assert processors.token_budget(df, 50_000, F.lit(1)).count() == 20_000
    assert processors.token_budget(df, 15_000, F.lit(1)).count() == 15_000
    got = processors.token_budget(df, 12_345, F.lit(1)).agg(F.min("score")).first()[0]
    assert got == sorted((k % 977 for k in range(20_000)), reverse=True)[12_344]
    free = df.withColumn("c", F.when(F.col("statement") < "x10000", 0).otherwise(1))
    assert processors.token_budget(free, 10**6, F.col("c")).count() == 20_000


def test_paths_of_any_length(spark):
    t = spark.createDataFrame([(f"n{i}", "r", f"n{i + 1}") for i in range(12)], "src string, rel string, dst string")
    node = lambda n: spark.createDataFrame([(n,)], "node string")
    assert triples.shortest_paths(t, node("n0"), node("n12")).first()["hops"] == 12
    assert triples.shortest_paths(t, node("n0"), node("n12"), 6).count() == 0
    assert triples.shortest_paths(t, node("n12"), node("n0")).count() == 0


def test_all_metadata_values_are_told(spark):
    m = {f"k{i}": f"v{i:04}" for i in range(1500)} | {"long": "the longest value"}
    (r,) = spark.createDataFrame([(m,)], "m map<string,string>").select(processors.format_sources(F.col("m")).alias("t")).collect()
    assert r["t"].startswith("the longest value (v0000, v0001") and r["t"].count(", ") == 1499


def test_hop_classes(spark):
    said = {
        "When was Ada born?": "single-hop", "How many ships that sank?": "multi-hop", "What is a cat while a dog": "multi-hop", "Why is it so?": "unknown", "Who is she and he and it": "multi-hop",
        "Which one did also win": "multi-hop", "What is it and where": "multi-hop", "When are we": "unknown", "When did it rain": "single-hop", "": "unknown", "Explain the relationship": "unknown",
    }
    df = spark.createDataFrame([(q,) for q in said], "q string")
    assert {r["q"]: r["c"] for r in df.select("q", text.hop_class(F.col("q")).alias("c")).collect()} == said
    given = {("2", None): "multi-hop", ("1", "complex"): "single-hop", (None, "Simple question"): "single-hop", (" Multi ", None): "multi-hop", ("x", "multi step"): "multi-hop", ("x", None): None}
    df = spark.createDataFrame(list(given), "h string, k string")
    assert {(r["h"], r["k"]): r["c"] for r in df.select("h", "k", text.hop_given(F.col("h"), F.col("k")).alias("c")).collect()} == given


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"a,b",3\n\n"say ""hi""",,\n')
    assert [r["text"] for r in readers.csv(spark, str(tmp_path / "a.csv")).collect()] == ['x, a,b, 3\nsay "hi", , ']
    assert sorted(r["text"] for r in readers.csv(spark, str(tmp_path / "a.csv"), False).collect()) == ['say "hi", , ', "x, a,b, 3"]


def test_stored_tables_are_the_lazy_ones(spark, tmp_path):
    texts = ["Alpha river flows. Stone delta stands\nMarket signal. Stone stone", "quiet engine. Alpha river flows", "", None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lazy, stored = Graph(docs), Graph(docs).stored(str(tmp_path / "g"))
    for name in ("source", "chunk", "statement", "previous", "supports", "entity", "entity_fact", "relation", "degree", "topic_chunk"):
        a, b = getattr(lazy, name), getattr(stored, name)
        assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
