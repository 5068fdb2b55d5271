"""Facts of a statement are looked for once; a stored graph writes what is used, and shuffles texts once."""

import os

from pyspark.sql import functions as F

from loomgraph.operators import rerank, retrieval
from loomgraph.operators.graph import Graph, rule_facts

TEXTS = ["Alpha river flows. Stone delta stands\nMarket signal. Stone stone", "quiet engine. Alpha river flows. Stone delta stands", "Stone market. Alpha stone", "", None]


def graph(spark):
    return Graph(spark.createDataFrame([(i, t, "en", f"s{i}", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_looked_for_once(spark):
    g = graph(spark)
    assert plan(g.statement_fact).count("regexp_extract_all") == 1
    assert plan(g.entity_fact).count("regexp_extract_all") == 1 and plan(g.entity).count("regexp_extract_all") == 1
    (r,) = spark.createDataFrame([("Stone the river flows",)], "v string").select(rule_facts(F.col("v")).alias("f")).collect()
    assert tuple(r["f"]) == ("Stone", "RIVER", "flows")


def test_texts_are_shuffled_once(spark):
    g = graph(spark)
    for df in (g.chunk, g.statement, g.topic, g.topic_chunk, g.previous, g.statement_fact):
        assert exchanges(df)[1] == 1


def test_only_what_is_used_is_written(spark, tmp_path):
    g = graph(spark).stored(str(tmp_path / "g"))
    g.relation.count()
    assert sorted(os.listdir(tmp_path / "g")) == ["marked", "relation", "statement_fact"]


def test_neighbours_are_those_of_the_joined_tables(spark, tmp_path):
    g = graph(spark).stored(str(tmp_path / "g"))
    of = lambda key: {(r[key], r["entity_id"]) for r in g.entities_at.select(key, "entity_id").distinct().collect()}
    at, topics = of("chunk_id"), of("topic_id")
    degree = {r["entity_id"]: r["degree"] for r in g.degree.collect()}
    for seed in sorted({c for c, _ in at}):
        top = sorted((e for c, e in at if c == seed), key=lambda e: (-degree[e], e))[:5]
        shared = {}
        for c, e in at:
            if e in top and c != seed:
                shared[c] = shared.get(c, 0) + 1
        got = retrieval.chunk_neighbours(g, spark.createDataFrame([(seed,)], "chunk_id string")).collect()
        assert {r["other_id"]: r["shared"] for r in got} == shared
    mine = {e for t, e in topics if t == min(topics)[0]}
    got = retrieval.topic_neighbours(g, spark.createDataFrame([(min(topics)[0],)], "topic_id string")).where("kind = 'entity'").collect()
    assert {r["other_id"] for r in got} <= {t for t, e in topics if e in mine} - {min(topics)[0]}


def test_grams_of_long_texts(spark):
    long = "Öffa ß𝄞b " * 20_000
    (r,) = rerank.score(spark.createDataFrame([(1, long), (2, None), (3, "")], "id long, text string"), spark.createDataFrame([(1, "öffa")], "m long, text string"), "id", "text").collect()
    assert r["id"] == 1 and r["score"] > 0.3
