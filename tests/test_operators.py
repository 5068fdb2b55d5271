"""Small literal cases of the graph engine's operators, readers, stores and streams."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import beam, extraction, processors, retrieval, triples, vector, versions
from loomgraph.operators import filters as f
from loomgraph.operators.graph import Graph
from loomgraph.sources import readers, stores
from loomgraph.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_friendship_chain(spark):
    g = Graph(docs(spark, "Alice KNOWS Brian. Brian KNOWS Carla. Carla KNOWS David"))
    assert (g.entity.count(), g.relation.count(), g.fact.count(), g.supports.count()) == (4, 3, 3, 3)
    assert {r["predicate"] for r in g.fact.collect()} == {"KNOWS"}


def test_a_shared_fact_stays_until_its_last_source_goes(spark):
    g = Graph(docs(spark, "Alice knows Brian", "Alice knows Brian"))
    assert (g.fact.count(), g.supports.count()) == (1, 2)
    one = versions.delete_sources(g, F.col("source") == "s0")
    assert (one["fact"].count(), one["supports"].count(), one["entity"].count()) == (1, 1, 2)
    both = versions.delete_sources(g, F.lit(True))
    assert [both[k].count() for k in both] == [0] * len(both)


def test_local_entity_moves_to_the_real_one(spark):
    g = Graph(docs(spark, "Brian meets Brian. Alice knows Brian"))
    local = g.entity.where("is_local").first()
    assert local["class"] == "unknown"
    assert g.rewritten_entity_fact().where(F.col("entity_id") == local["entity_id"]).count() == 0


def test_version_ladder(spark):
    r = spark.createDataFrame([("d", 1000), ("d", 2000), ("d", 3000), ("d", 4000)], "k string, valid_from long")
    v = versions.intervals(r, "k")
    at = lambda t: [x["valid_from"] for x in v.where(f.version_predicate("AT", t)).collect()]
    assert [at(t) for t in (999, 1000, 1999, 2500, 9999)] == [[], [1000], [1000], [2000], [4000]]
    assert [x["valid_from"] for x in v.where(f.version_predicate("CURRENT")).collect()] == [4000]
    more = versions.insert_versions(v, spark.createDataFrame([("d", 2500)], "k string, valid_from long"), "k")
    assert rows(more.select("valid_from", "valid_to"))[1:3] == [(2000, 2500), (2500, 3000)]


def test_round_robin(spark):
    df = spark.createDataFrame([(1, "A", [0.0]), (2, "A", [0.1]), (3, "A", [0.2]), (4, "B", [0.3]), (5, "B", [0.4]), (6, "C", [0.5])], "id int, g string, embedding array<float>")
    assert [r["id"] for r in vector.diverse_top_k(df, [0.0], 4, "id", "g").collect()] == [1, 4, 6, 2]
    some = df.withColumn("g", F.when(F.col("id") < 6, F.col("g")))
    assert [r["id"] for r in vector.diverse_top_k(some, [0.0], 3, "id", "g").collect()] == [1, 2, 3]


def test_duplicate_statements_add_up(spark):
    df = spark.createDataFrame([("s", "t", "x", 0.9, "a"), ("s", "t", "x", 0.8, "b")], "source_id string, topic string, statement string, score double, retriever string")
    (r,) = processors.dedup_merge(df).collect()
    assert (round(r["score"], 6), r["retrievers"]) == (1.7, "a,b")


def test_token_budgets(spark):
    df = spark.createDataFrame([("s", "t", "a", 3.0), ("s", "t", "b", 2.0), ("s", "u", "c", 1.0)], "source_id string, topic string, statement string, score double")
    kept = lambda d: sorted(r["statement"] for r in d.collect())
    assert kept(processors.token_budget(df, 20, F.lit(10))) == ["a", "b"]
    assert kept(processors.token_budget(df, 5, F.lit(10))) == ["a"]
    assert kept(processors.token_budget_per_topic(df, 20, F.lit(10))) == ["a", "c"]


def test_diversity_is_greedy(spark):
    items = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, rank int")
    pairs = spark.createDataFrame([(2, 1, 0.99), (3, 2, 0.99)], "a int, b int, sim double")
    assert sorted(r["id"] for r in processors.greedy_diversity(pairs, items).collect()) == [1, 3]


def test_filters_on_dirty_metadata(spark):
    df = spark.createDataFrame([(1, "7", "2024-01-05"), (2, "x", "never"), (3, None, None)], "id int, n string, at_date string")
    ids = lambda x: sorted(r["id"] for r in df.where(f.compile(x, F.col)).collect())
    assert ids(f.Leaf("n", "GT", 5)) == [1]
    assert ids(f.Leaf("n", "NE", "7")) == [2]
    assert ids(f.Leaf("at_date", "GTE", datetime(2024, 1, 1))) == [1]
    assert ids(f.Leaf("n", "IS_EMPTY")) == [3]
    assert ids(f.none_of(f.all_of(f.Leaf("n", "EQ", "x")))) == [1, 3]
    with pytest.raises(ValueError):
        f.none_of(f.Leaf("n", "EQ", 1))


GRAPH = [("Organization", "FOUNDED_BY", "John Doe"), ("Organization", "LOCATED_IN", "Portland"), ("John Doe", "FOUNDED", "Organization"), ("Portland", "LOCATED_IN", "Oregon")]


def test_triples(spark):
    t = spark.createDataFrame(GRAPH, "src string, rel string, dst string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    assert triples.one_hop(t, node("Organization")).count() == 2
    assert triples.multi_hop(t, node("Organization")).count() == 4
    assert [r["path"] for r in triples.follow(t, node("Organization"), ["LOCATED_IN", "LOCATED_IN"]).collect()] == [["Organization", "LOCATED_IN", "Portland", "LOCATED_IN", "Oregon"]]
    (p,) = triples.shortest_paths(t, node("Organization"), node("Oregon")).collect()
    assert p["hops"] == 2
    assert [r[0] for r in triples.follow(t, node("Organization"), ["LOCATED_IN"]).select(triples.verbalize_path(F.col("path"))).collect()] == ["Organization -> LOCATED_IN -> Portland"]


def test_triple_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("s,r,o,x\na,b,c,1\nd,e\n")
    assert rows(triples.read_csv(spark, str(tmp_path / "t.csv"))) == [("a", "b", "c")]
    (tmp_path / "t.nt").write_text('<a> <b> <c> .\n# no\n<a> <n> "x y"@en .\n')
    assert rows(triples.read_ntriples(spark, str(tmp_path / "t.nt"))) == [("a", "b", "c"), ("a", "n", "x y")]


def test_extraction_text(spark):
    text_ = "hello\ntopic: The_First thing\nentities:\nAnn|person\nBob (b)|person\nproposition: Ann knows Bob.\nAnn|knows|Bob\nAnn|is|tall\nEve|likes|tea\nsome detail"
    got = extraction.parse(spark.createDataFrame([(1, text_)], "id int, t string"), "id", "t")
    assert rows(got.select("kind", "topic", "subject", "predicate", "object")) == sorted([
        ("ENTITY", "First thing", "Ann", "", "Person"), ("ENTITY", "First thing", "Bob", "", "Person"), ("SPO", "First thing", "Ann", "KNOWS", "Bob"), ("SPC", "First thing", "Ann", "IS", "tall"),
        ("LOCAL", "First thing", "Eve", "LIKES", "tea"), ("DETAIL", "First thing", "some detail", "", ""), ("GARBAGE", "", "hello", "", ""),
    ])


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(text.search_str(F.lit("Éa--b_c  D!")), text.label_from(F.lit("big RED dog")), text.relationship_name(F.lit("is a")), text.clean(F.lit("The_cat (x) sat.")), text.is_write(F.lit("/* set */ MATCH")), text.is_write(F.lit("MATCH DELETE")), text.section(F.lit("<a> x </a>"), "a")).first()
    assert tuple(got) == ("éa b c d", "BigRedDog", "IS_A", "cat sat", False, True, "x")


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\n\nnot json\n{"text": "two"}\n')
    assert sorted(r["text"] for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "text").collect()) == ["one", "two"]
    with pytest.raises(Exception, match="not JSON"):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), "text", strict=True).collect()
    (tmp_path / "b.json").write_text(json.dumps([{"text": "x"}, {"text": "y"}]))
    assert sorted(r["text"] for r in readers.json_array(spark, str(tmp_path / "b.json")).collect()) == ["x", "y"]
    (tmp_path / "c.csv").write_text("p,q\n1,2\n")
    assert [r["text"] for r in readers.structured(spark, str(tmp_path / "c.csv"), ["p", 1], "-").collect()] == ["1-2"]
    (tmp_path / "d.md").write_text("# One\ntext\n## Two\nmore\n")
    assert [(r["seq"], r["header"]) for r in readers.markdown(spark, str(tmp_path)).orderBy("seq").collect()] == [(0, "One"), (1, "Two")]
    (tmp_path / "e.json").write_text('{"a": {"b": [1, 2]}}')
    assert [r["text"] for r in readers.json_tree(spark, str(tmp_path / "e.json")).collect()] == ["a b 1\na b 2"]
    pages = spark.createDataFrame([("u", "<title>A &lt; B</title><p>x</p>")], "url string, html string")
    assert tuple(readers.web(pages).first()) == ("u", "A < B", "A < B x")


def test_stores(spark, tmp_path):
    s = stores.for_connection(f"parquet://{tmp_path}/g")
    s.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), "t", "id")
    s.upsert(spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"), "t", "id")
    assert rows(s.read(spark, "t")) == [("a", 1), ("b", 2), ("c", 2)]
    other = stores.ParquetStore(s.path, "acme")
    other.append(spark.createDataFrame([("z", 9)], "id string, v int"), "t")
    assert (other.read(spark, "t").count(), s.read(spark, "t").count()) == (1, 3)
    with pytest.raises(PermissionError):
        stores.ParquetStore(s.path, read_only=True).append(spark.range(1), "t")
    assert stores.for_connection("dummy://").read(spark, "t").count() == 0
    with pytest.raises(ValueError):
        stores.for_connection("what://")


def test_streaming_ingest_may_run_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"doc_id": 1, "text": "Alice knows Brian", "lang": "en", "source": "s", "n_chars": 17}
    (tmp_path / "in" / "1.json").write_text(json.dumps(line))
    store = stores.ParquetStore(str(tmp_path / "graph"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k in (1, 2):
        ingest.start(ingest.documents(spark, str(tmp_path / "in"), schema), ingest.build_batch(store), str(tmp_path / f"check{k}")).awaitTermination()
    assert {n: store.read(spark, n).count() for n in ingest.NODES} == {"source": 1, "chunk": 1, "topic": 1, "statement": 1, "fact": 1, "entity": 2}
    assert {n: store.read(spark, n).count() for n in ("topic_chunk", "supports", "entity_fact", "relation")} == {"topic_chunk": 1, "supports": 1, "entity_fact": 2, "relation": 1}
    run = ingest.version_batch(store, "k")
    for batch in ([("d", 1000), ("d", 3000)], [("d", 2000)], [("d", 2000)]):
        run(spark.createDataFrame(batch, "k string, valid_from long"), 0)
    assert rows(store.read(spark, "version").select("valid_from", "valid_to")) == [(1000, 2000), (2000, 3000), (3000, f.UPPER)]


def test_beam_keeps_the_best(spark):
    e = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(8)], "node int, embedding array<float>")
    links = spark.createDataFrame([(i, i + 1) for i in range(7)], "node int, other int")
    found = beam.search(spark.createDataFrame([(2,)], "node int"), lambda level: links.join(level, "node"), e, [1.0, 1.0], depth=3, width=3)
    assert [(r["node"], r["path"]) for r in found.collect()] == [(5, [2, 3, 4, 5]), (4, [2, 3, 4]), (3, [2, 3])]


def test_search_returns_statements_of_the_seeds(spark):
    g = Graph(docs(spark, "Alpha knows Brian. Alpha likes Carla", "Other words entirely"))
    c = g.chunk.where("doc_id = 0").select("chunk_id")
    assert retrieval.grouped(g, retrieval.chunk_statements(g, c)).count() == 2
