"""Contexts, beams, mixes and the question-answering loop on small graphs, against plain Python."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import context as c
from loomgraph.operators import dialects, engine, results, retrievers
from loomgraph.operators import filters as f
from loomgraph.operators.graph import Graph

TEXTS = ["Alice KNOWS Brian. Brian KNOWS Carla. Carla KNOWS David\nAlice HATES Frank", "Brian LIKES Carla. Frank KNOWS Alice", "Zelda KNOWS Zelda. Alice KNOWS Carla"]


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    rows = [(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(TEXTS)]
    return Graph(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).stored(str(tmp_path_factory.mktemp("graph")))


def phrases(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "m long, text string")


def test_keywords_restricted_by_class(spark, g):
    names = {r["entity_id"]: (r["value"], r["class"]) for r in g.entity.collect()}
    words = spark.createDataFrame([("alice",), ("fra",), ("carla|Nothing",), ("nobody",)], "keyword string")
    got = {(r["keyword"], names[r["entity_id"]][0], r["score"]) for r in c.entity_lookup(g, words).collect()}
    degree = {names[r["entity_id"]][0]: r["degree"] for r in g.degree.collect()}
    assert got == {("alice", "Alice", degree["Alice"]), ("fra", "Frank", degree["Frank"])}
    kind = next(k for v, k in names.values() if v == "Carla")
    (one,) = c.entity_lookup(g, spark.createDataFrame([(f"carla|{kind}",)], "keyword string")).collect()
    assert one["value"] == "Carla"


def test_entity_contexts_are_the_walks_in_python(spark, g):
    e = {r["entity_id"]: r for r in g.entity.where("not is_local").collect()}
    degree = {r["entity_id"]: r["degree"] for r in g.degree.collect()}
    out = {}
    for r in g.relation.collect():
        out.setdefault(r["src"], set()).add(r["dst"])
    roots = sorted((i for i in e if e[i]["value"] in ("Alice", "Brian")), key=lambda i: (degree[i], i), reverse=True)
    seeds = spark.createDataFrame([(i, e[i]["value"], e[i]["class"], degree[i]) for i in roots], "entity_id string, value string, class string, score long")
    got = [tuple(r) for r in c.entity_contexts(g, seeds, phrases(spark, "carla david"), low=0.0, high=10.0, most=50).collect()]
    paths = []

    def walk(path):
        later = sorted((x for x in out.get(path[-1], ()) if x in e and x not in path), key=lambda x: (-degree[x], x))[: len(path) + 2]
        paths.append(path)
        if len(path) < 3:
            for x in later:
                walk([*path, x])

    for r in roots:
        walk([r])
    keys = {",".join(e[x]["value"].lower() for x in p): p for p in paths}
    want = {", ".join(e[x]["value"] for x in p): p[0] for k, p in keys.items() if not any(o != k and o.startswith(k) for o in keys)}
    assert {(r[1], r[0]) for r in got} == set(want.items())
    order = [roots.index(r[0]) for r in got]
    assert order == sorted(order)
    for root in roots:
        scores = [r[2] for r in got if r[0] == root]
        assert scores == sorted(scores, reverse=True)
    assert len(c.entity_contexts(g, seeds, phrases(spark, "carla"), most=2).collect()) == 2
    assert c.entity_contexts(g, seeds, phrases(spark, "carla"), low=5.0, high=9.0).collect() == []


def test_beams_reach_what_breadth_first_does(spark, g):
    statements = {r["statement_id"]: r["value"] for r in g.statement.collect()}
    shared = {}
    fact = {(r["statement_id"], r["entity_id"]) for r in g.supports.join(g.entity_fact, "fact_id").collect()}
    for a, x in fact:
        shared.setdefault(a, set()).update(b for b, y in fact if x == y and a != b)
    start = next(i for i, v in statements.items() if v == "Carla KNOWS David")
    texts = g.statement.select(F.col("statement_id").alias("node"), F.col("value").alias("text"))
    from loomgraph.operators import retrieval as r

    step = lambda level: r.statement_neighbours(g, level.select(F.col("node").alias("statement_id"))).select(F.col("statement_id").alias("node"), F.col("other_id").alias("other"))
    got = {x["node"]: x["depth"] for x in retrievers.reranking_beam(spark.createDataFrame([(start,)], "node string"), step, texts, phrases(spark, "alice"), 100, 3).collect()}
    want, level = {start: 0}, {start}
    for k in (1, 2, 3):
        level = {b for a in level for b in shared.get(a, ())} - set(want)
        want |= dict.fromkeys(level, k)
    assert got == want
    narrow = retrievers.reranking_beam(spark.createDataFrame([(start,)], "node string"), step, texts, phrases(spark, "alice"), 1, 3).collect()
    assert sorted(x["depth"] for x in narrow) == [0, 1, 2, 3][: len(narrow)]


def test_searches_over_vectors(spark, g):
    chunks = [r["chunk_id"] for r in g.chunk.orderBy("chunk_id").collect()]
    vec = spark.createDataFrame([(x, [float(i), 1.0]) for i, x in enumerate(chunks)], "chunk_id string, embedding array<double>")
    near = {r["chunk_id"] for r in retrievers.semantic_chunks(g, vec, [0.0, 1.0], k=1, depth=0).collect()}
    assert near == {chunks[0]}
    more = {r["chunk_id"] for r in retrievers.semantic_chunks(g, vec, [0.0, 1.0], k=1, depth=3).collect()}
    assert near < more
    rows = retrievers.semantic_search(g, vec, [0.0, 1.0], k=1, depth=3)
    assert rows.count() == len({r["statement_id"] for r in rows.collect()}) > 0
    topics = [r["topic_id"] for r in g.topic.orderBy("topic_id").collect()]
    tv = spark.createDataFrame([(x, [float(i), 1.0]) for i, x in enumerate(topics)], "topic_id string, embedding array<double>")
    found = retrievers.topic_beam_search(g, tv, [0.0, 1.0], 1, 10, 3)
    assert {r["topic_id"] for r in found.collect()} >= {topics[0]}


def test_modes_and_contexts(spark):
    df = lambda q, k: spark.createDataFrame([(q, k)], "q string, k long")
    assert [tuple(r) for r in retrievers.by_mode(["a"], df, "whole", 10).collect()] == [("whole", 10)]
    assert sorted(tuple(r) for r in retrievers.by_mode(["a", "b", "c"], df, "whole", 10).collect()) == [("a", 4), ("b", 4), ("c", 4)]
    assert sorted(tuple(r) for r in retrievers.context_search(["x", "y", "x", "z"], df).collect()) == [("x", 2), ("y", 2)]
    assert retrievers.context_search([], df) is None


TRIPLES = [("Ada", "WORKS_AT", "Lab"), ("Lab", "LOCATED_IN", "Town"), ("Lab", "OWNS", "Ship"), ("Town", "PART_OF", "Land"), ("Ada", "LIKES", "Tea"), ("Tea", "GROWN_IN", "Land")]


def test_retrievers_over_triples(spark):
    t = spark.createDataFrame(TRIPLES, "src string, rel string, dst string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    best = engine.scored_triples(t, node("Ada"), phrases(spark, "located in which town"), 2, 1).collect()
    assert [r["text"] for r in best] == ["Lab -> LOCATED_IN -> Town"]
    paths = {r["text"] for r in engine.paths_between(t, node("Ada"), node("Land"), [["WORKS_AT", "OWNS"]]).collect()}
    assert paths == {"Ada -> LIKES > Tea > GROWN_IN -> Land", "Ada -> WORKS_AT > Lab > OWNS -> Ship"}
    met = {tuple(r) for r in engine.explore(t, node("Ada"), phrases(spark, "works at a lab located in a town"), 3, 10).collect()}
    assert met == set(TRIPLES)
    one = {tuple(r) for r in engine.explore(t, node("Ada"), phrases(spark, "works at"), 1, 1).collect()}
    assert one == {TRIPLES[0]}
    assert engine.explore(t, node("nobody"), phrases(spark, "x")).count() == 0


def test_guard_loop_and_records(spark):
    t = spark.createDataFrame(TRIPLES, "src string, rel string, dst string")
    assert json.loads(engine.guarded(spark, "SELECT count(*) AS n FROM {t}", {"t": t})) == {"n": 6}
    assert engine.guarded(spark, "/* x */ DROP TABLE t", {}).startswith("Error: the query would change")
    assert engine.guarded(spark, "SELECT * FROM nothing_there", {}).startswith("Error: ")
    steps = [lambda q, ctx: iter(["a", "b", "a"]), lambda q, ctx: iter(["b", f"n{len(ctx)}"])]
    assert engine.answer("q", steps) == ["a", "b", "n2", "n3"]
    assert engine.answer("q", steps, 5, lambda ctx: "n2" in ctx) == ["a", "b", "n2"]
    assert engine.lines_of("x <paths>\n a \n\n b\n</paths>", "paths") == ["a", "b"] and engine.lines_of("", "paths") == []
    said = engine.agentic("q", lambda q: {"context": [q, "same"], "ms": 2, "tokens": 3}, lambda q, found: [f"more {len(found)}"])
    assert said == {"iterations": 3, "questions": ["q", "more 1", "more 2"], "context": ["q", "same", "more 1", "more 2"], "ms": 6, "tokens": 9}
    assert json.loads(engine.run_record("1", "chunk", "é?", ["x"], 1.2349, 5))["ms"] == 1234
    with pytest.raises(ValueError):
        engine.run_record("1", "other", "", [], 0, 0)


def test_dialects():
    tree = f.all_of(f.Leaf("a", "EQ", 1), f.any_of(f.Leaf("b", "IN", ["x"]), f.Leaf("c", "IS_EMPTY")))
    said = dialects.to_json_ops(tree)
    assert said == {"$and": [{"a": {"$eq": 1}}, {"$or": [{"b": {"$in": ["x"]}}, {"c": {"$exists": False}}]}]}
    assert dialects.from_json_ops(said) == tree
    assert dialects.with_keys(tree, dialects.metadata_key).children[0].key == "metadata.source.metadata.a"
    assert dialects.metadata_key("valid_to") == "metadata.source.versioning.valid_to"
    with pytest.raises(ValueError):
        dialects.to_json_ops(f.none_of(tree))
    text, values = dialects.to_sql(f.none_of(f.all_of(f.Leaf("a`b", "GT", 2.5), f.Leaf("n", "NIN", [1, 2]))))
    assert "`a``b`" in text and values == [2.5, "1", "2"] and text.startswith("NOT (")


def test_formats(spark):
    rows = spark.createDataFrame([("s", "t1", 'say "x"\n<b>', 1.0), ("s", "t1", "second", 0.5), ("s", "t2", "best", 2.0)], "source string, topic string, statement string, o double")
    (r,) = results.nested(rows, "source", "topic", "statement", "o").collect()
    assert [(t["topic"], list(t["statements"])) for t in r["topics"]] == [("t2", ["best"]), ("t1", ['say "x"\n<b>', "second"])]
    said = {k: results.formatted(results.nested(rows, "source", "topic", "statement", "o"), k).first()["context"] for k in results.FORMATS}
    assert json.loads(said["json"])["topics"][1]["statements"][0] == 'say "x"\n<b>'
    assert said["text"].startswith("## t2\nbest\n[Source: s]")
    assert '    - "say \\"x\\"\\n<b>"' in said["yaml"] and "<statement>say \"x\"\n&lt;b&gt;</statement>" in said["xml"]
