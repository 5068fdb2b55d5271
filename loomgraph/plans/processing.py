"""Filters, versions, processors, reranking, triples, metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import filters as f
from loomgraph.operators import metrics as m
from loomgraph.operators import processors as p
from loomgraph.operators import rerank as rr
from loomgraph.operators import triples as t
from loomgraph.operators import versions as ver
from loomgraph.plans.registry import base, query, table
from loomgraph.plans.searching import graph
from loomgraph.sources.shared import written


def docs(spark, d):
    return table(spark, d, "documents")


def filtered(spark, d, tree, name="documents", keep=("doc_id",), mode="dict"):
    return table(spark, d, name).where(f.compile(tree, F.col, mode)).select(*keep)


@query("SELECT doc_id FROM documents WHERE (lang = 'en' OR n_chars > 5000) AND NOT (source = 'src1' AND lang = 'en')")
def filter_and_or_not(spark, d):
    L = f.Leaf
    return filtered(spark, d, f.all_of(f.any_of(L("lang", "EQ", "en"), L("n_chars", "GT", 5000)), f.none_of(f.all_of(L("source", "EQ", "src1"), L("lang", "EQ", "en")))))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'econ') OR contains(p_name, 'ring')")
def filter_text_match(spark, d):
    return filtered(spark, d, f.any_of(f.Leaf("p_type", "TEXT_MATCH", "eCoN"), f.Leaf("p_name", "CONTAINS", "ring")), "part", ("p_partkey",))


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND source NOT IN ('src0', 'src2')")
def filter_in_nin(spark, d):
    return filtered(spark, d, f.all_of(f.Leaf("lang", "IN", ["de", "fr"]), f.Leaf("source", "NIN", ["src0", "src2"])))


@query("SELECT doc_id, coalesce(lang = 'en', false) AS en FROM (SELECT doc_id, nullif(lang, 'fr') AS lang FROM documents) WHERE lang IS NULL OR lang = '' OR lang = 'en'")
def filter_is_empty(spark, d):
    rows = docs(spark, d).select("doc_id", F.nullif(F.col("lang"), F.lit("fr")).alias("lang"))
    tree = f.any_of(f.Leaf("lang", "IS_EMPTY"), f.Leaf("lang", "EQ", "en"))
    return rows.where(f.compile(tree, F.col)).select("doc_id", f.compile(f.Leaf("lang", "EQ", "en"), F.col).alias("en"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def filter_datetime(spark, d):
    a, b = datetime(1997, 6, 1), datetime(1998, 1, 1)
    return filtered(spark, d, f.all_of(f.Leaf("o_orderdate", "GTE", a), f.Leaf("o_orderdate", "LT", b)), "orders", ("o_orderkey",))


@query("SELECT event_id FROM events WHERE (try_cast(props->>'k' AS BIGINT) > 50 AND value < 20.5) OR event_type = 'error'")
def filter_typed_numeric(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rows.where(f.compile(f.any_of(f.all_of(f.Leaf("k", "GT", 50), f.Leaf("value", "LT", 20.5)), f.Leaf("event_type", "EQ", "error")), F.col)).select("event_id")


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_nationkey = 3) OR c_mktsegment = 'HOUSEHOLD'")
def filter_from_dicts(spark, d):
    return filtered(spark, d, f.from_dicts([{"c_mktsegment": "BUILDING", "c_nationkey": 3}, {"c_mktsegment": "HOUSEHOLD"}]), "customer", ("c_custkey",))


@query("SELECT p_partkey FROM part WHERE contains(p_type, 'ECON') AND NOT (contains(lower(p_name), 'ring'))")
def filter_graph_mode(spark, d):
    return filtered(spark, d, f.all_of(f.Leaf("p_type", "TEXT_MATCH", "ECON"), f.none_of(f.all_of(f.Leaf("p_name", "TEXT_MATCH_INSENSITIVE", "Ring")))), "part", ("p_partkey",), "graph")


# versions: an event is a version of its user's record

VERSIONS = "v AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS valid_from FROM events), i AS (SELECT v.*, coalesce(n, 10000000000000) AS valid_to FROM v JOIN (SELECT user_id, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from) AS n FROM (SELECT DISTINCT user_id, valid_from FROM v)) USING (user_id, valid_from))"
T0 = 1705000000000


def versions(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("valid_from"))


def version_query(name: str, mode: str, where: str):
    @query(f"WITH {VERSIONS} SELECT event_id FROM i WHERE {where}", name)
    def run(spark, d):
        return ver.intervals(versions(spark, d), "user_id").where(f.version_predicate(mode, T0)).select("event_id")


version_query("version_current", "CURRENT", "valid_to = 10000000000000")
version_query("version_previous", "PREVIOUS", "valid_to < 10000000000000")
version_query("version_at", "AT", f"valid_from <= {T0} AND valid_to > {T0}")
version_query("version_before", "BEFORE", f"valid_to < {T0}")
version_query("version_on_or_after", "ON_OR_AFTER", f"valid_from >= {T0}")


@query(f"WITH {VERSIONS} SELECT event_id, user_id, valid_from, valid_to FROM i")
def version_intervals(spark, d):
    return ver.intervals(versions(spark, d), "user_id").select("event_id", "user_id", "valid_from", "valid_to")


@query(f"WITH {VERSIONS} SELECT event_id, user_id, valid_from, valid_to FROM i")
def version_insert_middle(spark, d):
    """Errors come late, and split the intervals of the others."""
    rows = versions(spark, d).join(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    early, late = rows.where("event_type <> 'error'").drop("event_type"), rows.where("event_type = 'error'").drop("event_type")
    return ver.insert_versions(ver.intervals(early, "user_id"), late, "user_id").select("event_id", "user_id", "valid_from", "valid_to")


DEL = "ks AS (SELECT * FROM src WHERE lang <> 'en'), kst AS (SELECT statement_id FROM statement WHERE source_id IN (SELECT source_id FROM ks)), kf AS (SELECT DISTINCT fact_id FROM supports JOIN kst USING (statement_id)), ke AS (SELECT DISTINCT entity_id FROM entity_fact JOIN kf USING (fact_id))"


@query(base("""SELECT 'source' AS label, count(*) AS n FROM ks UNION ALL SELECT 'chunk', count(*) FROM chunk WHERE source_id IN (SELECT source_id FROM ks)
UNION ALL SELECT 'topic', count(*) FROM topic WHERE source_id IN (SELECT source_id FROM ks) UNION ALL SELECT 'statement', count(*) FROM kst UNION ALL SELECT 'fact', count(*) FROM kf UNION ALL SELECT 'entity', count(*) FROM ke""", DEL))
def delete_source_cascade(spark, d):
    left = ver.delete_sources(graph(spark, d), F.col("lang") == "en")
    out = None
    for k in ("source", "chunk", "topic", "statement", "fact", "entity"):
        one = left[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(base("SELECT fact_id FROM fact WHERE fact_id NOT IN (SELECT fact_id FROM kf)", DEL))
def orphan_facts(spark, d):
    g = graph(spark, d)
    return ver.orphans(g.fact, ver.delete_sources(g, F.col("lang") == "en")["supports"], "fact_id").select("fact_id")


@query(base("SELECT entity_id FROM entity WHERE entity_id NOT IN (SELECT entity_id FROM ke)", DEL))
def orphan_entities(spark, d):
    g = graph(spark, d)
    return ver.orphans(g.entity, ver.delete_sources(g, F.col("lang") == "en")["entity_fact"], "entity_id").select("entity_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def checkpoint_filter(spark, d):
    return ver.unprocessed(docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def repair_duplicates(spark, d):
    return ver.repair_duplicates(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


# results: sources, topics, statements with scores; two retrievers find some of the same

RES = """rows AS (SELECT source_id, topic, value AS statement, length(value) % 97 / 97.0::DOUBLE AS score, 'a' AS retriever FROM ext UNION ALL
SELECT source_id, topic, value, length(value) % 31 / 31.0::DOUBLE, 'b' FROM ext WHERE length(value) % 2 = 0)"""


def results(spark, d):
    e = graph(spark, d).extracted.select("source_id", "topic", F.col("value").alias("statement"))
    n = F.length("statement")
    a = e.select("*", (n % 97 / 97.0).alias("score"), F.lit("a").alias("retriever"))
    return a.unionByName(e.where(n % 2 == 0).select("*", (n % 31 / 31.0).alias("score"), F.lit("b").alias("retriever")))


def short(df, *more):
    """Statements as digests, so that results are small to compare."""
    return df.withColumn("statement", F.md5(F.col("statement").cast("binary")))


@query(base("SELECT source_id, topic, md5(statement) AS statement, round(sum(score), 6) AS score, array_to_string(list_sort(list(DISTINCT retriever)), ',') AS retrievers FROM rows GROUP BY source_id, topic, rows.statement", RES))
def dedup_merge(spark, d):
    return short(p.dedup_merge(results(spark, d))).withColumn("score", F.round("score", 6))


@query(base("SELECT source_id, topic, round(max(score), 6) AS result_score FROM rows GROUP BY ALL", RES))
def disaggregate(spark, d):
    return p.disaggregate(results(spark, d)).withColumn("result_score", F.round("result_score", 6))


SCORED = RES + ", sc AS (SELECT source_id, max(m) AS result_score FROM (SELECT source_id, topic, avg(score) AS m FROM rows GROUP BY ALL) GROUP BY source_id)"


@query(base("SELECT source_id, round(result_score, 6) AS result_score FROM sc", SCORED))
def rescore(spark, d):
    return p.rescore(results(spark, d)).withColumn("result_score", F.round("result_score", 6))


@query(base("SELECT source_id, topic, md5(statement) AS statement, round(score, 6) AS score, retriever FROM rows WHERE score >= 0.5 * (SELECT max(score) FROM rows)", RES))
def prune_statements(spark, d):
    return short(p.prune_statements(results(spark, d), 0.5)).withColumn("score", F.round("score", 6))


@query(base("SELECT source_id, round(result_score, 6) AS result_score FROM sc WHERE result_score >= 0.7", SCORED))
def prune_results(spark, d):
    return p.prune_results(p.rescore(results(spark, d)), 0.7).withColumn("result_score", F.round("result_score", 6))


MERGED = RES + ", mg AS (SELECT source_id, topic, statement, round(sum(score), 9) AS score FROM rows GROUP BY ALL)"


def merged(spark, d):
    return p.dedup_merge(results(spark, d)).drop("retrievers").withColumn("score", F.round("score", 9))


@query(base("SELECT source_id, topic, md5(statement) AS statement, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_id, topic ORDER BY score DESC, statement) AS rn FROM mg) WHERE rn <= 3", MERGED))
def truncate_statements(spark, d):
    return short(p.truncate_statements(merged(spark, d), 3)).withColumn("score", F.round("score", 6))


@query(base("SELECT source_id, round(s, 6) AS result_score FROM (SELECT source_id, round(result_score, 9) AS s FROM sc ORDER BY s DESC, source_id LIMIT 5)", SCORED))
def truncate_results(spark, d):
    return p.truncate_results(p.rescore(results(spark, d)).withColumn("result_score", F.round("result_score", 9))).withColumn("result_score", F.round("result_score", 6))


@query(base("SELECT source_id, topic, md5(statement) AS statement, cost FROM (SELECT *, sum(cost) OVER (ORDER BY score DESC, source_id, topic, statement) AS spent, row_number() OVER (ORDER BY score DESC, source_id, topic, statement) AS rn FROM (SELECT *, length(statement) // 4 AS cost FROM mg)) WHERE spent <= 3000 OR rn = 1", MERGED))
def token_budget_global(spark, d):
    return short(p.token_budget(merged(spark, d), 3000, text.token_cost(F.col("statement")))).drop("score")


@query(base("SELECT source_id, topic, md5(statement) AS statement, cost FROM (SELECT *, sum(cost) OVER (PARTITION BY source_id, topic ORDER BY score DESC, statement ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY source_id, topic ORDER BY score DESC, statement) AS rn FROM (SELECT *, length(statement) // 4 AS cost FROM mg)) WHERE rn = 1 OR spent <= 400000 // (SELECT count(*) FROM (SELECT DISTINCT source_id, topic FROM mg))", MERGED))
def token_budget_per_topic(spark, d):
    return short(p.token_budget_per_topic(merged(spark, d), 400_000, text.token_cost(F.col("statement")))).drop("score")


@query(base("SELECT statement_id, md5(s.value || CASE WHEN len(fs) > 0 THEN ' (details: ' || array_to_string(fs, ', ') || ')' ELSE '' END) AS told FROM statement s LEFT JOIN (SELECT statement_id, list_sort(list(value)) AS fs FROM (SELECT DISTINCT statement_id, value FROM supports JOIN fact USING (fact_id)) GROUP BY statement_id) USING (statement_id)"))
def statement_strings(spark, d):
    g = graph(spark, d)
    facts = g.supports.join(g.fact, "fact_id").groupBy("statement_id").agg(F.sort_array(F.collect_set("value")).alias("facts"))
    rows = g.statement.select("statement_id", F.col("value").alias("statement")).join(facts, "statement_id", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))
    return p.statement_strings(rows).select("statement_id", F.md5(F.col("statement_str").cast("binary")).alias("told"))


@query("SELECT p_partkey, a[1] || ' (' || a[2] || ', ' || a[3] || ')' AS longest, p_brand AS first, 'Part ' || p_name || ' by ' || p_brand || '.' AS filled FROM (SELECT *, list_transform(list_sort(list_transform([p_name, p_brand, p_type], lambda x: {'l': -length(x), 'x': x})), lambda y: y.x) AS a FROM part)")
def format_sources(spark, d):
    keys = ("p_name", "p_brand", "p_type")
    meta = F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k))))
    return table(spark, d, "part").select("p_partkey", p.format_sources(meta).alias("longest"), p.format_sources(meta, ["p_size", "p_brand"]).alias("first"), p.format_sources(meta, template="Part $p_name by $p_brand.").alias("filled"))


@query(base("SELECT source_id, CASE WHEN n > 1 THEN topic END AS topic, count(*) AS statements FROM ext JOIN (SELECT source_id, count(DISTINCT topic) AS n FROM ext GROUP BY source_id) USING (source_id) GROUP BY ALL"))
def single_topic_flatten(spark, d):
    e = graph(spark, d).extracted.select("source_id", "topic")
    return p.single_topic_flatten(e).groupBy("source_id", "topic").agg(F.count(F.lit(1)).alias("statements"))


# reranking: benchmark items as values, the customers' segments as match texts

def grams(v: str) -> str:
    return f"CASE WHEN length({v}) = 0 THEN [] WHEN length({v}) < 3 THEN [{v}] ELSE list_transform(range(1, length({v}) - 1), lambda i: substr({v}, i, 3)) END"


def tfidf(values: str, matches: str, primary: int = 10**6) -> str:
    """SQL of id and score; values: id, text; matches: m, text."""
    return f"""tf AS (SELECT id, gram, count(*) AS tf FROM (SELECT id, unnest({grams('lower(text)')}) AS gram FROM ({values})) GROUP BY ALL),
idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM ({values}))) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY gram),
w0 AS (SELECT id, gram, tf * idf AS w FROM tf JOIN idf USING (gram)), w AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w0),
qf AS (SELECT m, gram, count(*) AS tf FROM (SELECT m, unnest({grams('lower(text)')}) AS gram FROM ({matches})) GROUP BY ALL),
q0 AS (SELECT m, gram, tf * idf AS w FROM qf JOIN idf USING (gram)), q AS (SELECT m, gram, w / sqrt(sum(w * w) OVER (PARTITION BY m)) AS v FROM q0),
sim AS (SELECT id, m, sum(w * v) * CASE WHEN m >= {primary} THEN 0.9::DOUBLE ELSE 1 END AS s FROM w JOIN q USING (gram) GROUP BY id, m),
tfidf AS (SELECT id, sum(s) / (SELECT count(*) FROM ({matches})) AS score FROM sim GROUP BY id)"""


MATCH = "SELECT event_type AS text, row_number() OVER (ORDER BY event_type) AS m FROM (SELECT DISTINCT event_type FROM events)"


def matches(spark, d):
    from pyspark.sql import Window

    kinds = table(spark, d, "events").select(F.col("event_type").alias("text")).distinct()
    return kinds.withColumn("m", F.row_number().over(Window.orderBy("text")))


@query(f"WITH {tfidf('SELECT item_id AS id, text FROM benchmark', MATCH, 4)} SELECT id AS item_id, round(score, 4) AS score FROM tfidf")
def tfidf_rerank(spark, d):
    return rr.score(table(spark, d, "benchmark"), matches(spark, d), "item_id", "text", 4).withColumn("score", F.round("score", 4))


STATEMENT_TEXT = "SELECT statement_id AS id, t.value || ': ' || s.value AS text FROM statement s JOIN topic t USING (topic_id)"


@query(base("SELECT id AS statement_id, round(score, 4) AS score FROM tfidf", tfidf(STATEMENT_TEXT, "SELECT text, item_id AS m FROM benchmark")))
def statement_rerank(spark, d):
    """All statements of the graph, as 'topic: statement', by their mean similarity to the benchmark's texts."""
    g = graph(spark, d)
    told = g.statement.join(g.topic.select("topic_id", F.col("value").alias("topic")), "topic_id").select("statement_id", F.concat("topic", F.lit(": "), "value").alias("text"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("m"), "text")
    return rr.score(written(told, "told"), asked, "statement_id", "text").withColumn("score", F.round("score", 4))


TOPIC_TEXT = "SELECT topic_id AS id, topic || ' ' || string_agg(value, ' ' ORDER BY seq, pos) AS text FROM ext GROUP BY topic_id, topic"


@query(base("SELECT id AS topic_id, round(s, 4) AS score FROM (SELECT id, round(score, 9) AS s FROM tfidf ORDER BY s DESC, id LIMIT 40)", tfidf(TOPIC_TEXT, MATCH)))
def topic_rerank(spark, d):
    """The 40 best topics by their name and statements."""
    e = graph(spark, d).extracted
    told = e.groupBy("topic_id", "topic").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "value"))).alias("s"))
    told = told.select("topic_id", F.concat_ws(" ", "topic", F.array_join(F.col("s.value"), " ")).alias("text"))
    best = rr.score(written(told, "told"), matches(spark, d), "topic_id", "text").withColumn("s", F.round("score", 9)).orderBy(F.desc("s"), "topic_id").limit(40)
    return best.select("topic_id", F.round("s", 4).alias("score"))


@query(base("SELECT id AS entity_id, round(score, 4) AS rerank, degree FROM tfidf JOIN degree ON id = entity_id", tfidf("SELECT entity_id AS id, lower(value || ' (' || class || ')') AS text FROM entity", MATCH)))
def entity_rerank(spark, d):
    g = graph(spark, d)
    named = g.entity.select("entity_id", F.lower(F.format_string("%s (%s)", "value", "class")).alias("text"))
    return rr.score(named, matches(spark, d), "entity_id", "text").join(g.degree, "entity_id").select("entity_id", F.round("score", 4).alias("rerank"), "degree")


# triples over the order tables

TRIPLES = """tri AS (SELECT 'c' || o_custkey AS src, 'PLACED' AS rel, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || l_orderkey, 'CONTAINS', 'p' || l_partkey FROM lineitem
UNION ALL SELECT 'p' || l_partkey, 'SUPPLIED_BY', 's' || l_suppkey FROM lineitem UNION ALL SELECT 'c' || c_custkey, 'IN_NATION', 'n' || c_nationkey FROM customer
UNION ALL SELECT 's' || s_suppkey, 'IN_NATION', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'IN_REGION', 'r' || n_regionkey FROM nation)"""


def triples(spark, d):
    def edge(name, a, pa, rel, b, pb):
        return table(spark, d, name).select(F.concat(F.lit(pa), a).alias("src"), F.lit(rel).alias("rel"), F.concat(F.lit(pb), b).alias("dst"))

    parts = [
        edge("orders", "o_custkey", "c", "PLACED", "o_orderkey", "o"), edge("lineitem", "l_orderkey", "o", "CONTAINS", "l_partkey", "p"), edge("lineitem", "l_partkey", "p", "SUPPLIED_BY", "l_suppkey", "s"),
        edge("customer", "c_custkey", "c", "IN_NATION", "c_nationkey", "n"), edge("supplier", "s_suppkey", "s", "IN_NATION", "s_nationkey", "n"), edge("nation", "n_nationkey", "n", "IN_REGION", "n_regionkey", "r"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def some(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"WITH {TRIPLES} SELECT DISTINCT src, rel, dst FROM tri WHERE src IN ('c1', 'c4', 'n3')")
def triples_one_hop(spark, d):
    return t.one_hop(triples(spark, d), some(spark, "c1", "c4", "n3"))


@query(f"WITH {TRIPLES}, h1 AS (SELECT DISTINCT * FROM tri WHERE src IN ('c1', 'c4')) SELECT * FROM h1 UNION SELECT tri.* FROM tri WHERE src IN (SELECT dst FROM h1)")
def triples_multi_hop(spark, d):
    return t.multi_hop(triples(spark, d), some(spark, "c1", "c4"))


@query(f"WITH {TRIPLES} SELECT DISTINCT a.src || ' -> PLACED > ' || a.dst || ' > CONTAINS > ' || b.dst || ' > SUPPLIED_BY -> ' || c.dst AS text FROM tri a JOIN tri b ON a.dst = b.src JOIN tri c ON b.dst = c.src WHERE a.rel = 'PLACED' AND b.rel = 'CONTAINS' AND c.rel = 'SUPPLIED_BY' AND a.src IN ('c1', 'c4')")
def triples_metapath(spark, d):
    return t.follow(triples(spark, d), some(spark, "c1", "c4"), ["PLACED", "CONTAINS", "SUPPLIED_BY"]).select(t.verbalize_path(F.col("path")).alias("text"))


@query(f"WITH {TRIPLES} SELECT text FROM (SELECT DISTINCT a.src || ' -> PLACED > ' || a.dst || ' > CONTAINS -> ' || b.dst AS text FROM tri a JOIN tri b ON a.dst = b.src WHERE a.rel = 'PLACED' AND b.rel = 'CONTAINS' AND a.src IN ('c1', 'c4'))")
def triples_path_verbalize(spark, d):
    return t.follow(triples(spark, d), some(spark, "c1", "c4"), ["PLACED", "CONTAINS"]).select(t.verbalize_path(F.col("path")).alias("text"))


@query(f"""WITH RECURSIVE {TRIPLES}, e AS (SELECT DISTINCT * FROM tri WHERE src <> dst),
l1 AS (SELECT dst AS node, min([src, rel, dst]) AS path FROM e WHERE src = 'c1' GROUP BY dst),
l2 AS (SELECT dst AS node, min(list_concat(path, [rel, dst])) AS path FROM l1 JOIN e ON node = src WHERE dst NOT IN (SELECT node FROM l1) AND dst <> 'c1' GROUP BY dst),
l3 AS (SELECT dst AS node, min(list_concat(path, [rel, dst])) AS path FROM l2 JOIN e ON node = src WHERE dst NOT IN (SELECT node FROM l1 UNION SELECT node FROM l2) AND dst <> 'c1' GROUP BY dst),
a AS (SELECT node, path, 1 AS hops FROM l1 UNION ALL SELECT node, path, 2 FROM l2 UNION ALL SELECT node, path, 3 FROM l3)
SELECT node AS target, path, hops FROM a WHERE node LIKE 'r%' OR node LIKE 's%'""")
def triples_shortest_path(spark, d):
    x = triples(spark, d)
    goal = x.select(F.col("dst").alias("node")).where("node like 'r%' or node like 's%'")
    return t.shortest_paths(x, some(spark, "c1"), goal, 3)


@query(f"WITH {TRIPLES} SELECT src || ' -> ' || rel || ' -> ' || string_agg(dst, ' | ' ORDER BY dst) AS text FROM (SELECT DISTINCT * FROM tri) GROUP BY src, rel")
def triples_merge_verbalize(spark, d):
    return t.verbalize_merged(triples(spark, d))


@query(f"WITH {TRIPLES} SELECT DISTINCT src[1:1] AS from_type, rel, dst[1:1] AS to_type FROM tri")
def triples_schema(spark, d):
    return t.schema(triples(spark, d), F.substring("src", 1, 1), F.substring("dst", 1, 1))


@query("""SELECT q, v, round(score, 4) AS score, rn AS rank FROM (SELECT q, v, 100 * (1 - levenshtein(lower(q), lower(v)) / greatest(length(q), length(v))) AS score,
row_number() OVER (PARTITION BY q ORDER BY 100 * (1 - levenshtein(lower(q), lower(v)) / greatest(length(q), length(v))) DESC, v) AS rn
FROM (SELECT DISTINCT c_name AS v FROM customer), (SELECT 'Costumer#00042' AS q UNION ALL SELECT 'customer 7' UNION ALL SELECT 'CUSTOMER#000000100') WHERE length(v) + 4 >= length(q)) WHERE rn <= 3""")
def fuzzy_link(spark, d):
    q = spark.createDataFrame([("Costumer#00042",), ("customer 7",), ("CUSTOMER#000000100",)], "q string")
    return t.fuzzy_link(q, table(spark, d, "customer").select(F.col("c_name").alias("v"))).select("q", "v", F.round("score", 4).alias("score"), "rank")


# metrics

@query("SELECT event_type, count(value) AS n, round(avg(value), 2) AS avg_ms, round(quantile_cont(value, 0.5), 2) AS p50_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms FROM events GROUP BY event_type")
def metrics_latency(spark, d):
    return m.latency(table(spark, d, "events"), "event_type", "value")


@query("""SELECT lang, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(avg(i), 2) AS avg_input, round(avg(o), 2) AS avg_output, count(*) FILTER (i IS NULL OR o IS NULL) AS missing,
round((coalesce(sum(i), 0) * 1.0 + coalesce(sum(o), 0) * 5.0) / 1e6, 6) AS cost FROM (SELECT lang, n_chars // 4 AS i, CASE WHEN source <> 'src0' THEN n_chars // 16 END AS o FROM documents) GROUP BY lang""")
def metrics_tokens_cost(spark, d):
    n = F.col("n_chars")
    return m.tokens_cost(docs(spark, d), "lang", F.floor(n / 4), F.when(F.col("source") != "src0", F.floor(n / 16)), 1.0, 5.0)


GRADED = "g AS (SELECT lang, quality, toxic, text, n_chars FROM documents JOIN labels USING (doc_id))"


def graded(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("grade", F.when(F.col("quality") == 1, "correct").otherwise("incorrect"))


@query(f"WITH {GRADED} SELECT lang, count(*) AS n, round(avg(quality), 5) AS correctness, round(avg(toxic), 5) AS idk_rate FROM g GROUP BY lang")
def metrics_correctness_idk(spark, d):
    return m.correctness(graded(spark, d), "lang", F.col("grade"), F.col("toxic") == 1)


@query(f"WITH {GRADED} SELECT lang, round(coalesce(avg(quality) FILTER (toxic <> 1), 0), 5) AS correct_on_answerable FROM g GROUP BY lang")
def metrics_correct_on_answerable(spark, d):
    return m.correct_on_answerable(graded(spark, d), "lang", F.col("grade"), F.col("toxic") == 1)


@query(f"WITH {GRADED}, s AS (SELECT lang, round(avg(quality), 5) AS correctness, sum(n_chars) / 1e6 AS seconds, round(sum(n_chars // 4) / 1e6, 6) AS cost FROM g GROUP BY lang) SELECT *, round(correctness / seconds, 6) AS per_second, round(correctness / cost, 6) AS per_cost FROM s")
def metrics_comparison(spark, d):
    g = graded(spark, d)
    s = m.correctness(g, "lang", F.col("grade"), F.lit(False)).select("lang", "correctness").join(g.groupBy("lang").agg((F.sum("n_chars") / 1e6).alias("seconds"), F.round(F.sum(F.floor(F.col("n_chars") / 4)) / 1e6, 6).alias("cost")), "lang")
    return m.comparison(s, "lang")


HOP = r"""CASE WHEN len(regexp_extract_all(q, '\band\b')) > 1 OR regexp_matches(q, '\b(both|as well as|before|after|while|during|compared to|versus|more than|less than|difference between)\b')
OR regexp_matches(q, '\bhow many\b.*\bthat\b') OR regexp_matches(q, '\bwhich\b.*\balso\b') OR regexp_matches(q, '\bwhat\b.*\band\b.*\b(what|who|where|when|how)\b') THEN 'multi-hop'
WHEN regexp_matches(q, '^(what|who|when|where) (is|was)\b') OR regexp_matches(q, '^(what|who|where) are\b') OR regexp_matches(q, '^(when did|what does|who does)\b') THEN 'single-hop' ELSE 'unknown' END"""
OPENINGS = ["What is ", "Which of both is ", "", "When was ", "How many ships that are ", "Who did what while ", "When did and and ", "What are "]
ASKED = f"({OPENINGS})[conv_id % 8 + 1] || role"


def asked():
    return F.concat(F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("conv_id") % 8 + 1).cast("int")), F.col("role"))


@query(f"SELECT conv_id, turn, {HOP} AS hop FROM (SELECT *, lower({ASKED}) AS q FROM conversations)")
def hop_classify(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.hop_class(asked()).alias("hop"))


@query(f"SELECT role, count(*) AS n, round(avg(CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.0 END), 5) AS accuracy, count(*) < 10 AS few FROM (SELECT *, lower({ASKED}) AS q FROM conversations) WHERE {HOP} = 'multi-hop' GROUP BY role")
def metrics_multihop(spark, d):
    return m.multi_hop(table(spark, d, "conversations"), "role", text.hop_class(asked()), F.when(F.col("turn") % 2 == 0, "correct"))
