"""Vector search, patterns and searches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators import retrieval as r
from loomgraph.operators import vector as v
from loomgraph.operators.graph import Graph
from loomgraph.plans.registry import base, query, table
from loomgraph.sources.shared import folder, state

Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
L2 = "sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - q[i]) * (embedding[i]::DOUBLE - q[i]))))"
DOT = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i]))"
COS = f"{DOT} / (sqrt(list_sum(list_transform(q, lambda x: x * x))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))"


def near(metric: str = L2, where: str = "true") -> str:
    return f"SELECT vec_id, label, {metric} AS score FROM (SELECT *, {Q0} AS q FROM embeddings) WHERE {where}"


def q0(spark, d) -> list[float]:
    return v.query_vector(table(spark, d, "embeddings"), F.col("vec_id") == 0)


def rounded(df):
    return df.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, label, round(score, 6) AS score FROM ({near()}) ORDER BY score, vec_id LIMIT 10")
def vector_l2_topk(spark, d):
    return rounded(v.top_k(table(spark, d, "embeddings"), q0(spark, d), 10, "vec_id"))


@query(f"SELECT vec_id, label, round(score, 6) AS score FROM ({near(COS)}) ORDER BY score DESC, vec_id LIMIT 10")
def vector_cosine_topk(spark, d):
    return rounded(v.top_k(table(spark, d, "embeddings"), q0(spark, d), 10, "vec_id", "cosine"))


@query(f"SELECT vec_id, label, round(score, 6) AS score FROM ({near(where='label IN (1, 3, 5)')}) ORDER BY score, vec_id LIMIT 10")
def vector_filtered_topk(spark, d):
    return rounded(v.top_k(table(spark, d, "embeddings"), q0(spark, d), 10, "vec_id", where=F.col("label").isin(1, 3, 5)))


@query(f"""WITH n AS (SELECT * FROM ({near()}) ORDER BY score, vec_id LIMIT 50),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS turn, min(score) OVER (PARTITION BY label) AS best FROM n)
SELECT vec_id, label, round(score, 6) AS score FROM r ORDER BY turn, best, score, vec_id LIMIT 10""")
def vector_diverse_topk(spark, d):
    return rounded(v.diverse_top_k(table(spark, d, "embeddings"), q0(spark, d), 10, "vec_id", "label"))


@query(f"SELECT vec_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS rn FROM ({near()})) WHERE rn <= 3")
def vector_per_label_topk(spark, d):
    return rounded(v.top_k_per_group(table(spark, d, "embeddings"), q0(spark, d), 3, "vec_id", "label"))


@query("SELECT e.vec_id, e.label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings e WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def vector_get_embeddings(spark, d):
    ids = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    e = v.get_embeddings(table(spark, d, "embeddings"), ids, "vec_id")
    return e.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("""SELECT vec_id, label FROM embeddings WHERE label <> 2 UNION ALL SELECT vec_id, -1 AS label FROM embeddings WHERE label = 2""")
def vector_insert_absent(spark, d):
    """An index without label 2 gets all vectors again with another label; only the absent ones come in."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return v.insert_absent(e.where("label <> 2"), e.select("vec_id", F.lit(-1).alias("label")), "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_delete(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return v.delete_ids(table(spark, d, "embeddings").select("vec_id", "label"), ids, "vec_id")


#: chunks nearest to the query vector; a chunk has the vector numbered as its document and line, modulo the vectors
SEED = f"nv AS (SELECT count(*) AS n FROM embeddings), vs AS ({near()}), cs AS (SELECT chunk_id, source_id, score FROM chunk, nv JOIN vs ON vec_id = (doc_id + seq) % n), seed AS (SELECT chunk_id, score FROM cs ORDER BY score, chunk_id LIMIT 10)"
TOPICS = SEED + ", tseed AS (SELECT topic_id, min(score) AS score FROM cs JOIN topic_chunk USING (chunk_id) GROUP BY topic_id ORDER BY score, topic_id LIMIT 10)"
#: entities: the five of highest degree
ENT = "eseed AS (SELECT entity_id FROM degree JOIN entity USING (entity_id) WHERE NOT is_local ORDER BY degree DESC, entity_id LIMIT 5)"


def chunk_vectors(spark, d, g: Graph):
    e = table(spark, d, "embeddings")
    n = e.count()
    at = v.scored(e, q0(spark, d)).select("vec_id", "score")
    return g.chunk.select("chunk_id", "source_id", ((F.col("doc_id") + F.col("seq")) % n).alias("vec_id")).join(at, "vec_id")


def chunk_seeds(spark, d, g: Graph):
    return chunk_vectors(spark, d, g).orderBy("score", "chunk_id").limit(10)


def topic_seeds(spark, d, g: Graph):
    t = chunk_vectors(spark, d, g).join(g.topic_chunk, "chunk_id").groupBy("topic_id").agg(F.min("score").alias("score"))
    return t.orderBy("score", "topic_id").limit(10)


def entity_seeds(g: Graph, k: int = 5):
    return g.degree.join(g.entity.where("not is_local").select("entity_id"), "entity_id", "left_semi").orderBy(F.desc("degree"), "entity_id").limit(k)


_stored: dict[tuple, Graph] = {}


def graph(spark, d) -> Graph:
    """The graph of the documents, built once in an application and searched in its tables; built again when they change."""
    key = spark.sparkContext.applicationId, d, state(spark, f"{d}/documents.parquet")
    if key not in _stored:
        _stored[key] = Graph(table(spark, d, "documents")).stored(f"{folder(spark)}/graph-{uuid.uuid4().hex}")
    return _stored[key]


def grouping(ids: str) -> str:
    """SQL of the final grouping of the statements that ids selects."""
    return f"""ids AS (SELECT DISTINCT statement_id FROM ({ids})), gs AS (SELECT s.* FROM statement s JOIN ids USING (statement_id)),
gt AS (SELECT source_id, topic_id, count(*) // count(DISTINCT chunk_id) AS k FROM gs GROUP BY ALL),
gb AS (SELECT source_id, sum(k)::BIGINT AS result_score FROM gt GROUP BY source_id ORDER BY result_score DESC, source_id LIMIT 10),
res AS (SELECT source_id, result_score, topic_id, chunk_id, statement_id, coalesce(facts, 0)::DOUBLE AS score FROM gs JOIN gb USING (source_id) LEFT JOIN (SELECT statement_id, count(*) AS facts FROM supports GROUP BY statement_id) USING (statement_id))"""


CHUNKS = "SELECT statement_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY statement_id) AS rn FROM (SELECT DISTINCT chunk_id, statement_id FROM (SELECT chunk_id, topic_id FROM topic_chunk JOIN seed USING (chunk_id)) JOIN (SELECT topic_id, statement_id FROM statement) USING (topic_id))) WHERE rn <= 50"
AROUND = "SELECT statement_id FROM {0} UNION SELECT previous_id FROM previous JOIN {0} USING (statement_id) UNION SELECT p.statement_id FROM previous p JOIN {0} x ON p.previous_id = x.statement_id"


def search_sql(ids: str, more: str) -> str:
    return base("SELECT * FROM res", f"{more}, {grouping(ids)}")


@query(search_sql(CHUNKS, SEED))
def chunk_search(spark, d):
    g = graph(spark, d)
    return r.grouped(g, r.chunk_statements(g, chunk_seeds(spark, d, g)))


TFACTS = "SELECT DISTINCT statement_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY fact_id) AS rn FROM (SELECT DISTINCT topic_id, fact_id FROM statement JOIN tseed USING (topic_id) JOIN supports USING (statement_id))) JOIN supports USING (fact_id) WHERE rn <= 50"


@query(search_sql(TFACTS, TOPICS))
def topic_search(spark, d):
    g = graph(spark, d)
    return r.grouped(g, r.topic_fact_statements(g, topic_seeds(spark, d, g)))


EST = ENT + ", es AS (SELECT statement_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY statement_id) AS rn FROM (SELECT DISTINCT entity_id, statement_id FROM entity_fact JOIN eseed USING (entity_id) JOIN supports USING (fact_id) WHERE role = 'SUBJECT')) WHERE rn <= 50)"


@query(search_sql(AROUND.format("es"), EST))
def entity_search_single(spark, d):
    g = graph(spark, d)
    return r.grouped(g, r.entity_statements(g, entity_seeds(g)))


PAIRS = ENT + """, ue AS (SELECT src AS a, dst AS b FROM relation WHERE src <> dst UNION SELECT dst, src FROM relation WHERE src <> dst),
p1 AS (SELECT a, b FROM ue WHERE a IN (SELECT entity_id FROM eseed)),
pn AS (SELECT unnest([a, b]) AS entity_id FROM p1 WHERE b IN (SELECT entity_id FROM eseed) UNION SELECT unnest([p1.a, p1.b, ue.b]) FROM p1 JOIN ue ON p1.b = ue.a WHERE ue.b <> p1.a AND ue.b IN (SELECT entity_id FROM eseed)),
pf AS (SELECT fact_id FROM entity_fact JOIN pn USING (entity_id) GROUP BY fact_id HAVING count(DISTINCT role) = 2), ps AS (SELECT DISTINCT statement_id FROM supports JOIN pf USING (fact_id))"""


@query(search_sql(AROUND.format("ps"), PAIRS))
def entity_search_pairs(spark, d):
    g = graph(spark, d)
    e = entity_seeds(g)
    return r.grouped(g, r.pair_statements(g, e, e))


NET = TOPICS + ", ts AS (SELECT statement_id FROM (SELECT statement_id, row_number() OVER (PARTITION BY topic_id ORDER BY statement_id) AS rn FROM statement JOIN tseed USING (topic_id)) WHERE rn <= 25)"


@query(search_sql("SELECT statement_id FROM ts", NET))
def entity_network_search(spark, d):
    g = graph(spark, d)
    return r.grouped(g, r.topic_statements(g, topic_seeds(spark, d, g)))


KW = "kw AS (SELECT search_str FROM entity JOIN degree USING (entity_id) WHERE NOT is_local GROUP BY search_str ORDER BY sum(degree) DESC, search_str LIMIT 10)"


def keywords(g: Graph):
    e = g.entity.where("not is_local").join(g.degree, "entity_id")
    return e.groupBy("search_str").agg(F.sum("degree").alias("n")).orderBy(F.desc("n"), "search_str").limit(10)


@query(base("SELECT statement_id, m, round(CASE WHEN count(*) OVER (PARTITION BY m) > 1 THEN m / 10.0::DOUBLE * 1.5 / 2 ELSE m / 10.0::DOUBLE END, 6) AS score FROM (SELECT statement_id, count(DISTINCT search_str) AS m FROM entity JOIN kw USING (search_str) JOIN entity_fact USING (entity_id) JOIN supports USING (fact_id) GROUP BY statement_id)", KW))
def keyword_ranking(spark, d):
    g = graph(spark, d)
    hits = r.keyword_statements(g, keywords(g)).withColumn("cos", F.lit(0.5))
    return v.keyword_scores(hits, 10).select("statement_id", "m", F.round("score", 6).alias("score"))


@query(base("""SELECT keyword, entity_id, value, degree AS score FROM (SELECT keyword, entity_id, value FROM entity JOIN words ON search_str = keyword WHERE NOT is_local
UNION ALL SELECT keyword, entity_id, value FROM entity JOIN words ON starts_with(search_str, keyword) WHERE NOT is_local AND keyword NOT IN (SELECT search_str FROM entity WHERE NOT is_local)) JOIN degree USING (entity_id)""",
    KW + ", words AS (SELECT search_str AS keyword FROM kw UNION SELECT DISTINCT search_str[1:4] FROM kw)"))
def entity_lookup_exact_prefix(spark, d):
    g = graph(spark, d)
    k = keywords(g).select("search_str")
    return r.entity_lookup(g, k.unionByName(k.select(F.substring("search_str", 1, 4).alias("search_str"))))


@query(base("SELECT * FROM degree"))
def entity_degree(spark, d):
    return graph(spark, d).degree


@query(base("SELECT entity_id, degree AS score FROM degree WHERE degree BETWEEN 0.1 * (SELECT max(degree) FROM degree) AND 10 * (SELECT max(degree) FROM degree)"))
def entity_filter(spark, d):
    return r.entity_filter(graph(spark, d).degree.select("entity_id", F.col("degree").alias("score")))


@query(base("""SELECT root_id, path FROM (SELECT root_id, [root_id, a] AS path FROM l1 UNION ALL SELECT root_id, [root_id, a, b] FROM l2)""", ENT + """,
ce AS (SELECT DISTINCT src, dst FROM relation WHERE dst IN (SELECT entity_id FROM entity WHERE NOT is_local)),
l1 AS (SELECT root_id, a FROM (SELECT e.entity_id AS root_id, dst AS a, row_number() OVER (PARTITION BY e.entity_id ORDER BY degree DESC, dst) AS rn FROM eseed e JOIN ce ON src = e.entity_id JOIN degree g ON g.entity_id = dst WHERE dst <> src) WHERE rn <= 3),
l2 AS (SELECT root_id, a, b FROM (SELECT root_id, a, dst AS b, row_number() OVER (PARTITION BY root_id, a ORDER BY degree DESC, dst) AS rn FROM l1 JOIN ce ON src = a JOIN degree g ON g.entity_id = dst WHERE dst <> a AND dst <> root_id) WHERE rn <= 4)"""))
def entity_context_tree(spark, d):
    g = graph(spark, d)
    return r.context_tree(g, entity_seeds(g))


@query(search_sql("SELECT statement_id FROM statement", SEED))
def statements_by_topic_source(spark, d):
    g = graph(spark, d)
    return r.grouped(g, g.statement)


@query(base("SELECT statement_id, list_sort(list(value)) AS facts FROM (SELECT DISTINCT statement_id, value FROM supports JOIN fact USING (fact_id)) GROUP BY statement_id"))
def statement_facts(spark, d):
    g = graph(spark, d)
    return g.supports.join(g.fact, "fact_id").groupBy("statement_id").agg(F.sort_array(F.collect_set("value")).alias("facts"))


@query(base("SELECT DISTINCT a.statement_id, b.statement_id AS other_id FROM se a JOIN se b USING (entity_id) WHERE a.statement_id IN (SELECT statement_id FROM pick) AND a.statement_id <> b.statement_id",
    "se AS (SELECT DISTINCT statement_id, entity_id FROM supports JOIN entity_fact USING (fact_id)), pick AS (SELECT statement_id FROM statement ORDER BY statement_id LIMIT 20)"))
def statement_neighbors(spark, d):
    g = graph(spark, d)
    return r.statement_neighbours(g, g.statement.orderBy("statement_id").limit(20))


@query(base("""SELECT chunk_id, other_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY shared DESC, other_id) AS rn FROM
(SELECT t.chunk_id, c.chunk_id AS other_id, count(*) AS shared FROM topc t JOIN ce c USING (entity_id) WHERE t.chunk_id <> c.chunk_id GROUP BY ALL)) WHERE rn <= 20""", SEED + """,
ce AS (SELECT DISTINCT chunk_id, entity_id FROM statement JOIN supports USING (statement_id) JOIN entity_fact USING (fact_id)),
topc AS (SELECT chunk_id, entity_id FROM (SELECT chunk_id, entity_id, row_number() OVER (PARTITION BY chunk_id ORDER BY degree DESC, entity_id) AS rn FROM ce JOIN seed USING (chunk_id) JOIN degree USING (entity_id)) WHERE rn <= 5)"""))
def chunk_neighbors(spark, d):
    g = graph(spark, d)
    return r.chunk_neighbours(g, chunk_seeds(spark, d, g))


TN = TOPICS + """, te AS (SELECT DISTINCT topic_id, entity_id FROM statement JOIN supports USING (statement_id) JOIN entity_fact USING (fact_id)),
n1 AS (SELECT a.topic_id, b.topic_id AS other_id, count(*) AS n FROM te a JOIN te b USING (entity_id) WHERE a.topic_id <> b.topic_id AND a.topic_id IN (SELECT topic_id FROM tseed) GROUP BY ALL),
k1 AS (SELECT topic_id, other_id, 'entity' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, other_id) AS rn FROM n1) WHERE rn <= 5),
n2 AS (SELECT DISTINCT a.topic_id, b.topic_id AS other_id FROM topic_chunk a JOIN topic_chunk b USING (chunk_id) WHERE a.topic_id <> b.topic_id AND a.topic_id IN (SELECT topic_id FROM tseed)),
k2 AS (SELECT topic_id, other_id, 'chunk' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY other_id) AS rn FROM n2) WHERE rn <= 5),
cl AS (SELECT DISTINCT chunk_id, next_id FROM (SELECT chunk_id, lead(chunk_id) OVER (PARTITION BY source_id ORDER BY seq) AS next_id FROM occ) WHERE next_id IS NOT NULL),
n3 AS (SELECT DISTINCT a.topic_id, b.topic_id AS other_id FROM topic_chunk a JOIN cl USING (chunk_id) JOIN topic_chunk b ON b.chunk_id = next_id WHERE a.topic_id <> b.topic_id AND a.topic_id IN (SELECT topic_id FROM tseed)),
k3 AS (SELECT topic_id, other_id, 'next' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY other_id) AS rn FROM n3) WHERE rn <= 5),
nb AS (SELECT topic_id, other_id, min(kind) AS kind FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3) GROUP BY ALL)"""


@query(base("SELECT * FROM nb", TN))
def topic_neighbors(spark, d):
    g = graph(spark, d)
    return r.topic_neighbours(g, topic_seeds(spark, d, g))
