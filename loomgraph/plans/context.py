"""Query context, result shaping, filter dialects, versions of sources, and searches by beams and mixes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import context as c
from loomgraph.operators import dialects as d_
from loomgraph.operators import engine, ordered, results, retrievers
from loomgraph.operators import filters as f
from loomgraph.operators import retrieval as r
from loomgraph.operators import triples as t
from loomgraph.operators import vector as v
from loomgraph.operators import versions as ver
from loomgraph.plans.building import graph as lazy
from loomgraph.plans.processing import TRIPLES, VERSIONS, some, tfidf, triples, versions
from loomgraph.plans.registry import base, query, table
from loomgraph.plans.searching import CHUNKS, KW, SEED, TOPICS, chunk_seeds, entity_seeds, graph, grouping, keywords, near, q0, rounded, topic_seeds
from loomgraph.sources import readers
from loomgraph.sources.shared import folder, written

# keywords and entities


@query("""SELECT item_id, len(k) AS n, array_to_string(k[1:10], ',') AS keywords FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS k
FROM (SELECT item_id, list_filter(list_transform(string_split(replace(text, ' ', '^'), '^'), lambda x: trim(x)), lambda x: x <> '') AS w FROM benchmark))""")
def keyword_split(spark, d):
    said = F.replace("text", F.lit(" "), F.lit("^"))
    return table(spark, d, "benchmark").select("item_id", F.size(c.split_keywords(said, 10**6)).cast("long").alias("n"), F.array_join(c.split_keywords(said), ",").alias("keywords"))


@query(r"""SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: {'n': -length(w[i]), 'i': i, 'w': w[i]})), lambda x: x.w)[1:10], ',') AS keywords
FROM (SELECT item_id, regexp_extract_all(text, '\p{L}{5,}') AS w FROM benchmark)""")
def keyword_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(c.long_words(F.col("text")), ",").alias("keywords"))


ASKED = KW + """, kd AS (SELECT search_str AS keyword, search_str AS key, NULL AS kind FROM kw UNION SELECT search_str[1:4], search_str[1:4], NULL FROM kw UNION SELECT search_str || '|Agent', search_str, 'Agent' FROM kw),
ex AS (SELECT keyword, entity_id FROM entity JOIN kd ON search_str = key WHERE NOT is_local AND (kind IS NULL OR class = kind)),
fo AS (SELECT * FROM ex UNION ALL SELECT keyword, entity_id FROM entity JOIN kd ON starts_with(search_str, key) WHERE NOT is_local AND keyword NOT IN (SELECT keyword FROM ex) AND (kind IS NULL OR starts_with(class, kind)))"""


def asked_keywords(g):
    k = keywords(g).select(F.col("search_str").alias("keyword"))
    return k.unionByName(k.select(F.substring("keyword", 1, 4).alias("keyword"))).unionByName(k.select(F.concat("keyword", F.lit("|Agent")).alias("keyword")))


@query(base("SELECT keyword, entity_id, degree AS score FROM fo JOIN degree USING (entity_id)", ASKED))
def entity_lookup_class(spark, d):
    g = graph(spark, d)
    return c.entity_lookup(g, asked_keywords(g)).select("keyword", "entity_id", "score")


@query(base("SELECT entity_id, sum(degree)::BIGINT AS score FROM fo JOIN degree USING (entity_id) GROUP BY entity_id", ASKED))
def entity_provider(spark, d):
    g = graph(spark, d)
    return c.summed(c.entity_lookup(g, asked_keywords(g))).select("entity_id", "score")


REAL = "rs AS (SELECT DISTINCT statement_id, entity_id FROM supports JOIN entity_fact USING (fact_id) JOIN entity USING (entity_id) WHERE NOT is_local)"


@query(base("SELECT entity_id, degree AS score FROM (SELECT DISTINCT entity_id FROM rs JOIN statement USING (statement_id) WHERE topic_id IN (SELECT topic_id FROM tseed)) JOIN degree USING (entity_id) ORDER BY degree DESC, entity_id LIMIT 50", f"{TOPICS}, {REAL}"))
def entities_of_topics(spark, d):
    g = graph(spark, d)
    return c.entities_of(g, topic_seeds(spark, d, g), "topic_id").select("entity_id", "score")


@query(base("SELECT entity_id, degree AS score FROM (SELECT DISTINCT entity_id FROM rs JOIN statement USING (statement_id) WHERE chunk_id IN (SELECT chunk_id FROM seed)) JOIN degree USING (entity_id) ORDER BY degree DESC, entity_id LIMIT 50", f"{SEED}, {REAL}"))
def entities_of_chunks(spark, d):
    g = graph(spark, d)
    return c.entities_of(g, chunk_seeds(spark, d, g), "chunk_id").select("entity_id", "score")


@query(base("SELECT statement_id, rs.entity_id, degree AS score FROM statement LEFT JOIN rs USING (statement_id) LEFT JOIN degree ON rs.entity_id = degree.entity_id", REAL))
def entities_of_statements(spark, d):
    g = graph(spark, d)
    return c.entities_of_statements(g, g.statement)


def phrases(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("m"), "text").where("text is not null")


@query()
def entity_contexts(spark, d):
    """Contexts of the five entities of highest degree, with the benchmark's texts as phrases."""
    g = graph(spark, d)
    e = entity_seeds(g).select("entity_id", F.col("degree").alias("score")).join(g.entity.select("entity_id", "value", "class"), "entity_id")
    return c.entity_contexts(g, e, phrases(spark, d))


@query(base("SELECT path FROM (SELECT [a, b] AS path FROM w1 UNION ALL SELECT [a, b, c] FROM w2) ORDER BY len(path), path LIMIT 1000", KW + """, pe AS (SELECT DISTINCT src, dst FROM relation WHERE src <> dst),
w1 AS (SELECT src AS a, dst AS b FROM pe WHERE src IN (SELECT entity_id FROM entity WHERE NOT is_local AND search_str[1:3] IN (SELECT search_str[1:3] FROM kw))),
w2 AS (SELECT a, b, dst AS c FROM w1 JOIN pe ON b = src WHERE dst <> a)"""))
def entity_paths(spark, d):
    g = graph(spark, d)
    return c.entity_paths(g, keywords(g).select(F.substring("search_str", 1, 3).alias("prefix")), 2)


@query("SELECT item_id, len(p) AS parts, array_to_string(p, '|') AS text FROM (SELECT item_id, CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) > 25 THEN list_filter(list_transform(string_split(regexp_replace(text, '([?.!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') ELSE [trim(text)] END AS p FROM benchmark)")
def query_parts(spark, d):
    p = c.parts_of(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(p).cast("long").alias("parts"), F.array_join(p, "|").alias("text"))


# orders and repeats


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def ordered_first_seen(spark, d):
    return ordered.first_seen(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT arg_max(k, event_id) AS k, max(event_id) AS event_id FROM (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || user_id AS k, event_id FROM events) GROUP BY lower(k)")
def ordered_last_wins(spark, d):
    k = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.col("user_id"))
    return ordered.last_wins(table(spark, d, "events").select(k.alias("k"), "event_id"), "k", "event_id")


@query("""SELECT text, (min(p * 1000000000 + place) // 1000000000)::INT AS part, min(p * 1000000000 + place) % 1000000000 AS place FROM (SELECT lang AS text, 0 AS p, min(doc_id) AS place FROM documents GROUP BY lang
UNION ALL SELECT source, 1, min(doc_id) FROM documents GROUP BY source UNION ALL SELECT lang, 1, min(doc_id) FROM documents GROUP BY lang) GROUP BY text""")
def context_append(spark, d):
    docs = table(spark, d, "documents")
    one = lambda x: docs.groupBy(F.col(x).alias("text")).agg(F.min("doc_id").alias("place"))
    return ordered.appended(one("lang"), one("source").unionByName(one("lang")), "text", "place")


@query("SELECT DISTINCT p_brand, p_name FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE a.p_brand = b.p_brand AND b.p_name <> a.p_name AND starts_with(b.p_name, a.p_name))")
def prefix_elimination(spark, d):
    return ordered.without_prefixes(table(spark, d, "part").select("p_brand", "p_name"), "p_name", "p_brand")


# filters in dialects, build filters, metadata


DIALECT = f.all_of(f.any_of(f.Leaf("lang", "IN", ["de", "en"]), f.Leaf("source", "TEXT_MATCH", "RC2")), f.Leaf("n_chars", "GTE", 500), f.none_of(f.all_of(f.Leaf("source", "EQ", "src1"))))
SAID = "SELECT doc_id FROM documents WHERE (lang IN ('de', 'en') OR contains(lower(source), 'rc2')) AND n_chars >= 500 AND source <> 'src1'"


@query(SAID)
def filter_sql_dialect(spark, d):
    return d_.where_sql(table(spark, d, "documents"), DIALECT).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lang IN ('de', 'en') OR source = 'src2') AND n_chars >= 500 AND source <> 'src1'")
def filter_json_dialect(spark, d):
    said = {"$and": [{"$or": [{"lang": {"$in": ["de", "en"]}}, {"source": "src2"}]}, {"n_chars": {"$gte": 500}, "source": {"$ne": "src1"}}]}
    tree = d_.from_json_ops(d_.to_json_ops(d_.from_json_ops(said)))
    return table(spark, d, "documents").where(f.compile(tree, F.col)).select("doc_id")


@query(SAID)
def filter_key_rewrite(spark, d):
    docs = table(spark, d, "documents")
    kept = docs.select("doc_id", F.struct(F.struct(F.struct("lang", "source", "n_chars").alias("metadata")).alias("source")).alias("metadata"))
    return kept.where(f.compile(d_.with_keys(DIALECT, d_.metadata_key), F.col)).select("doc_id")


@query(base("SELECT DISTINCT topic_id, statement_id FROM ext JOIN src USING (source_id) WHERE lang <> 'fr' AND length(topic) <= 6 AND NOT contains(ext.value, ',')"))
def build_filters(spark, d):
    g = graph(spark, d)
    rows = g.extracted.join(g.source.select("source_id", "lang"), "source_id")
    return d_.build_filters(rows, F.col("lang") != "fr", F.length("topic") > 6, F.col("value").contains(",")).select("topic_id", "statement_id").distinct()


@query("SELECT event_id, event_type || '|' || coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END, 'gone') AS told FROM events")
def index_metadata(spark, d):
    e = table(spark, d, "events")
    at = F.when(F.col("event_id") % 3 == 0, F.lit("some day")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    m = d_.index_metadata(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("made_date"), at))
    return e.select("event_id", F.concat_ws("|", m["kind"], F.coalesce(m["made_date"], F.lit("gone"))).alias("told"))


@query("SELECT event_id, CASE WHEN starts_with(props, '{') THEN 1 ELSE 2 END AS plain, CASE WHEN starts_with(props, '{') THEN 2 ELSE 1 END AS collections FROM events WHERE props IS NOT NULL")
def split_collections(spark, d):
    e = table(spark, d, "events").where("props is not null")
    a, b = d_.split_collections(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("props"), F.col("props"), F.lit("list"), F.lit("[1, 2]")))
    return e.select("event_id", F.size(a).alias("plain"), F.size(b).alias("collections"))


@query(base("SELECT chunk_id, count(DISTINCT p) AS propositions, min(md5(p)) AS least FROM (SELECT chunk_id, trim(unnest(string_split(value, ', '))) AS p FROM chunk) WHERE p <> '' GROUP BY chunk_id"))
def propositions(spark, d):
    """Lines of what a model would answer for each chunk: without empty and repeated ones."""
    g = graph(spark, d)
    p = F.array_distinct(F.filter(F.transform(F.split(F.replace("value", F.lit(", "), F.lit("\n")), "\n"), text.trim), lambda x: x != ""))
    rows = g.chunk.select("chunk_id", p.alias("p")).where(F.size("p") > 0)
    return rows.select("chunk_id", F.size("p").cast("long").alias("propositions"), F.array_min(F.transform("p", lambda x: F.md5(x.cast("binary")))).alias("least"))


# sources and their versions


NEWS = "nw AS (SELECT * FROM src WHERE doc_id IN (SELECT doc_id FROM labels)), st AS (SELECT * FROM src WHERE doc_id NOT IN (SELECT doc_id FROM labels))"


def sources_of(spark, d):
    g, labels = graph(spark, d), table(spark, d, "labels").select("doc_id").distinct()
    meta = F.create_map(*(x for k in ("lang", "source", "n_chars") for x in (F.lit(k), F.col(k).cast("string"))))
    rows = g.source.withColumn("metadata", meta)
    return rows.join(labels, "doc_id", "left_semi"), rows.join(labels, "doc_id", "left_anti")


@query(base("SELECT nw.source_id AS new_id, st.source_id AS old_id, -1::BIGINT AS valid_from, 10000000000000 AS valid_to FROM nw JOIN st ON nw.lang = st.lang AND nw.source = st.source AND nw.n_chars = st.n_chars WHERE nw.source_id <> st.source_id", NEWS))
def earlier_versions(spark, d):
    """Unlabelled sources that labelled ones are versions of, by language, source and length."""
    new, old = sources_of(spark, d)
    return ver.earlier_versions(old, new, ["lang", "source", "n_chars"])


@query(base("SELECT DISTINCT st.source_id FROM nw JOIN st ON nw.lang = st.lang AND nw.source = st.source AND nw.n_chars = st.n_chars WHERE nw.source_id <> st.source_id AND st.lang <> 'en'", NEWS))
def deletable_versions(spark, d):
    new, old = sources_of(spark, d)
    return ver.deletable(graph(spark, d), ver.earlier_versions(old, new, ["lang", "source", "n_chars"]), F.col("lang") != "en")


@query(f"WITH {VERSIONS} SELECT vec_id, valid_from, valid_to FROM embeddings JOIN i ON event_id = vec_id")
def vector_versions(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("event_id"))
    return ver.vector_versions(e, ver.intervals(versions(spark, d), "user_id").select("event_id", "valid_from", "valid_to"), "event_id").select("vec_id", "valid_from", "valid_to")


@query(base("SELECT source_id, lang, n_chars FROM src WHERE lang = 'de' AND n_chars > 100"))
def sources_listing(spark, d):
    return ver.get_sources(graph(spark, d).source, where=(F.col("lang") == "de") & (F.col("n_chars") > 100), order_by=[F.desc("n_chars"), "source_id"]).select("source_id", "lang", "n_chars")


@query("SELECT vec_id, CASE WHEN toxic = 1 THEN 1700000000000 ELSE 10000000000000 END AS valid_to FROM embeddings LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) ON doc_id = vec_id")
def vector_update_versions(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.lit(10_000_000_000_000).alias("valid_to"))
    return v.update_versions(e, table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", 1_700_000_000_000)


COS_OF = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i])) / (sqrt(list_sum(list_transform(q, lambda x: x * x))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, label, round({COS_OF}, 6) AS score FROM (SELECT e.*, {Q0} AS q FROM embeddings e JOIN (SELECT vec_id FROM ({near()}) ORDER BY score, vec_id LIMIT 100) USING (vec_id)) ORDER BY {COS_OF} DESC, vec_id LIMIT 5")
def vector_cosine_again(spark, d):
    return rounded(v.twice(table(spark, d, "embeddings"), q0(spark, d), 100, 5, "vec_id"))


@query(f"SELECT vec_id, label, round(score, 6) AS score FROM ({near(where='vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)')}) ORDER BY score, vec_id LIMIT 10")
def vector_selector(spark, d):
    ids = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return rounded(v.top_k(v.among(table(spark, d, "embeddings"), ids, "vec_id"), q0(spark, d), 10, "vec_id"))


# relations to complements, labels, statements in order


@query(base("SELECT DISTINCT subject_id AS src, predicate AS rel, object_id AS dst FROM statement_fact WHERE local"))
def build_complement_relations(spark, d):
    return lazy(spark, d).complement_relation()


@query(base("""SELECT DISTINCT src, rel, dst FROM (SELECT coalesce(a.new_id, r.src) AS src, rel, coalesce(b.new_id, r.dst) AS dst, a.new_id IS NOT NULL OR b.new_id IS NOT NULL AS moved
FROM (SELECT DISTINCT subject_id AS src, predicate AS rel, object_id AS dst FROM statement_fact) r LEFT JOIN rw a ON a.entity_id = r.src LEFT JOIN rw b ON b.entity_id = r.dst) WHERE NOT (moved AND src = dst)""",
    "rw AS (SELECT l.entity_id, min(r.entity_id) AS new_id FROM entity l JOIN entity r ON l.search_str = r.search_str AND l.is_local AND NOT r.is_local GROUP BY l.entity_id)"))
def build_relation_rewrite(spark, d):
    return graph(spark, d).rewritten_relation()


@query(base("SELECT entity_id, '__Entity__,' || upper(class[1:1]) || lower(class[2:]) AS labels FROM entity"))
def entity_labels(spark, d):
    return graph(spark, d).entity_labels().select("entity_id", F.array_join("labels", ",").alias("labels"))


@query(base("SELECT place, statement_id, s.chunk_id, s.source_id, c.seq AS chunk_seq FROM (SELECT row_number() OVER (ORDER BY md5(statement_id)) AS place, statement_id FROM statement ORDER BY md5(statement_id) LIMIT 30) JOIN statement s USING (statement_id) JOIN chunk c ON c.chunk_id = s.chunk_id"))
def statements_in_order(spark, d):
    from pyspark.sql import Window

    g = graph(spark, d)
    digest = F.md5(F.col("statement_id").cast("binary"))
    wanted = g.statement.select("statement_id", digest.alias("m")).orderBy("m").limit(30).select("statement_id", F.row_number().over(Window.orderBy("m")).alias("place"))
    rows = g.statement.select("statement_id", "chunk_id", "source_id").join(g.chunk.select("chunk_id", F.col("seq").alias("chunk_seq")), "chunk_id")
    return c.in_requested_order(rows, wanted, "statement_id").orderBy("place")


@query(base("SELECT topic_id, source_id FROM topic WHERE topic_id IN (SELECT topic_id FROM tseed)", TOPICS))
def topic_sources(spark, d):
    g = graph(spark, d)
    return g.topic.join(topic_seeds(spark, d, g).select("topic_id"), "topic_id", "left_semi").select("topic_id", "source_id")


# whole searches


NET_IDS = "SELECT statement_id FROM (SELECT statement_id, row_number() OVER (PARTITION BY topic_id ORDER BY statement_id) AS rn FROM statement JOIN tseed USING (topic_id)) WHERE rn <= 25"
ANSWERED = """fs AS (SELECT statement_id, list_sort(list(value)) AS fs FROM (SELECT DISTINCT statement_id, value FROM supports JOIN fact USING (fact_id)) GROUP BY statement_id),
told AS (SELECT r.source_id, r.topic_id, statement_id, t.value || ': ' || s.value || CASE WHEN fs IS NOT NULL THEN ' (details: ' || array_to_string(fs, ', ') || ')' ELSE '' END AS text
FROM res r JOIN statement s USING (statement_id) JOIN topic t ON t.topic_id = r.topic_id LEFT JOIN fs USING (statement_id))"""
PHRASES = "SELECT text, item_id AS m FROM benchmark WHERE text IS NOT NULL"
CHAIN = """sc AS (SELECT source_id, topic_id, statement_id, round(score, 4) AS score FROM told JOIN tfidf ON id = statement_id WHERE round(score, 4) > 0),
pr AS (SELECT * FROM sc WHERE score >= 0.05 * (SELECT max(score) FROM sc)),
be AS (SELECT *, row_number() OVER (ORDER BY result_score DESC, source_id) AS result_rank FROM (SELECT source_id, round(max(m), 6) AS result_score FROM (SELECT source_id, avg(score) AS m FROM pr GROUP BY source_id, topic_id) GROUP BY source_id)),
ks AS (SELECT pr.*, result_score, result_rank, row_number() OVER (PARTITION BY source_id, topic_id ORDER BY score DESC, statement_id) AS n FROM pr JOIN be USING (source_id) WHERE result_rank <= 5)"""


@query(base("SELECT source_id, topic_id, statement_id, score, round(result_score, 5) AS result_score, result_rank FROM ks WHERE n <= 10", f"{SEED}, {grouping(CHUNKS)}, {ANSWERED}, {tfidf('SELECT statement_id AS id, text FROM told', PHRASES)}, {CHAIN}"))
def default_chain(spark, d):
    """Chunk search with the chain of processors that follows it, the benchmark's texts being the question."""
    g = graph(spark, d)
    rows = retrievers.chain(g, r.grouped(g, r.chunk_statements(g, chunk_seeds(spark, d, g))), phrases(spark, d))
    return rows.select("source_id", "topic_id", "statement_id", "score", F.round("result_score", 5).alias("result_score"), F.col("result_rank").cast("long").alias("result_rank"))


def part_sql(name: str, ids: str, limit: int) -> str:
    return grouping(ids).replace("ids AS", f"{name}_ids AS").replace("JOIN ids", f"JOIN {name}_ids").replace("gs AS", f"{name}_gs AS").replace("FROM gs", f"FROM {name}_gs").replace("gt AS", f"{name}_gt AS").replace("FROM gt", f"FROM {name}_gt").replace("gb AS", f"{name}_gb AS").replace("JOIN gb", f"JOIN {name}_gb").replace("res AS", f"{name} AS").replace("LIMIT 10", f"LIMIT {limit}")


@query(base("SELECT source_id, result_score, topic_id, chunk_id, statement_id, score FROM pa UNION ALL SELECT source_id, result_score, topic_id, chunk_id, statement_id, score FROM pb WHERE statement_id NOT IN (SELECT statement_id FROM pa)", f"{TOPICS}, {part_sql('pa', CHUNKS, 10)}, {part_sql('pb', NET_IDS, 5)}"))
def composite_weighted(spark, d):
    """Chunk search with all of its results, and topic search with half of them."""
    g = graph(spark, d)
    return retrievers.composite(g, [(r.chunk_statements(g, chunk_seeds(spark, d, g)), 1.0), (r.topic_statements(g, topic_seeds(spark, d, g)), 0.5)])


def chunk_embeddings(spark, d, g):
    """The vector of a chunk is that numbered as its document and line, modulo the vectors."""
    e = table(spark, d, "embeddings")
    return g.chunk.select("chunk_id", ((F.col("doc_id") + F.col("seq")) % e.count()).alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def topic_embeddings(spark, d, g):
    """A topic has the vector of the least of its chunks."""
    own = g.topic_chunk.groupBy("topic_id").agg(F.min("chunk_id").alias("chunk_id"))
    e = table(spark, d, "embeddings")
    at = own.join(g.chunk.select("chunk_id", ((F.col("doc_id") + F.col("seq")) % e.count()).alias("vec_id")), "chunk_id").drop("chunk_id")
    return written(at, "vectors").join(e.select("vec_id", "embedding"), "vec_id").drop("vec_id")


@query()
def semantic_search(spark, d):
    g = graph(spark, d)
    return retrievers.semantic_search(g, chunk_embeddings(spark, d, g), q0(spark, d), width=10, depth=2)


@query()
def topic_beam_search(spark, d):
    g = graph(spark, d)
    return retrievers.topic_beam_search(g, topic_embeddings(spark, d, g), q0(spark, d))


@query()
def reranking_beam(spark, d):
    """Statements from those of the best topics over ones that share entities, scored by the benchmark's texts."""
    g = graph(spark, d)
    texts = g.statement.select(F.col("statement_id").alias("node"), F.col("value").alias("text"))
    seeds = r.topic_statements(g, topic_seeds(spark, d, g), 5).select(F.col("statement_id").alias("node"))
    step = lambda level: r.statement_neighbours(g, level.select(F.col("node").alias("statement_id"))).select(F.col("statement_id").alias("node"), F.col("other_id").alias("other"))
    return retrievers.reranking_beam(seeds, step, texts, phrases(spark, d), 10, 2)


# results as they are handed on


NESTED = """nt AS (SELECT source_id, topic, value AS statement, length(value) % 97 AS o FROM ext), nd AS (SELECT DISTINCT * FROM nt),
tt AS (SELECT source_id, topic, max(o) AS o, list(statement ORDER BY o DESC, statement) AS s FROM nd GROUP BY source_id, topic)"""


def nested(spark, d):
    rows = graph(spark, d).extracted.select("source_id", "topic", F.col("value").alias("statement"), (F.length("value") % 97).alias("o")).distinct()
    return results.nested(rows, "source_id", "topic", "statement", "o")


def format_query(form: str, sql: str):
    @query(base(f"SELECT source_id AS source, md5({sql}) AS context FROM tt GROUP BY source_id", NESTED), f"context_{form}")
    def run(spark, d):
        return results.formatted(nested(spark, d), form).select("source", F.md5(F.col("context").cast("binary")).alias("context"))


ORDER = "ORDER BY o DESC, topic"
ESC = "replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t')"
XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
format_query("text", f"string_agg('## ' || topic || chr(10) || array_to_string(s, ' ') || chr(10) || '[Source: ' || source_id || ']' || chr(10) || chr(10), chr(10) {ORDER})")
format_query("yaml", f"""'- source: "' || {ESC.format('source_id')} || '"' || chr(10) || '  topics:' || chr(10) || string_agg('  - topic: "' || {ESC.format('topic')} || '"' || chr(10) || '    statements:' || array_to_string(list_transform(s, lambda x: chr(10) || '    - "' || {ESC.format('x')} || '"'), ''), chr(10) {ORDER})""")
format_query("xml", f"'<item><source>' || {XML.format('source_id')} || '</source>' || string_agg('<topic><name>' || {XML.format('topic')} || '</name>' || array_to_string(list_transform(s, lambda x: '<statement>' || {XML.format('x')} || '</statement>'), '') || '</topic>', '' {ORDER}) || '</item>'")


@query(base("SELECT source_id AS source, count(*) AS topics, sum(len(s))::BIGINT AS statements, md5(string_agg(topic || '=' || s[1], ';' ORDER BY o DESC, topic)) AS firsts FROM tt GROUP BY source_id", NESTED))
def context_nested(spark, d):
    n = nested(spark, d)
    firsts = F.array_join(F.transform("topics", lambda x: F.concat(x["topic"], F.lit("="), x["statements"][0])), ";")
    return n.select("source", F.size("topics").cast("long").alias("topics"), F.aggregate("topics", F.lit(0).cast("long"), lambda s, x: s + F.size(x["statements"])).alias("statements"), F.md5(firsts.cast("binary")).alias("firsts"))


@query(base("SELECT statement_id, NULL::VARCHAR AS chunk_id, 0.0::DOUBLE AS score, lang || '/' || source AS source FROM res JOIN src USING (source_id)", f"{SEED}, {grouping(CHUNKS)}"))
def results_cleared(spark, d):
    g = graph(spark, d)
    rows = results.cleared(results.cleared(r.grouped(g, r.chunk_statements(g, chunk_seeds(spark, d, g))), "chunks"), "scores", to=0)
    return results.enriched(rows, g.source.select("source_id", "lang", F.col("source").alias("kind")), F.concat_ws("/", "lang", "kind")).select("statement_id", "chunk_id", "score", "source")


# triples


@query(f"""WITH {TRIPLES}, e AS (SELECT DISTINCT * FROM tri WHERE src <> dst), l1 AS (SELECT dst AS node, min([src, rel, dst]) AS path FROM e WHERE src = 'c1' GROUP BY dst),
l2 AS (SELECT dst AS node, min(list_concat(path, [rel, dst])) AS path FROM l1 JOIN e ON node = src WHERE dst NOT IN (SELECT node FROM l1) AND dst <> 'c1' GROUP BY dst),
a AS (SELECT path FROM l1 WHERE node LIKE 'r%' OR node LIKE 'p%' UNION ALL SELECT path FROM l2 WHERE node LIKE 'r%' OR node LIKE 'p%'
UNION SELECT [a.src, 'PLACED', a.dst, 'CONTAINS', b.dst] FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'PLACED' AND b.rel = 'CONTAINS' AND a.src = 'c1')
SELECT DISTINCT path[1] || ' -> ' || array_to_string(path[2:len(path) - 1], ' > ') || ' -> ' || path[len(path)] AS text FROM a""")
def triples_paths_between(spark, d):
    x = triples(spark, d)
    goal = x.select(F.col("dst").alias("node")).where("node like 'r%' or node like 'p%'")
    return engine.paths_between(x, some(spark, "c1"), goal, [["PLACED", "CONTAINS"]], 2)


@query()
def triples_scored(spark, d):
    question = spark.createDataFrame([(1, "which parts are supplied by whom"), (2, "in which nation")], "m long, text string")
    return engine.scored_triples(triples(spark, d), some(spark, "c1", "c4"), question, 2, 3)


@query()
def triples_explored(spark, d):
    question = spark.createDataFrame([(1, "in which nation and region")], "m long, text string")
    return engine.explore(triples(spark, d), some(spark, "c1", "c4"), question, 3, 2)


# readers


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def jsonl_reader(spark, d):
    """Documents written as JSON lines, between blank ones and ones that don't parse, and read again."""
    path = f"{folder(spark)}/jsonl-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").where("text is not null").select(F.explode(F.array(F.to_json(F.struct("doc_id", "text")), F.lit("  "), F.lit("{no"))).alias("value"))
    rows.write.text(path)
    read = readers.jsonl(spark, path, "text")
    return read.select(F.get_json_object("document", "$.doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {TRIPLES} SELECT src, rel, count(DISTINCT dst) AS n FROM tri GROUP BY src, rel")
def triples_csv_reader(spark, d):
    path = f"{folder(spark)}/triples-{uuid.uuid4().hex}"
    triples(spark, d).select(F.concat_ws(",", "src", "rel", "dst", F.lit("more")).alias("value")).write.text(path)
    return t.read_csv(spark, path, header=False).groupBy("src", "rel").agg(F.count_distinct("dst").alias("n"))


@query("SELECT to_json(struct_pack(question_id := event_id::VARCHAR, retriever := event_type, question := 'q' || user_id, context := ['a', event_type], ms := floor(value * 1000)::BIGINT, tokens := user_id)) AS line FROM events WHERE value IS NOT NULL")
def run_records(spark, d):
    e = table(spark, d, "events").where("value is not null")
    rows = e.select(F.col("event_id").cast("string").alias("question_id"), F.col("event_type").alias("retriever"), F.concat(F.lit("q"), F.col("user_id")).alias("question"), F.array(F.lit("a"), F.col("event_type")).alias("context"), F.col("value").alias("seconds"), F.col("user_id").alias("tokens"))
    return engine.run_records(rows).withColumnRenamed("value", "line")


@query(base("""SELECT 'topics of a chunk' AS kind, k, count(*) AS n FROM (SELECT count(*) AS k FROM topic_chunk GROUP BY chunk_id) WHERE k > 1 GROUP BY k
UNION ALL SELECT 'facts of a statement', k, count(*) FROM (SELECT count(*) AS k FROM supports GROUP BY statement_id) WHERE k > 1 GROUP BY k"""))
def graph_histograms(spark, d):
    g = graph(spark, d)
    of = lambda df, key, kind: df.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where("k > 1").groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "k", "n")
    return of(g.topic_chunk, "chunk_id", "topics of a chunk").unionByName(of(g.supports, "statement_id", "facts of a statement"))

