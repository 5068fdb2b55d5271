"""Ids, text functions, graph construction and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import ids, text
from loomgraph.operators.graph import Graph
from loomgraph.plans.registry import base, node, query, search, table
from loomgraph.plans.searching import graph as stored


def graph(spark, d) -> Graph:
    return Graph(table(spark, d, "documents"))


@query(base("SELECT source_id, doc_id, meta FROM src"))
def ids_source(spark, d):
    return graph(spark, d).source.select("source_id", "doc_id", "meta")


@query(base("SELECT chunk_id, source_id, seq FROM chunk"))
def ids_chunk(spark, d):
    return graph(spark, d).chunk.select("chunk_id", "source_id", "seq")


@query(f"SELECT c_custkey, {node('entity', 'c_name', 'c_mktsegment')} AS entity_id, {node('fact', 'c_name')} AS fact_id, md5(lower(replace('acme::topic::' || c_name, ' ', '_'))) AS tenant_id FROM customer")
def ids_nodes(spark, d):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", ids.node_id("entity", name, seg).alias("entity_id"), ids.node_id("fact", name).alias("fact_id"), ids.node_id("topic", name, tenant="acme").alias("tenant_id"))


@query("SELECT doc_id, 'lang:' || lang || ';n_chars:' || n_chars || ';source:' || source AS meta FROM documents")
def metadata_string(spark, d):
    pairs = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    return table(spark, d, "documents").select("doc_id", ids.metadata_string(pairs).alias("meta"))


@query(f"SELECT doc_id, md5({search('text')}) AS key FROM documents")
def search_string(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.search_str(F.col("text")).cast("binary")).alias("key"))


@query(r"""SELECT p_partkey, list_aggregate(list_transform(string_split(trim(regexp_replace(p_type || ' ' || p_brand, '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '') AS label,
upper(regexp_replace(p_type || '-' || p_brand, '[^\p{L}\p{N}]', '_', 'g')) AS rel FROM part""")
def label_names(spark, d):
    t, b = F.col("p_type"), F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", text.label_from(F.concat_ws(" ", t, b)).alias("label"), text.relationship_name(F.concat_ws("-", t, b)).alias("rel"))


@query(r"""WITH v AS (SELECT item_id, 'The_' || text || ' (note)' AS x FROM benchmark)
SELECT item_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(x, '_', ' '), '\s*\([^)]*\)', '', 'g')), '^(?i)(the|an|a)\s+', ''), '\.$', '')) AS cleaned FROM v""")
def text_clean(spark, d):
    x = F.concat(F.lit("The_"), F.col("text"), F.lit(" (note)"))
    return table(spark, d, "benchmark").select("item_id", text.clean(x).alias("cleaned"))


@query(base("SELECT source_id, lang, source, n_chars FROM src"))
def build_sources(spark, d):
    return graph(spark, d).source.select("source_id", "lang", "source", "n_chars")


@query(base("SELECT chunk_id, source_id, seq, md5(value) AS value_md5 FROM chunk"))
def build_chunks(spark, d):
    return graph(spark, d).chunk.select("chunk_id", "source_id", "seq", F.md5(F.col("value").cast("binary")).alias("value_md5"))


@query(base("SELECT DISTINCT source_id, chunk_id, next_id FROM (SELECT source_id, chunk_id, lead(chunk_id) OVER (PARTITION BY source_id ORDER BY seq) AS next_id FROM occ) WHERE next_id IS NOT NULL"))
def build_chunk_links(spark, d):
    return graph(spark, d).chunk_links


@query(base("SELECT * FROM topic"))
def build_topics(spark, d):
    return graph(spark, d).topic


@query(base("SELECT * FROM topic_chunk"))
def build_topic_chunks(spark, d):
    return graph(spark, d).topic_chunk


@query(base("SELECT statement_id, topic_id, chunk_id, source_id, seq, pos, md5(value) AS value_md5 FROM statement"))
def build_statements(spark, d):
    return graph(spark, d).statement.withColumn("value_md5", F.md5(F.col("value").cast("binary"))).drop("value")


@query(base("SELECT * FROM previous"))
def build_prev_statement(spark, d):
    return graph(spark, d).previous


@query(base("SELECT * FROM fact"))
def build_facts(spark, d):
    return graph(spark, d).fact


@query(base("SELECT * FROM supports"))
def build_supports(spark, d):
    return graph(spark, d).supports


@query(base("SELECT * FROM entity"))
def build_entities(spark, d):
    return graph(spark, d).entity


@query(base("SELECT * FROM entity_fact"))
def build_entity_fact(spark, d):
    return graph(spark, d).entity_fact


@query(base("SELECT * FROM relation"))
def build_relations(spark, d):
    return graph(spark, d).relation


@query(base("""SELECT DISTINCT coalesce(new_id, entity_id) AS entity_id, fact_id, role FROM entity_fact LEFT JOIN
(SELECT l.entity_id, min(r.entity_id) AS new_id FROM entity l JOIN entity r ON l.search_str = r.search_str AND l.is_local AND NOT r.is_local GROUP BY l.entity_id) USING (entity_id)"""))
def build_local_entity_rewrite(spark, d):
    return stored(spark, d).rewritten_entity_fact()


@query(base("SELECT (['Concept', 'Agent', 'Place'])[length(subject) % 3 + 1] AS subject_class, predicate, (['Concept', 'Agent', 'Place'])[length(object) % 3 + 1] AS object_class, count(*) AS n FROM statement_fact WHERE NOT local GROUP BY ALL"))
def build_summary(spark, d):
    return graph(spark, d).class_summary()


@query(base("SELECT (['Concept', 'Agent', 'Place'])[length(v) % 3 + 1] AS class, count(*) AS n FROM (SELECT subject AS v FROM statement_fact WHERE NOT local UNION ALL SELECT object FROM statement_fact WHERE NOT local) GROUP BY ALL"))
def build_class_counts(spark, d):
    return graph(spark, d).class_counts()


@query(base(" UNION ALL ".join(f"SELECT '{t}' AS label, count(*) AS n FROM {s}" for t, s in {"source": "src", "chunk": "chunk", "topic": "topic", "statement": "statement", "fact": "fact", "entity": "entity"}.items())))
def graph_stats(spark, d):
    return stored(spark, d).counts()


@query(base("""SELECT 'local' AS kind, round(sum(CASE WHEN k > 1 THEN k ELSE 0 END) / count(*), 5) AS value FROM (SELECT count(*) AS k FROM topic_chunk GROUP BY topic_id)
UNION ALL SELECT 'global', round(sum(CASE WHEN k > 1 THEN k ELSE 0 END) / count(*), 5) FROM (SELECT count(*) AS k FROM supports GROUP BY fact_id)"""))
def graph_connectivity(spark, d):
    return stored(spark, d).connectivity()


@query(base("SELECT value || ' [' || class || ']' AS name, n FROM (SELECT entity_id, count(*) AS n FROM entity_fact WHERE role = 'SUBJECT' GROUP BY entity_id) JOIN entity USING (entity_id) ORDER BY n DESC, entity_id LIMIT 100"))
def summary_entities(spark, d):
    """The 100 entities that are subjects most often."""
    g = stored(spark, d)
    n = g.entity_fact.where("role = 'SUBJECT'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(g.entity, "entity_id").orderBy(F.desc("n"), "entity_id").limit(100).select(F.format_string("%s [%s]", "value", "class").alias("name"), "n")


@query(base("SELECT '(' || a || ')-[' || predicate || ']->(' || b || ')' AS path, n FROM (SELECT (['Concept', 'Agent', 'Place'])[length(subject) % 3 + 1] AS a, predicate, (['Concept', 'Agent', 'Place'])[length(object) % 3 + 1] AS b, count(*) AS n FROM statement_fact WHERE NOT local GROUP BY ALL) ORDER BY n DESC, path LIMIT 100"))
def summary_paths(spark, d):
    """The 100 most frequent relations of classes."""
    p = stored(spark, d).class_summary().select(F.format_string("(%s)-[%s]->(%s)", "subject_class", "predicate", "object_class").alias("path"), "n")
    return p.orderBy(F.desc("n"), "path").limit(100)


@query(base("SELECT source_id, 'src:acme:' || substr(source_id, 6) AS tenant_source, regexp_full_match(lang || '.' || source, '[a-z0-9]([a-z0-9.]{0,23}[a-z0-9])?') AS valid FROM src"))
def tenant_rewrite(spark, d):
    s = graph(spark, d).source
    return s.select("source_id", ids.with_tenant(F.col("source_id"), F.lit("acme")).alias("tenant_source"), ids.valid_tenant(F.concat_ws(".", "lang", "source")).alias("valid"))
