"""Beam searches, composites, parsing and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import beam, extraction
from loomgraph.operators import processors as p
from loomgraph.operators import retrieval as r
from loomgraph.operators import vector as v
from loomgraph.plans.registry import base, query, table
from loomgraph.plans.searching import CHUNKS, SEED, TOPICS, chunk_seeds, graph, grouping, q0, topic_seeds
from loomgraph.sources import readers

# beams run over vectors; two are neighbours when they have the same label and follow each other by id

NEXT = "ov AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), nx AS (SELECT a.vec_id AS node, b.vec_id AS other FROM ov a JOIN ov b ON a.label = b.label AND b.rn BETWEEN a.rn + 1 AND a.rn + 5)"
LIST = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def dots(a: str, b: str) -> str:
    return LIST.format(a=a, b=b)


def cosines(a: str, b: str) -> str:
    return f"({dots(a, b)} / (sqrt({dots(a, a)}) * sqrt({dots(b, b)})))"


def beam_sql(formula: str, extra: str = "") -> str:
    q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
    level = lambda k, seen: f"""s{k} AS (SELECT l.node AS parent, l.path, n.other AS node, l.embedding AS pe, e.embedding AS ne, qq.q AS q FROM l{k - 1} l JOIN nx n ON n.node = l.node JOIN embeddings e ON e.vec_id = n.other, qq WHERE n.other NOT IN ({seen})),
t{k} AS (SELECT node, parent, path, ne, round({formula}, 9) AS score FROM s{k}),
b{k} AS (SELECT node, score, list_append(path, node) AS path, ne AS embedding, {k} AS depth FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, parent DESC) AS rn FROM t{k}) WHERE rn = 1),
l{k} AS (SELECT * FROM b{k} ORDER BY score DESC, node LIMIT 20)"""  # noqa: E731
    return f"""WITH {NEXT}, qq AS (SELECT {q} AS q), l0 AS (SELECT vec_id AS node, {cosines("embedding", "qq.q")} AS score, [vec_id] AS path, embedding, 0 AS depth FROM embeddings, qq ORDER BY score DESC, node LIMIT 5),
{level(1, "SELECT node FROM l0")}, {level(2, "SELECT node FROM l0 UNION ALL SELECT node FROM l1")}
SELECT node, round(score, 6) AS score, array_to_string(path, '>') AS path, depth FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) ORDER BY score DESC, node LIMIT 20"""


FORMULAS = {
    "cosine": cosines("ne", "q"),
    "path_weighted": f"{cosines('ne', 'q')} * (1 + {cosines('pe', 'ne')}) / 2",
    "path_propagated": f"{cosines('q', 'pe')} * {cosines('pe', 'ne')}",
    "attention": f"{cosines('ne', 'q')} * (1 + exp({dots('ne', 'pe')} / sqrt(64.0)) / sum(exp({dots('ne', 'pe')} / sqrt(64.0))) OVER (PARTITION BY parent))",
}


def beam_query(mode: str, name: str):
    @query(beam_sql(FORMULAS[mode]), name)
    def run(spark, d):
        from pyspark.sql import Window

        e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "label", "embedding")
        ranked = e.select("node", "label", F.row_number().over(Window.partitionBy("label").orderBy("node")).alias("rn"))
        ahead = ranked.select("label", F.explode(F.array(*(F.col("rn") - k for k in range(1, 6)))).alias("rn"), F.col("node").alias("other"))
        links = ranked.join(ahead, ["label", "rn"]).select("node", "other")
        q = q0(spark, d)
        seeds = v.top_k(e, q, 5, "node", "cosine").select("node")
        found = beam.search(seeds, lambda level: links.join(F.broadcast(level), "node"), e, q, mode, 20, 2)
        return found.select("node", F.round("score", 6).alias("score"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


for _m in FORMULAS:
    beam_query(_m, "beam_depth2_" + _m.removeprefix("path_").replace("weighted", "path_weighted"))


NET_IDS = "SELECT statement_id FROM (SELECT statement_id, row_number() OVER (PARTITION BY topic_id ORDER BY statement_id) AS rn FROM statement JOIN tseed USING (topic_id)) WHERE rn <= 25"


@query(base("SELECT * FROM res", f"{TOPICS}, {grouping(CHUNKS + ' UNION ' + NET_IDS)}"))
def composite_search(spark, d):
    """Chunk search and topic search by one grouping, the default mix."""
    g = graph(spark, d)
    both = r.chunk_statements(g, chunk_seeds(spark, d, g)).select("statement_id").unionByName(r.topic_statements(g, topic_seeds(spark, d, g)).select("statement_id"))
    return r.grouped(g, both)


@query(base("SELECT source_id, topic_id, statement_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source_id, topic_id ORDER BY score DESC, md5) AS rn FROM (SELECT r.*, md5(s.value) AS md5 FROM res r JOIN statement s USING (statement_id) WHERE score >= 0.05 * (SELECT max(score) FROM res))) WHERE rn <= 10", f"{SEED}, {grouping(CHUNKS)}"))
def search_chain(spark, d):
    """A search with two of the processors that follow it by default, prune and truncate of statements.

    Left out are TF-IDF rerank, rescore, statement strings and the order of results; scores are numbers of facts.
    """
    g = graph(spark, d)
    rows = r.grouped(g, r.chunk_statements(g, chunk_seeds(spark, d, g))).join(g.statement.select("statement_id", F.md5(F.col("value").cast("binary")).alias("statement")), "statement_id")
    rows = p.prune_statements(rows.withColumnRenamed("topic_id", "topic"))
    return p.truncate_statements(rows, 10).select("source_id", F.col("topic").alias("topic_id"), "statement_id", "score")


@query(base("SELECT s.statement_id, s.topic_id, s.chunk_id, s.source_id, c.seq AS chunk_seq FROM statement s JOIN chunk c ON c.chunk_id = s.chunk_id"))
def statement_lineage(spark, d):
    g = graph(spark, d)
    return g.statement.select("statement_id", "topic_id", "chunk_id", "source_id").join(g.chunk.select("chunk_id", F.col("seq").alias("chunk_seq")), "chunk_id")


@query("""WITH x AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, lower(regexp_extract(text, '\\p{L}{5,}')) AS w FROM conversations)
SELECT conv_id AS id, count(*) AS lines, count(DISTINCT w) AS words FROM x GROUP BY conv_id""")
def conversation_chain(spark, d):
    w = F.lower(F.regexp_extract("text", r"\p{L}{5,}", 0))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(w).alias("words"))


@query()
def parse_extraction_text(spark, d):
    """Responses made of the conversations: a topic, entities, propositions with relations, and lines that are neither."""
    c = table(spark, d, "conversations")
    words = F.regexp_extract_all("text", F.lit(r"(\p{L}{5,})"), F.lit(1))
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit("thing"))
    lines = F.concat_ws("\n", F.lit("intro"), F.concat(F.lit("topic: "), word(0)), F.lit("entities:"), F.concat(word(1), F.lit("|person")), F.concat(word(2), F.lit("|place")), F.concat(F.lit("proposition: "), F.translate("text", "\n|", "  ")), F.concat(word(1), F.lit("|likes|"), word(2)), F.concat(word(1), F.lit("|has|"), word(3)), F.concat(word(4), F.lit("|is|"), word(5)), F.lit("a detail"))
    made = c.select(F.concat_ws(":", "conv_id", "turn").alias("response"), F.regexp_replace(lines, "\n+", "\n").alias("text"))
    return extraction.parse(made, "response", "text")


@query(r"""WITH t AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages), u AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS h FROM t),
w AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS h FROM u) SELECT page_id, md5(trim(regexp_replace(h, '\s+', ' ', 'g'))) AS text_md5 FROM w""")
def web_reader(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(readers.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("SELECT event_id, try_cast(props->>'k' AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json_properties(spark, d):
    return table(spark, d, "events").where("props is not null").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS prompt_key, length(text) // 4 AS cost FROM documents")
def prompt_cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("prompt_key"), text.token_cost(F.col("text")).alias("cost"))


@query("SELECT item_id, regexp_matches(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '(//|--)[^\\n]*', ' ', 'g'), '(?i)\\b(create|merge|set|remove|delete|drop|detach|call|insert|update|alter|truncate)\\b') AS writes FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'MATCH (n) SET n.x = 1 ' WHEN item_id % 3 = 1 THEN '/* delete */ MATCH ' ELSE '' END || text AS text FROM benchmark)")
def write_guard(spark, d):
    k = F.col("item_id") % 3
    q = F.concat(F.when(k == 0, "MATCH (n) SET n.x = 1 ").when(k == 1, "/* delete */ MATCH ").otherwise(""), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", text.is_write(q).alias("writes"))


