"""Queries and their SQL, by name; a query takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, *parts: str) -> str:
    """SQL of a node's id."""
    return "md5(lower(replace('" + kind + "'" + "".join(f" || '::' || {p}" for p in parts) + ", ' ', '_')))"


def klass(v: str) -> str:
    return f"(['Concept', 'Agent', 'Place'])[length({v}) % 3 + 1]"


def search(v: str) -> str:
    return rf"trim(lower(regexp_replace(regexp_replace({v}, '[^\s\p{{L}}\p{{N}}]+', ' ', 'g'), '\s+', ' ', 'g')))"


#: the graph tables in SQL, for any query's WITH
BASE = rf"""
src0 AS (SELECT *, 'lang:' || coalesce(lang, '') || ';n_chars:' || coalesce(n_chars::VARCHAR, '') || ';source:' || coalesce(source, '') AS meta FROM documents WHERE text IS NOT NULL),
src1 AS (SELECT *, 'src::' || substr(md5(text), 1, 8) || ':' || substr(md5(meta), 1, 4) AS source_id FROM src0),
src AS (SELECT source_id, max(doc_id) AS doc_id, arg_max(text, doc_id) AS text, arg_max(meta, doc_id) AS meta, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars, arg_max(source, doc_id) AS source FROM src1 GROUP BY source_id),
occ0 AS (SELECT source_id, doc_id, meta, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq, unnest(string_split(text, chr(10))) AS value FROM src),
occ AS (SELECT source_id, doc_id, seq, value, source_id || ':' || substr(md5(value || meta), 1, 8) AS chunk_id FROM occ0 WHERE trim(value) <> ''),
chunk AS (SELECT chunk_id, source_id, doc_id, max(seq) AS seq, arg_max(value, seq) AS value FROM occ GROUP BY ALL),
part0 AS (SELECT chunk_id, source_id, doc_id, seq, coalesce(nullif(lower(regexp_extract(value, '\p{{L}}{{4,}}')), ''), 'context') AS topic, generate_subscripts(string_split(value, '. '), 1) AS k, unnest(string_split(value, '. ')) AS v FROM chunk),
part1 AS (SELECT chunk_id, source_id, doc_id, seq, topic, trim(v) AS value, min(k) AS k FROM part0 WHERE trim(v) <> '' GROUP BY ALL),
part AS (SELECT chunk_id, source_id, doc_id, seq, topic, value, row_number() OVER (PARTITION BY chunk_id ORDER BY k) - 1 AS pos FROM part1),
ext0 AS (SELECT *, {node("topic", "source_id", "topic")} AS topic_id FROM part),
ext AS (SELECT *, {node("statement", "topic_id", "value")} AS statement_id FROM ext0),
topic AS (SELECT topic_id, min(source_id) AS source_id, min(topic) AS value FROM ext GROUP BY topic_id),
topic_chunk AS (SELECT DISTINCT topic_id, chunk_id FROM ext),
statement AS (SELECT statement_id, topic_id, chunk_id, source_id, seq, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY seq, pos) AS rn FROM ext) WHERE rn = 1),
previous AS (SELECT * FROM (SELECT statement_id, lag(statement_id) OVER (PARTITION BY topic_id, chunk_id ORDER BY pos) AS previous_id FROM statement) WHERE previous_id IS NOT NULL),
sf0 AS (SELECT statement_id, source_id, regexp_extract_all(value, '\p{{L}}{{5,}}') AS w FROM statement),
sf1 AS (SELECT statement_id, source_id, w[1] AS subject, CASE WHEN len(w) >= 3 THEN upper(replace(w[len(w) // 2 + 1], 'ß', 'ss')) ELSE 'RELATES_TO' END AS predicate, w[len(w)] AS object FROM sf0 WHERE len(w) >= 2),
sf2 AS (SELECT *, subject || ' ' || predicate || ' ' || object AS value, lower(subject) = lower(object) AS local FROM sf1),
statement_fact AS (SELECT *, {node("fact", "value")} AS fact_id, {node("entity", "subject", klass("subject"))} AS subject_id,
    CASE WHEN local THEN {node("local-entity", "object", "source_id")} ELSE {node("entity", "object", klass("object"))} END AS object_id FROM sf2),
supports AS (SELECT DISTINCT fact_id, statement_id FROM statement_fact),
fact AS (SELECT fact_id, min(value) AS value, min(predicate) AS predicate FROM statement_fact GROUP BY fact_id),
ent0 AS (SELECT subject_id AS entity_id, subject AS value, false AS is_local FROM statement_fact UNION ALL SELECT object_id, object, local FROM statement_fact),
ent1 AS (SELECT entity_id, min(value) AS value, bool_and(is_local) AS is_local FROM ent0 GROUP BY entity_id),
entity AS (SELECT entity_id, value, {search("value")} AS search_str, CASE WHEN is_local THEN 'unknown' ELSE {klass("value")} END AS class, is_local FROM ent1),
entity_fact AS (SELECT DISTINCT subject_id AS entity_id, fact_id, 'SUBJECT' AS role FROM statement_fact UNION SELECT DISTINCT object_id, fact_id, 'OBJECT' FROM statement_fact),
relation AS (SELECT DISTINCT subject_id AS src, predicate AS rel, object_id AS dst FROM statement_fact WHERE NOT local),
degree AS (SELECT entity_id, count(*) AS degree FROM entity_fact GROUP BY entity_id)"""


def base(select: str, more: str = "") -> str:
    return f"WITH {BASE}{', ' + more if more else ''} {select}"
