"""Whole searches: from seeds through the shared grouping and the chain of processors to results in order."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import beam, rerank
from loomgraph.operators import processors as p
from loomgraph.operators import retrieval as r
from loomgraph.operators import vector as v
from loomgraph.operators.context import per_keyword
from loomgraph.operators.graph import Graph
from loomgraph.operators.ordered import first_seen
from loomgraph.sources.shared import few, written


def told(g: Graph, rows: DataFrame) -> DataFrame:
    """Grouped rows with topic, statement and statement string (the statement with its facts)."""
    ids = few(rows.select("statement_id"))
    on = few(g.supports.join(ids, "statement_id"))
    facts = g.fact.select("fact_id", "value").join(on, "fact_id").groupBy("statement_id").agg(F.sort_array(F.collect_set("value")).alias("facts"))
    said = g.statement.select("statement_id", F.col("value").alias("statement")).join(ids, "statement_id")
    topics = g.topic.select("topic_id", F.col("value").alias("topic")).join(few(rows.select("topic_id")), "topic_id")
    named = rows.join(said, "statement_id").join(topics, "topic_id")
    named = named.join(facts, "statement_id", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))
    return p.statement_strings(named).drop("facts")


def chain(g: Graph, rows: DataFrame, phrases: DataFrame, factor: float = 0.05, threshold: float = 0.0, per_topic: int = 10, results: int = 5, result_threshold: float = 0.0) -> DataFrame:
    """The processors that follow a search: equal statements of a topic become one, statements are reranked by TF-IDF of
    'topic: statement' against phrases (m, text) and those without a score go, pruned, results get the greatest mean of
    their topics, are pruned, sorted and cut, and topics keep their best statements.

    Rows: source_id, topic_id, statement_id, statement_str, score, result_score, result_rank from 1.
    """
    one = written(first_seen(told(g, written(rows, "found")), "statement_id", "source_id", "topic_id"), "told")
    text = one.select("statement_id", F.concat("topic", F.lit(": "), "statement_str").alias("text"))
    score = rerank.score(text, phrases, "statement_id", "text").select("statement_id", F.round("score", 4).alias("score"))
    scored = p.prune_statements(written(one.drop("score", "result_score").join(score, "statement_id").where("score > 0"), "scored"), factor, threshold)
    best = scored.groupBy("source_id", "topic_id").agg(F.avg("score").alias("m")).groupBy("source_id").agg(F.round(F.max("m"), 6).alias("result_score")).where(F.col("result_score") >= result_threshold)
    best = p.truncate_results(best, results).withColumn("result_rank", F.row_number().over(Window.orderBy(F.desc("result_score"), "source_id")))  # results rows
    w = Window.partitionBy("source_id", "topic_id").orderBy(F.desc("score"), "statement_id")
    kept = scored.join(F.broadcast(best), "source_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_topic)
    return kept.select("source_id", "topic_id", "statement_id", "statement_str", "score", "result_score", "result_rank")


def level_written(df: DataFrame) -> DataFrame:
    """A beam's level or what it has found, written, so that plans don't grow with the depth."""
    return written(df, "level")


def semantic_chunks(g: Graph, vectors: DataFrame, q: list[float], k: int = 5, width: int = 10, depth: int = 3) -> DataFrame:
    """chunk_id: the k nearest by distance, by cosine again, and those that a beam over neighbouring chunks finds from them.

    vectors: chunk_id, embedding.
    """
    near = v.top_k(vectors, q, k, "chunk_id").select("chunk_id", "embedding")
    seeds = v.top_k(near, q, k, "chunk_id", "cosine").select("chunk_id")
    e = vectors.select(F.col("chunk_id").alias("node"), "embedding")
    step = lambda level: r.chunk_neighbours(g, level.select(F.col("node").alias("chunk_id"))).select(F.col("chunk_id").alias("node"), F.col("other_id").alias("other"))
    found = beam.search(seeds.select(F.col("chunk_id").alias("node")), step, e, q, "cosine", width, depth, level_written)
    return seeds.unionByName(found.select(F.col("node").alias("chunk_id"))).distinct()


def semantic_search(g: Graph, vectors: DataFrame, q: list[float], **options) -> DataFrame:
    return r.grouped(g, r.chunk_statements(g, semantic_chunks(g, vectors, q, **options)))


def topic_beam_search(g: Graph, vectors: DataFrame, q: list[float], seeds: int = 50, width: int = 100, depth: int = 6, mode: str = "path_weighted") -> DataFrame:
    """Statements of topics that a beam over neighbouring topics finds from the nearest; vectors: topic_id, embedding."""
    near = v.top_k(vectors, q, seeds, "topic_id").select(F.col("topic_id").alias("node"))
    e = vectors.select(F.col("topic_id").alias("node"), "embedding")
    step = lambda level: r.topic_neighbours(g, level.select(F.col("node").alias("topic_id"))).select(F.col("topic_id").alias("node"), F.col("other_id").alias("other"))
    found = beam.search(near, step, e, q, mode, width, depth, level_written)
    return r.grouped(g, r.topic_statements(g, found.select(F.col("node").alias("topic_id"))))


def reranking_beam(seeds: DataFrame, neighbours: Callable[[DataFrame], DataFrame], texts: DataFrame, phrases: DataFrame, width: int = 10, depth: int = 3) -> DataFrame:
    """node, score, depth: a beam whose nodes (node, text) are scored by TF-IDF against phrases (m, text), the weights being
    those of all texts; each node is scored once."""
    score = written(rerank.score(texts, phrases, "node", "text").select("node", F.round("score", 6).alias("score")), "scores")
    level = seeds.select("node").distinct().join(score, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(0).alias("depth")).orderBy(F.desc("score"), "node").limit(width)
    level = found = level_written(level)
    for k in range(1, depth + 1):
        step = few(neighbours(level.select("node")).select(F.col("other").alias("node")).join(F.broadcast(found.select("node")), "node", "left_anti"))
        level = score.join(step, "node", "right").select("node", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(k).alias("depth")).orderBy(F.desc("score"), "node").limit(width)
        level = level_written(level)
        found = found.unionByName(level)
    return found


def context_search(contexts: list[str], search: Callable[[str, int], DataFrame], most: int = 3, k: int = 2) -> DataFrame | None:
    """What a search finds for each of the first contexts, k results each, once."""
    out = None
    for c in contexts[:most]:
        one = search(c, k)
        out = one if out is None else out.unionByName(one)
    return None if out is None else out.distinct()


def by_mode(keywords: list[str], search: Callable[[str, int], DataFrame], question: str, limit: int = 10, multipart: bool = True) -> DataFrame:
    """One search for the question, or one for each of its keywords with a share of the results each."""
    if not multipart or len(keywords) < 2:
        return search(question, limit)
    out = None
    for w in keywords:
        one = search(w, per_keyword(limit, len(keywords)))
        out = one if out is None else out.unionByName(one)
    return out


def composite(g: Graph, parts: list[tuple[DataFrame, float]], results: int = 10) -> DataFrame:
    """Searches' statements with weights: each gives ceil(results * weight) sources of its own grouping, a statement counts once.

    A source's result_score and a statement's score are those of the first part that has it.
    """
    out = None
    for k, (statements, weight) in enumerate(parts):
        one = r.grouped(g, statements, ceil(results * weight)).withColumn("part", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return first_seen(out, "statement_id", "part").drop("part")
