"""Question answering over a table of triples: retrievers, guarded queries, and the loop that combines them.

What a language model would choose is a function with a deterministic rule as default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import WRITES
from loomgraph.operators import rerank, triples

Select = Callable[[DataFrame, DataFrame, int], DataFrame]


def best(values: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
    """The k values (id, text) most like the phrases, TF-IDF; ties by id; values that are unlike all come last."""
    score = rerank.score(values, phrases, "id", "text")
    rows = values.join(score, "id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    return rows.orderBy(F.desc("score"), "id").limit(k)


def scored_triples(t: DataFrame, nodes: DataFrame, phrases: DataFrame, hops: int = 2, relations: int = 20, prune: int = 100, k: int = 10, select: Select = best) -> DataFrame:
    """text, score of the k best verbalised heads with a relation's tails, of triples within so many hops whose relations are
    among the best ones."""
    found = triples.written(triples.multi_hop(t, nodes, hops), "met")
    kinds = select(found.select(F.col("rel").alias("id"), F.translate("rel", "_", " ").alias("text")).distinct(), phrases, relations).select(F.col("id").alias("rel"))
    merged = triples.written(triples.verbalize_merged(found.join(triples.written(kinds, "kinds"), "rel", "left_semi")), "told")
    near = triples.written(select(merged.select(F.col("text").alias("id"), "text"), phrases, prune).select("id", "text"), "near")
    return select(near, phrases, k).select("text", "score")


def paths_between(t: DataFrame, sources: DataFrame, targets: DataFrame, metapaths: list[list[str]], most: int | None = None) -> DataFrame:
    """text of the paths along metapaths from the sources and of the shortest ones from them to the targets, once."""
    found = triples.shortest_paths(t, sources, targets, most).where("hops > 0").select("path")
    for m in metapaths:
        found = found.unionByName(triples.follow(t, sources, m).select("path"))
    return found.select(triples.verbalize_path(F.col("path")).alias("text")).distinct()


def explore(t: DataFrame, nodes: DataFrame, phrases: DataFrame, rounds: int = 3, relations: int = 5, entities: int = 10, select: Select = best) -> DataFrame:
    """src, rel, dst of triples met in rounds: of those that leave the nodes the best relations are followed, and their best
    ends are the next nodes; it ends where nothing new is met."""
    out, at = None, nodes.select("node").distinct()
    for _ in range(rounds):
        step = triples.written(triples.one_hop(t, at), "step")
        kinds = select(step.select(F.col("rel").alias("id"), F.translate("rel", "_", " ").alias("text")).distinct(), phrases, relations).select(F.col("id").alias("rel"))
        step = step.join(triples.written(kinds, "kinds"), "rel", "left_semi").select("src", "rel", "dst")
        if out is not None:
            step = step.join(out, ["src", "rel", "dst"], "left_anti")
        step = triples.written(step, "met")
        if step.isEmpty():
            break
        out = step if out is None else out.unionByName(step)
        at = select(step.select(F.col("dst").alias("id"), F.col("dst").alias("text")).distinct(), phrases, entities).select(F.col("id").alias("node"))
        at = triples.written(at, "at")
    return out if out is not None else t.select("src", "rel", "dst").limit(0)


def guarded(spark: SparkSession, query: str, tables: dict[str, DataFrame], allow_writes: bool = False) -> str:
    """A query's rows as JSON lines, or why there are none: a query that would change data isn't run."""
    bare = re.sub(r"(//|--)[^\n]*", " ", re.sub(r"(?s)/\*.*?\*/", " ", query))
    if not allow_writes and re.search(WRITES, bare):
        return "Error: the query would change data"
    try:
        return "\n".join(spark.sql(query, **tables).toJSON().collect())  # the answer to one question
    except Exception as e:
        return f"Error: {str(e).splitlines()[0]}"


def lines_of(response: str, tag: str) -> list[str]:
    """The lines of a tagged section of a model's answer, with a bound on what is told: none if the tag isn't there."""
    m = re.search(rf"(?s)<{tag}>(.*?)</{tag}>", response)
    return [x.strip() for x in m[1].splitlines() if x.strip()] if m else []


def answer(question: str, steps: list[Callable[[str, list[str]], Iterator[str]]], iterations: int = 2, finished: Callable[[list[str]], bool] = lambda c: False) -> list[str]:
    """The context that retrievers gather in rounds, each line once and in order; it ends early where finished says so."""
    context: list[str] = []
    for _ in range(iterations):
        for step in steps:
            context += [x for x in dict.fromkeys(step(question, context)) if x not in context]
        if finished(context):
            break
    return context


def agentic(question: str, retrieve: Callable[[str], dict], follow_ups: Callable[[str, list[dict]], list[str]], most: int = 3) -> dict:
    """Rounds of retrieval: each answers the questions that are open, until no further ones come up; times and tokens add up.

    retrieve gives context, milliseconds and tokens of a question.
    """
    asked, found, todo = [], [], [question]
    while todo and len(found) < most:
        found.append([retrieve(q) for q in todo])
        asked += todo
        todo = [q for q in follow_ups(question, [x for f in found for x in f]) if q not in asked]
    flat = [x for f in found for x in f]
    return {"iterations": len(found), "questions": asked, "context": list(dict.fromkeys(c for x in flat for c in x["context"])), "ms": sum(x["ms"] for x in flat), "tokens": sum(x["tokens"] for x in flat)}


#: retrievers of the benchmark by id: what they search and their fixed parameters
RETRIEVERS: dict[str, dict] = {
    "chunk": {"search": "chunk_search"}, "topic": {"search": "topic_search"}, "entity": {"search": "entity_search"}, "network": {"search": "entity_network_search"},
    "context": {"search": "context_search", "most": 3, "k": 2}, "composite": {"search": "composite", "results": 10}, "chunk_beam": {"search": "semantic_search", "width": 10, "depth": 3},
    "topic_beam": {"search": "topic_beam_search", "width": 100, "depth": 6, "mode": "path_weighted"}, "rerank_beam": {"search": "reranking_beam", "width": 10, "depth": 3},
    "statement": {"search": "statement_cosine"}, "multipart": {"search": "by_mode", "multipart": True}, "agentic": {"search": "agentic", "most": 3},
}


def run_record(question_id: str, retriever: str, question: str, context: list[str], seconds: float, tokens: int) -> str:
    """One line of a run: whole milliseconds, and the context as it was given."""
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever: {retriever}")
    return json.dumps({"question_id": question_id, "retriever": retriever, "question": question, "context": context, "ms": int(seconds * 1000), "tokens": tokens}, ensure_ascii=False)


def run_records(rows: DataFrame) -> DataFrame:
    """The lines of many runs: question_id, retriever, question, context (array), seconds, tokens."""
    return rows.select(F.to_json(F.struct("question_id", "retriever", "question", "context", F.floor(F.col("seconds") * 1000).alias("ms"), "tokens")).alias("value"))
