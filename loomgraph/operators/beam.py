"""Level-synchronous beam search: each depth keeps the best ``width`` new nodes, ties by id.

The frontier of a level and the nodes seen have at most width * (depth + 1) rows, so they're broadcast; a
level's lineage is cut by writing it out where a folder is given for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vectors
from loomgraph.sources.shared import few


def node_score(mode: str, node: Column, parent: Column, q: list[float]) -> Column:
    """cosine: of node and query; path_weighted: times the mean of 1 and the cosine with the parent; path_propagated: cosine of query and parent times that of parent and node; attention: weighted by the softmax over siblings of node * parent / sqrt(d)."""
    query = vectors.vector(q)
    own = vectors.cosine(query, node)
    if mode == "cosine":
        return own
    if mode == "path_weighted":
        return own * (1 + vectors.cosine(parent, node)) / 2
    if mode == "path_propagated":
        return vectors.cosine(query, parent) * vectors.cosine(parent, node)
    if mode == "attention":
        e = F.exp(vectors.dot(node, parent) / F.sqrt(F.lit(float(len(q)))))
        return own * (1 + e / F.sum(e).over(Window.partitionBy("parent")))
    raise ValueError(f"unknown mode: {mode}")


def search(seeds: DataFrame, neighbours: Callable[[DataFrame], DataFrame], embeddings: DataFrame, q: list[float], mode: str = "cosine", width: int = 100, depth: int = 8, write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node, score, path, depth: seeds (column node) at depth 0, and what they lead to.

    neighbours: of a frame with column node to (node, other). embeddings: node, embedding. Nodes that several parents lead to keep their best score.
    """
    e = embeddings.select("node", "embedding")
    level = seeds.select("node").distinct().join(e, "node").select("node", vectors.cosine(vectors.vector(q), F.col("embedding")).alias("score"), F.array("node").alias("path"), "embedding", F.lit(0).alias("depth"))
    level = level.orderBy(F.desc("score"), "node").limit(width)
    found = level
    for k in range(1, depth + 1):
        if write is not None:
            level, found = write(level), write(found)
        step = F.broadcast(level.select(F.col("node").alias("parent"), "path", F.col("embedding").alias("pe"))).join(neighbours(level.select("node")).select(F.col("node").alias("parent"), F.col("other").alias("node")).distinct(), "parent")
        step = step.join(F.broadcast(found.select("node")), "node", "left_anti")
        step = e.join(step if write is None else few(step), "node")
        step = step.withColumn("score", F.round(node_score(mode, F.col("embedding"), F.col("pe"), q), 9))
        best = step.groupBy("node").agg(F.max_by(F.struct("score", "path", "embedding"), F.struct("score", "parent")).alias("b"))
        level = best.select("node", "b.score", F.concat("b.path", F.array("node")).alias("path"), "b.embedding", F.lit(k).alias("depth")).orderBy(F.desc("score"), "node").limit(width)
        found = found.unionByName(level)
        if write is not None and level.isEmpty():
            break
    return found.select("node", "score", "path", "depth").orderBy(F.desc("score"), "node").limit(width)
