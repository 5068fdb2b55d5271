"""Queries over a table of triples (src, rel, dst): expansion, metapaths, shortest paths, verbalising, linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.shared import few, written


def one_hop(triples: DataFrame, nodes: DataFrame, rel: str | None = None) -> DataFrame:
    """Distinct triples that leave one of the nodes (column node)."""
    t = triples if rel is None else triples.where(F.col("rel") == rel)
    return t.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select("src", "rel", "dst").distinct()


def expand(triples: DataFrame, nodes: DataFrame, rel: str | None = None) -> DataFrame:
    """Distinct destinations of a hop."""
    return one_hop(triples, nodes, rel).select(F.col("dst").alias("node")).distinct()


def multi_hop(triples: DataFrame, nodes: DataFrame, hops: int = 2) -> DataFrame:
    """Distinct triples on paths of at most so many hops."""
    out, at = None, nodes
    for _ in range(hops):
        step = written(one_hop(triples, at), "step")
        out = step if out is None else out.unionByName(step)
        at = few(step.select(F.col("dst").alias("node")))
    return out.distinct()


def follow(triples: DataFrame, nodes: DataFrame, metapath: list[str]) -> DataFrame:
    """Full paths whose relations are those of the metapath; loops on a node are skipped. Columns: path (node, rel, node ...)."""
    at = nodes.select(F.col("node").alias("at"), F.array("node").alias("path")).distinct()
    for rel in metapath:
        step = triples.where((F.col("rel") == rel) & (F.col("src") != F.col("dst"))).select(F.col("src").alias("at"), "rel", "dst")
        at = at.join(step, "at").select(F.col("dst").alias("at"), F.concat("path", F.array("rel", "dst")).alias("path"))
    return at.select("path").distinct()


def shortest_paths(triples: DataFrame, sources: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """target, path (nodes and relations), hops: of the shortest paths from any source the first by text.

    Breadth first: each level keeps one path a node, and nodes reached before are left out. Without ``most`` it ends
    when all targets or all nodes that can be reached are. Each level is written, so plans don't grow with the depth.
    """
    edges = triples.where("src <> dst").select("src", "rel", "dst").distinct()
    goal = written(targets.select(F.col("node").alias("target")).distinct(), "goals")
    level = written(sources.select("node").distinct().select("node", F.array("node").alias("path")), "level")
    hit = lambda df, k: df.join(goal, F.col("node") == F.col("target")).select("target", "path", F.lit(k).alias("hops"))
    seen, found, k, left = level.select("node"), hit(level, 0), 0, goal.count()
    left -= found.count()
    while left and (most is None or k < most):
        k += 1
        step = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("rel", "dst")).alias("path"))
        level = written(step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"), "level")
        if level.isEmpty():
            break
        new = hit(level, k)
        left -= new.count()
        found, seen = found.unionByName(new), seen.unionByName(level.select("node"))
    return found


def verbalize(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" -> ", "src", "rel", "dst").alias("text"))


def verbalize_merged(triples: DataFrame, most: int | None = None) -> DataFrame:
    """h -> r -> t1 | t2: the tails of a head and relation in order, the first most of them."""
    t = triples.select("src", "rel", "dst").distinct()
    if most is not None:
        t = t.withColumn("n", F.row_number().over(Window.partitionBy("src", "rel").orderBy("dst"))).where(F.col("n") <= most)
    tails = t.groupBy("src", "rel").agg(F.array_join(F.array_sort(F.collect_list("dst")), " | ").alias("tails"))
    return tails.select(F.concat_ws(" -> ", "src", "rel", "tails").alias("text"))


def verbalize_path(path: Column) -> Column:
    """start -> r1 > n1 > r2 -> end."""
    return F.concat_ws(" -> ", F.element_at(path, 1), F.array_join(F.slice(path, F.lit(2), F.size(path) - 2), " > "), F.element_at(path, -1))


def schema(triples: DataFrame, type_of: Column, to_type: Column) -> DataFrame:
    """Distinct (type, relation, type)."""
    return triples.select(type_of.alias("from_type"), "rel", to_type.alias("to_type")).distinct()


def ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100 * (1 - F.levenshtein(a, b) / longest))


def fuzzy_link(queries: DataFrame, vocabulary: DataFrame, k: int = 3, longer: int = 4) -> DataFrame:
    """q and its k most alike entries v, of those at most ``longer`` characters shorter than q; ties by v.

    The questions are a stated set of a few strings, which is broadcast; each partition of the vocabulary keeps its k best first.
    """
    pairs = vocabulary.select("v").distinct().join(F.broadcast(queries.select("q").distinct()), F.length("v") + longer >= F.length("q"))
    ranked = pairs.withColumn("score", ratio(F.lower("q"), F.lower("v")))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def read_csv(spark, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Triples from the first three columns of a file; shorter rows are skipped."""
    df = spark.read.option("header", header).option("sep", sep).csv(path)
    a, b, c = (F.col(f"`{x}`") for x in df.columns[:3])
    return df.select(a.alias("src"), b.alias("rel"), c.alias("dst")).where("src is not null and rel is not null and dst is not null")


def read_ntriples(spark, path: str) -> DataFrame:
    """Triples of lines <s> <p> <o> . or <s> <p> "o" ."""
    pattern = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*$'
    part = lambda i: F.regexp_extract("value", pattern, i)
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(part(1).alias("src"), part(2).alias("rel"), F.when(part(3) != "", part(3)).otherwise(part(4)).alias("dst"))
