"""Result processors over flat rows: source_id, topic, chunk_id, statement, score, retriever.

A topic without statements, or a result without topics, is no row, so nothing has to prune them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.shared import written


def dedup_merge(rows: DataFrame) -> DataFrame:
    """One row for each source, topic and statement: scores are added, retrievers united."""
    return rows.groupBy("source_id", "topic", "statement").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("retriever")), ",").alias("retrievers"))


def disaggregate(rows: DataFrame) -> DataFrame:
    """A result for each topic of a source; its score is that of its best statement."""
    return rows.groupBy("source_id", "topic").agg(F.max("score").alias("result_score"))


def rescore(rows: DataFrame) -> DataFrame:
    """A result's score: the greatest mean statement score of its topics."""
    return rows.groupBy("source_id", "topic").agg(F.avg("score").alias("m")).groupBy("source_id").agg(F.max("m").alias("result_score"))


def prune_statements(rows: DataFrame, factor: float = 0.05, threshold: float = 0.0) -> DataFrame:
    """Statements whose score is at least the threshold and factor times the greatest one."""
    top = rows.agg(F.greatest(F.lit(threshold), F.lit(factor) * F.coalesce(F.max("score"), F.lit(0.0))).alias("least_score"))
    return rows.join(F.broadcast(top), F.col("score") >= F.col("least_score")).drop("least_score")  # one row


def prune_results(results: DataFrame, threshold: float = 0.08) -> DataFrame:
    return results.where(F.col("result_score") >= threshold)


def truncate_statements(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k best statements of each topic of a source."""
    w = Window.partitionBy("source_id", "topic").orderBy(F.desc("score"), "statement")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def truncate_results(results: DataFrame, k: int = 5) -> DataFrame:
    return results.orderBy(F.desc("result_score"), "source_id").limit(k)


def token_budget(rows: DataFrame, budget: int, cost: Column) -> DataFrame:
    """Statements by descending score until the budget is met; the first is always kept, the first that doesn't fit ends it.

    Costs are at least 0. Where the budget ends is found by the sums of 200 ranges of scores; only the rows of the range
    in which it ends are walked through, in one task (a sort that spills).
    """
    order = [F.desc("score"), "source_id", "topic", "statement"]
    rows = written(rows.withColumn("cost", cost), "costs")  # made once, for four passes
    bounds = sorted(set(rows.agg(F.percentile_approx("score", [k / 200 for k in range(201)], 10_000)).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("score"))) if bounds else F.lit(0)
    sums = dict(rows.groupBy(part.alias("k")).agg(F.sum("cost")).collect())  # 201 ranges
    left, k = budget, len(bounds)
    while k > 0 and (sums.get(k) or 0) <= left:
        left -= sums.get(k) or 0
        k -= 1
    whole = rows.where(part > k)
    w = Window.orderBy(*order)
    run = rows.where(part == k).withColumn("spent", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    first = F.col("rank") == 1 if k == len(bounds) else F.lit(False)
    return whole.unionByName(run.where((F.col("spent") <= left) | first).drop("spent", "rank"))


def token_budget_per_topic(rows: DataFrame, budget: int, cost: Column) -> DataFrame:
    """Each topic gets an equal part of the budget, which its first statement may exceed; all stops where the whole budget is spent.

    Results are visited by descending score (see rescore) and id, their topics by name. A topic that is reached while
    anything is left keeps its first statement; a further one that what is left doesn't pay for ends the topic. Costs
    aren't negative. What the parts allow may cost more than the budget only by first statements; then the results
    that can be reached are found by the sums of their first statements, first those of ranges of scores,
    and only these are walked through, in one task.
    """
    part = budget // max(1, rows.select("source_id", "topic").distinct().count())
    w = Window.partitionBy("source_id", "topic").orderBy(F.desc("score"), "statement")
    run = rows.withColumn("cost", cost).withColumn("spent", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    kept = run.where((F.col("spent") <= part) | (F.col("rank") == 1))
    if (kept.agg(F.sum("cost")).first()[0] or 0) < budget:
        return kept.drop("spent", "rank")
    scored = rescore(rows).withColumn("result_score", F.round("result_score", 9))
    least = kept.where("rank = 1").groupBy("source_id").agg(F.sum("cost").alias("least")).join(scored, "source_id")
    bounds = sorted(set(scored.agg(F.percentile_approx("result_score", [k / 200 for k in range(200)], 10_000)).first()[0] or []))
    sums = dict(least.groupBy(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("result_score"))).alias("k")).agg(F.sum("least")).collect())
    need, total = len(bounds), 0
    while need and (total := total + (sums.get(need) or 0)) < budget:
        need -= 1
    need -= 1  # sums of floats may differ in the last place when they are made again
    near = scored.where(F.col("result_score") >= bounds[need - 1]) if need > 0 else scored
    walked = kept.join(near, "source_id").repartition(1).sortWithinPartitions(F.desc("result_score"), "source_id", "topic", "rank")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, closed = budget, False
        for b in batches:
            keep = []
            for rank, c in zip(b.column("rank").to_pylist(), b.column("cost").to_pylist()):
                closed = left <= 0 or rank > 1 and (closed or (c or 0) > left)
                keep.append(not closed)
                if not closed:
                    left -= c or 0
            yield b.filter(pa.array(keep, pa.bool_()))

    return walked.mapInArrow(walk, walked.schema).drop("spent", "rank", "result_score")


def statement_strings(rows: DataFrame) -> DataFrame:
    """statement (details: fact, fact) where there are facts."""
    told = F.concat(F.col("statement"), F.lit(" (details: "), F.array_join("facts", ", "), F.lit(")"))
    return rows.withColumn("statement_str", F.when(F.size("facts") > 0, told).otherwise(F.col("statement")))


def format_sources(metadata: Column, keys: list[str] | None = None, template: str | None = None) -> Column:
    """A source as text: a template's $keys filled in; the first of keys that it has; else its longest value with the rest in brackets."""
    if template is not None:
        parts = []

        for m in re.finditer(r"([^$]*)(?:\$(\w+))?", template):
            parts.append(F.lit(m[1]))
            if m[2]:
                parts.append(F.coalesce(metadata[m[2]], F.lit("")))
        return F.concat(*parts)
    if keys:
        return F.coalesce(*(metadata[k] for k in keys), F.lit(""))
    values = F.array_sort(F.map_values(metadata), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.concat(F.element_at(values, 1), F.when(F.size(values) > 1, F.concat(F.lit(" ("), F.array_join(F.slice(values, F.lit(2), F.size(values) - 1), ", "), F.lit(")"))).otherwise(""))


def single_topic_flatten(rows: DataFrame) -> DataFrame:
    """Results with one topic lose its name."""
    many = rows.groupBy("source_id").agg(F.count_distinct("topic").alias("topics"))
    return rows.join(many, "source_id").withColumn("topic", F.when(F.col("topics") > 1, F.col("topic"))).drop("topics")


def greedy_diversity(pairs: DataFrame, items: DataFrame, threshold: float = 0.975) -> DataFrame:
    """Items (id, rank), in rank order, that aren't more similar than the threshold to one kept before; pairs (a, b, sim) are those above it.

    The pairs of a result list, which has a few hundred items, make one small group.
    """
    close = pairs.where(F.col("sim") > threshold).groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("close"))
    rows = items.join(close, "id", "left").withColumn("one", F.lit(1))

    def keep(df: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in df.sort_values(["rank", "id"]).itertuples():
            if r.close is None or not set(kept).intersection(r.close):
                kept.append(r.id)
        return pd.DataFrame({"id": kept})

    return rows.groupBy("one").applyInPandas(keep, T.StructType([items.schema["id"]]))


def strip_keys(metadata: Column, keys: list[str]) -> Column:
    return F.map_filter(metadata, lambda k, _: ~k.isin(*keys))
