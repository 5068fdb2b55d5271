"""Benchmark metrics: latency, cost, correctness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, exact median and 95th percentile with linear interpolation, to two places."""
    return rows.groupBy(by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 2).alias("avg_ms"), F.round(F.percentile(value, 0.5), 2).alias("p50_ms"), F.round(F.percentile(value, 0.95), 2).alias("p95_ms")
    )


def tokens_cost(rows: DataFrame, by: str, tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> DataFrame:
    """Totals, means over known counts, numbers of unknown ones, and cost by prices for a million."""
    t = rows.select(by, tokens_in.alias("i"), tokens_out.alias("o"))
    return t.groupBy(by).agg(
        F.sum("i").cast("long").alias("input_tokens"), F.sum("o").cast("long").alias("output_tokens"), F.round(F.avg("i"), 2).alias("avg_input"), F.round(F.avg("o"), 2).alias("avg_output"),
        F.count_if(F.col("i").isNull() | F.col("o").isNull()).alias("missing"),
        F.round((F.coalesce(F.sum("i"), F.lit(0)) * price_in + F.coalesce(F.sum("o"), F.lit(0)) * price_out) / 1e6, 6).alias("cost"),
    )


def correctness(rows: DataFrame, by: str, grade: Column, idk: Column) -> DataFrame:
    """Share of correct grades, a missing grade being wrong, and of unanswerable ones."""
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(grade == "correct", 1.0).otherwise(0.0)), 5).alias("correctness"), F.round(F.avg(F.when(idk, 1.0).otherwise(0.0)), 5).alias("idk_rate")
    )


def correct_on_answerable(rows: DataFrame, by: str, grade: Column, idk: Column) -> DataFrame:
    """Share of correct grades among answerable questions; 0 without any."""
    good = F.when(grade == "correct", 1.0).otherwise(0.0)
    return rows.groupBy(by).agg(F.round(F.coalesce(F.avg(F.when(~idk, good)), F.lit(0.0)), 5).alias("correct_on_answerable"))


def comparison(rows: DataFrame, by: str) -> DataFrame:
    """Correctness per second and per cost of summary rows (correctness, seconds, cost), ranked, unknown ones last."""
    made = rows.withColumn("per_second", F.round(F.when(F.col("seconds") > 0, F.col("correctness") / F.col("seconds")), 6)).withColumn("per_cost", F.round(F.when(F.col("cost") > 0, F.col("correctness") / F.col("cost")), 6))
    return made.orderBy(F.desc_nulls_last("per_cost"), by)


def multi_hop(rows: DataFrame, by: str, hop: Column, grade: Column, least: int = 10) -> DataFrame:
    """Correctness on multi-hop questions; few says that there are under ``least``."""
    return rows.where(hop == "multi-hop").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(grade == "correct", 1.0).otherwise(0.0)), 5).alias("accuracy")).withColumn("few", F.col("n") < least)
