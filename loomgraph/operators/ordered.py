"""Set operations that keep an order: first seen, last written, without repeats, without prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Of rows with one key the first by order; an aggregation, so many rows of one key are combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    place = F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)))
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("r")).select(key, "r.*").select(*rows.columns)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows whose keys differ by case only the last one by order."""
    rest = [c for c in rows.columns if c != order]
    return rows.groupBy(F.lower(key).alias("__k")).agg(F.max_by(F.struct(*rest), order).alias("r"), F.max(order).alias(order)).select("r.*", order).select(*rows.columns)


def appended(context: DataFrame, more: DataFrame, value: str, place: str) -> DataFrame:
    """value and place of a context with what more adds to it: values that it hasn't, in their order, behind it."""
    both = context.select(value, F.struct(F.lit(0).alias("part"), F.col(place).alias("at")).alias("p")).unionByName(more.select(value, F.struct(F.lit(1).alias("part"), F.col(place).alias("at")).alias("p")))
    return both.groupBy(value).agg(F.min("p").alias("p")).select(value, F.col("p.part").alias("part"), F.col("p.at").alias(place))


def without_prefixes(rows: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """Rows whose key isn't a beginning of another's; of equal keys one stays.

    In sorted order a key is a beginning of another one only if it is one of the next, so no pairs are made.
    """
    by = [group] if group else [F.lit(1)]
    one = rows.dropDuplicates([*([group] if group else []), key])
    after = F.lead(key).over(Window.partitionBy(*by).orderBy(key))
    return one.withColumn("__next", after).where(F.col("__next").isNull() | ~F.col("__next").startswith(F.col(key))).drop("__next")
