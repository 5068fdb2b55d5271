"""Vector search: exact scans with partial top-k on each partition; no index to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vectors


def query_vector(df: DataFrame, key: Column, column: str = "embedding") -> list[float]:
    """One stored vector, as a parameter of a search; empty if there's none."""
    row = df.where(key).select(column).limit(1).first()
    return [float(x) for x in row[0]] if row and row[0] is not None else []


def scored(df: DataFrame, q: list[float], metric: str = "l2", column: str = "embedding") -> DataFrame:
    measure = {"l2": vectors.l2, "cosine": vectors.cosine, "dot": vectors.dot}[metric]
    return df.withColumn("score", measure(F.col(column), vectors.vector(q)))


def top_k(df: DataFrame, q: list[float], k: int, id_col: str, metric: str = "l2", where: Column | None = None, column: str = "embedding") -> DataFrame:
    """The k nearest rows: least distance, or greatest similarity; ties by id."""
    rows = df.where(F.col(column).isNotNull())
    rows = scored(rows if where is None else rows.where(where), q, metric, column)
    return rows.orderBy(F.col("score") if metric == "l2" else F.desc("score"), id_col).limit(k)


def diverse_top_k(df: DataFrame, q: list[float], k: int, id_col: str, group: str, factor: int = 5, metric: str = "l2") -> DataFrame:
    """k of the nearest k * factor, taken in turns from their groups, the group with the nearest row first; without turns if a row has no group."""
    if factor < 1:
        return top_k(df, q, k, id_col, metric)
    near = top_k(df, q, k * factor, id_col, metric)
    sign = F.col("score") if metric == "l2" else -F.col("score")
    w = Window.partitionBy(group).orderBy(sign, id_col)
    whole = Window.partitionBy(F.lit(1))  # k * factor rows
    ranked = near.withColumn("turn", F.row_number().over(w)).withColumn("best", F.min(sign).over(Window.partitionBy(group)))
    ranked = ranked.withColumn("turn", F.when(F.max(F.col(group).isNull()).over(whole), 0).otherwise(F.col("turn"))).withColumn("best", F.when(F.col("turn") == 0, 0.0).otherwise(F.col("best")))
    return ranked.orderBy("turn", "best", sign, id_col).limit(k).drop("turn", "best")


def top_k_per_group(df: DataFrame, q: list[float], k: int, id_col: str, group: str, metric: str = "l2") -> DataFrame:
    """The k nearest of each group; the window's group limit keeps k rows a group and partition before the shuffle."""
    sign = F.col("score") if metric == "l2" else -F.col("score")
    rows = scored(df, q, metric).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(sign, id_col)))
    return rows.where(F.col("rank") <= k)


def insert_absent(index: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Rows of new whose id the index doesn't have, after the index."""
    return index.unionByName(new.dropDuplicates([id_col]).join(index.select(id_col), id_col, "left_anti"))


def delete_ids(index: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return index.join(ids.select(id_col), id_col, "left_anti")


def get_embeddings(index: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return index.join(ids.select(id_col).distinct(), id_col, "left_semi")


def keyword_scores(matches: DataFrame, n_keywords: int, cos: str = "cos") -> DataFrame:
    """matches: id, m (keywords met), cos. Alone among those that met as many: m / n; else weighted by the cosine."""
    many = F.count(F.lit(1)).over(Window.partitionBy("m"))
    share = F.col("m") / F.lit(float(n_keywords))
    return matches.withColumn("score", F.when(many > 1, share * (F.col(cos) + 1) / 2).otherwise(share))


def update_versions(index: DataFrame, ids: DataFrame, id_col: str, valid_to: int) -> DataFrame:
    """The index with valid_to of the given ids set."""
    gone = ids.select(id_col).distinct().withColumn("__now", F.lit(valid_to).cast("long"))
    return index.join(gone, id_col, "left").withColumn("valid_to", F.coalesce("__now", "valid_to")).drop("__now").select(*index.columns)


def twice(df: DataFrame, q: list[float], first: int, k: int, id_col: str, where: Column | None = None) -> DataFrame:
    """The k greatest cosines among the first nearest by distance: what a store gives, scored again."""
    near = top_k(df, q, first, id_col, where=where).drop("score")
    return top_k(near, q, k, id_col, "cosine")


def among(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Only vectors of the given ids, for a search with a selector."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")
