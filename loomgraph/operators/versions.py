"""Versions of sources, deletes, tenants, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.filters import UPPER, version_predicate
from loomgraph.operators.graph import Graph


def intervals(rows: DataFrame, key: str, valid_from: str = "valid_from") -> DataFrame:
    """valid_to of each version: the next later start of the same logical source, else the upper sentinel; equal starts share an interval."""
    starts = rows.select(key, valid_from).distinct()
    after = F.lead(valid_from).over(Window.partitionBy(key).orderBy(valid_from))
    starts = starts.withColumn("valid_to", F.coalesce(after, F.lit(UPPER)))
    return rows.join(starts, [key, valid_from])


def insert_versions(stored: DataFrame, new: DataFrame, key: str, valid_from: str = "valid_from") -> DataFrame:
    """Versions with those of new, which may lie between others; all intervals derived again."""
    return intervals(stored.select(*[c for c in stored.columns if c != "valid_to"]).unionByName(new), key, valid_from)


def delete_sources(g: Graph, gone: Column) -> dict[str, DataFrame]:
    """The tables that stay when the sources that gone holds for are deleted with all that only they have."""
    drop = g.source.where(gone).select("source_id")
    anti = lambda df, other, on: df.join(other, on, "left_anti")
    statement = anti(g.statement, drop, "source_id")
    supports = g.supports.join(statement.select("statement_id"), "statement_id", "left_semi")
    fact = g.fact.join(supports.select("fact_id"), "fact_id", "left_semi")
    edges = g.entity_fact.join(fact.select("fact_id"), "fact_id", "left_semi")
    return {
        "source": anti(g.source, drop, "source_id"), "chunk": anti(g.chunk, drop, "source_id"), "topic": anti(g.topic, drop, "source_id"), "statement": statement,
        "fact": fact, "entity": g.entity.join(edges.select("entity_id"), "entity_id", "left_semi"), "supports": supports, "entity_fact": edges,
    }


def orphans(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return nodes.join(edges.select(key), key, "left_anti")


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a checkpoint."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def version_defaults(rows: DataFrame) -> DataFrame:
    """Rows written before versions were kept, with open intervals."""
    for c, v in (("valid_from", -1), ("valid_to", UPPER)):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast("long")) if c in rows.columns else F.lit(v).cast("long"))
    return rows


def repair_duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one id the one of greatest order."""
    from loomgraph.operators.graph import last_by

    return last_by(rows, [key], order)


def logical_key(metadata: Column, fields: list[str]) -> Column:
    """What tells the versions of one source: the names of its id fields, and their values; null if it has none of them."""
    values = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit(f + "\x1e"), metadata[f]), F.lit("")) for f in fields))
    some = F.coalesce(*(metadata[f] for f in fields)) if fields else F.lit(None).cast("string")
    return F.when(some.isNotNull(), F.md5(F.concat(F.lit(";".join(fields) + "\x1d"), values).cast("binary")))


def earlier_versions(stored: DataFrame, new: DataFrame, fields: list[str], id_col: str = "source_id") -> DataFrame:
    """new_id and the stored sources (id, valid_from, valid_to) with equal values in the id fields; both have id and metadata."""
    a = new.select(F.col(id_col).alias("new_id"), logical_key(F.col("metadata"), fields).alias("k")).where("k is not null")
    b = stored.select(F.col(id_col).alias("old_id"), logical_key(F.col("metadata"), fields).alias("k"), *[c for c in ("valid_from", "valid_to") if c in stored.columns])
    return version_defaults(a.join(b, "k").where("new_id <> old_id").drop("k"))


def vector_versions(vectors: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Vectors of chunks, topics or statements with the interval of their source, which is kept in one place and joined."""
    return vectors.drop("valid_from", "valid_to").join(version_defaults(sources).select(key, "valid_from", "valid_to"), key)


def deletable(g: Graph, earlier: DataFrame, may_go: Column) -> DataFrame:
    """source_id of earlier versions (old_id) whose metadata the predicate doesn't protect."""
    ids = earlier.select(F.col("old_id").alias("source_id")).distinct()
    return g.source.join(ids, "source_id", "left_semi").where(F.coalesce(may_go, F.lit(False))).select("source_id")


def get_sources(sources: DataFrame, ids: list[str] | None = None, where: Column | None = None, mode: str = "CURRENT", at: int | None = None, order_by: list[str | Column] = ("source_id",)) -> DataFrame:
    """Sources by ids, filter and version, in order; versions that aren't kept are open."""
    rows = version_defaults(sources).where(version_predicate(mode, at))
    if ids is not None:
        rows = rows.where(F.col("source_id").isin(ids))
    return (rows if where is None else rows.where(where)).orderBy(*order_by)
