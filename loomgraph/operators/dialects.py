"""Metadata filters in the dialects of stores: SQL text with bound parameters, JSON operators, rewritten keys; build filters, metadata for indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.filters import Leaf, Tree

VERSION_COLUMNS = {"valid_from", "valid_to"}
SQL_OPS = {"EQ": "=", "NE": "<>", "GT": ">", "GTE": ">=", "LT": "<", "LTE": "<="}
JSON_OPS = {"EQ": "$eq", "NE": "$ne", "GT": "$gt", "GTE": "$gte", "LT": "$lt", "LTE": "$lte", "IN": "$in", "NIN": "$nin"}


def quoted(key: str) -> str:
    return "`" + key.replace("`", "``") + "`"


def to_sql(f: Leaf | Tree, column: Callable[[str], str] = quoted, mark: Callable[[int], str] = lambda k: "?", before: int = 0) -> tuple[str, list]:
    """A predicate with a mark for each value, and the values; numbers are compared as numbers, text matching ignores case.

    The marks are numbered from before on, in the order of the text.
    """
    if isinstance(f, Tree):
        parts, values = [], []
        for c in f.children:
            text, mine = to_sql(c, column, mark, before + len(values))
            parts.append(f"({text})")
            values += mine
        if not parts:
            return "true", []
        joined = (" OR " if f.condition == "OR" else " AND ").join(parts)
        return (f"NOT ({joined})" if f.condition == "NOT" else joined), values
    c, one = column(f.key), mark(before)
    if f.op == "IS_EMPTY":
        return f"{c} IS NULL OR CAST({c} AS STRING) = ''", []
    if f.op in SQL_OPS:
        kind = "BIGINT" if isinstance(f.value, int) and not isinstance(f.value, bool) else "DOUBLE" if isinstance(f.value, float) else "STRING"
        return f"coalesce(try_cast({c} AS {kind}) {SQL_OPS[f.op]} {one}, false)", [f.value if kind != "STRING" else str(f.value)]
    if f.op in ("IN", "NIN"):
        values = [str(v) for v in f.value]
        return f"coalesce(CAST({c} AS STRING) {'IN' if f.op == 'IN' else 'NOT IN'} ({', '.join(mark(before + k) for k in range(len(values)))}), false)", values
    if f.op == "CONTAINS":
        return f"coalesce(contains(CAST({c} AS STRING), {one}), false)", [str(f.value)]
    if f.op in ("TEXT_MATCH", "TEXT_MATCH_INSENSITIVE"):
        return f"coalesce(contains(lower(CAST({c} AS STRING)), lower({one})), false)", [str(f.value)]
    raise ValueError(f"unsupported operator: {f.op}")


def where_sql(df: DataFrame, f: Leaf | Tree) -> DataFrame:
    """Rows that the SQL text of a filter, with its values bound, holds for.

    Values are bound by name, as Spark binds five and more by position in another order than that of the text.
    """
    text, values = to_sql(f, mark=lambda k: f":v{k}")
    return df.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE {text}", args={f"v{k}": v for k, v in enumerate(values)} or None, rows=df)


def to_json_ops(f: Leaf | Tree) -> dict:
    """A filter as nested $and, $or and comparison operators; NOT can't be said in it."""
    if isinstance(f, Tree):
        if f.condition == "NOT":
            raise ValueError("NOT isn't supported")
        made = [to_json_ops(c) for c in f.children]
        return made[0] if len(made) == 1 else {"$and" if f.condition == "AND" else "$or": made}
    if f.op == "IS_EMPTY":
        return {f.key: {"$exists": False}}
    if f.op not in JSON_OPS:
        raise ValueError(f"unsupported operator: {f.op}")
    return {f.key: {JSON_OPS[f.op]: f.value}}


def from_json_ops(d: dict) -> Leaf | Tree:
    """The filter that such a dict says; several keys are an AND."""
    back, made = {v: k for k, v in JSON_OPS.items()}, []
    for key, value in d.items():
        if key in ("$and", "$or"):
            made.append(Tree(key[1:].upper(), tuple(from_json_ops(x) for x in value)))
        else:
            for op, x in value.items() if isinstance(value, dict) else [("$eq", value)]:
                empty = Leaf(key, "IS_EMPTY")
                made.append((Tree("NOT", (Tree("AND", (empty,)),)) if x else empty) if op == "$exists" else Leaf(key, back[op], x))
    return made[0] if len(made) == 1 else Tree("AND", tuple(made))


def with_keys(f: Leaf | Tree, rename: Callable[[str], str]) -> Leaf | Tree:
    """The filter with every key renamed, as where metadata lies under a prefix."""
    return Leaf(rename(f.key), f.op, f.value) if isinstance(f, Leaf) else Tree(f.condition, tuple(with_keys(c, rename) for c in f.children))


def metadata_key(key: str) -> str:
    """Where a store keeps a metadata key; the bounds of versions lie beside it."""
    return f"metadata.source.versioning.{key}" if key in VERSION_COLUMNS else f"metadata.source.metadata.{key}"


def build_filters(extracted: DataFrame, source: Column | None = None, ignore_topic: Column | None = None, ignore_statement: Column | None = None) -> DataFrame:
    """Extracted statements that are built: of sources that source holds for, less ignored topics and statements; null ignores nothing."""
    for ignore in (ignore_topic, ignore_statement):
        if ignore is not None:
            extracted = extracted.where(~F.coalesce(ignore, F.lit(False)))
    return extracted if source is None else extracted.where(F.coalesce(source, F.lit(False)))


def index_metadata(metadata: Column, is_time: Callable[[Column], Column] = lambda k: k.endswith("_date") | k.endswith("_datetime")) -> Column:
    """A string map for an index: times as ISO text, and without those keys of times whose value doesn't parse."""
    iso = lambda v: F.date_format(F.try_to_timestamp(v), "yyyy-MM-dd'T'HH:mm:ss")
    kept = F.map_filter(metadata, lambda k, v: ~is_time(k) | F.try_to_timestamp(v).isNotNull())
    return F.transform_values(kept, lambda k, v: F.when(is_time(k), iso(v)).otherwise(v))


def split_collections(metadata: Column) -> tuple[Column, Column]:
    """A string map of JSON values as that of plain ones and that of arrays and objects."""
    many = lambda k, v: F.coalesce(F.trim(v).rlike(r"^[\[{]") & F.try_parse_json(v).isNotNull(), F.lit(False))
    return F.map_filter(metadata, lambda k, v: ~many(k, v)), F.map_filter(metadata, many)
