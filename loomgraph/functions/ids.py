"""Deterministic identifiers: md5 over normalised parts, so that building a graph again gives the same rows.

Sources are known by their text and metadata, chunks also by their source, topics by source, statements
by topic; facts and entities are global, and local entities belong to a source.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TENANT = "default_"


def node_id(kind: str, *parts: Column, tenant: str | None = None) -> Column:
    """md5 of lower-cased parts, spaces as underscores, after the kind and, unless it's the default one, the tenant."""
    key = F.concat_ws("::", *([F.lit(tenant)] if tenant and tenant != DEFAULT_TENANT else []), F.lit(kind), *parts)
    return F.md5(F.lower(F.translate(key, " ", "_")).cast("binary"))


def hex_prefix(text: Column, n: int) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, n)


def source_id(text: Column, meta: Column, tenant: str = "") -> Column:
    return F.concat(F.lit(f"src:{tenant}:"), hex_prefix(text, 8), F.lit(":"), hex_prefix(meta, 4))


def chunk_id(source: Column, text: Column, meta: Column, delimiter: str = "") -> Column:
    return F.concat(source, F.lit(":"), hex_prefix(F.concat(text, F.lit(delimiter), meta), 8))


def with_tenant(node: Column, tenant: Column) -> Column:
    """Put a tenant in the empty second field of a source or chunk id."""
    return F.regexp_replace(node, "^([^:]*)::", F.concat(F.lit("$1:"), tenant, F.lit(":")))


def tenant_label(label: str, tenant: str) -> str:
    return label if tenant in ("", DEFAULT_TENANT) else f"{label}{tenant}__"


def valid_tenant(name: Column) -> Column:
    """1 to 25 lower-case letters, digits and inner full stops."""
    return name.rlike(r"^[a-z0-9]([a-z0-9.]{0,23}[a-z0-9])?$")


def metadata_string(meta: Column) -> Column:
    """k:v pairs of a string map, sorted by key, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("")))), ";")
