"""Metadata filters as trees that compile to a predicate.

In a plain ("dict") predicate a missing value meets no condition but IS_EMPTY, and NOT is the negation of all
its children together; text matching ignores case. The "graph" mode compares text with case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = 10_000_000_000_000
LOWER = -1


@dataclass(frozen=True)
class Leaf:
    key: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Tree:
    condition: str
    children: tuple


def all_of(*x) -> Tree:
    return Tree("AND", x)


def any_of(*x) -> Tree:
    return Tree("OR", x)


def none_of(*x) -> Tree:
    if any(isinstance(c, Leaf) for c in x):
        raise ValueError("NOT takes filter groups")
    return Tree("NOT", x)


def from_dicts(d: dict | list[dict]) -> Tree:
    """A dict is an AND of equalities, a list of them an OR."""
    return any_of(*(from_dicts(x) for x in d)) if isinstance(d, list) else all_of(*(Leaf(k, "EQ", v) for k, v in d.items()))


def typed(column: Column, value: object) -> tuple[Column, Column]:
    """The column as the operand's type, and the operand; text that doesn't parse is null."""
    if isinstance(value, (datetime, date)):
        return F.try_to_timestamp(column.cast("string")), F.lit(value).cast("timestamp")
    if isinstance(value, bool):
        return column.try_cast("int"), F.lit(int(value))
    if isinstance(value, int):
        return column.try_cast("bigint"), F.lit(value)
    if isinstance(value, float):
        return column.try_cast("double"), F.lit(value)
    return column.cast("string"), F.lit(str(value))


def compile(f: Leaf | Tree, column: Callable[[str], Column], mode: str = "dict") -> Column:  # noqa: A001
    if isinstance(f, Tree):
        parts = [compile(c, column, mode) for c in f.children]
        if not parts:
            return F.lit(True)
        return reduce(or_, parts) if f.condition == "OR" else reduce(and_, parts) if f.condition == "AND" else ~reduce(and_, parts)
    c = column(f.key)
    if f.op == "IS_EMPTY":
        return c.isNull() | (c.cast("string") == "")
    if f.op in ("IN", "NIN", "ANY", "ALL"):
        values = list(f.value)
        text = c.cast("string")
        if f.op == "ANY":
            made = reduce(or_, (text.contains(str(v)) for v in values), F.lit(False))
        elif f.op == "ALL":
            made = reduce(and_, (text.contains(str(v)) for v in values), F.lit(True))
        else:
            made = reduce(or_, (typed(c, v)[0] == typed(c, v)[1] for v in values), F.lit(False))
            made = made if f.op == "IN" else ~made
        return F.coalesce(made, F.lit(False))
    a, b = typed(c, f.value)
    if f.op == "TEXT_MATCH" and mode == "dict":
        a, b = F.lower(a), F.lower(b)
    if f.op == "TEXT_MATCH_INSENSITIVE":
        if mode == "dict":
            raise ValueError("unsupported operator: TEXT_MATCH_INSENSITIVE")
        a, b = F.lower(a), F.lower(b)
    made = {
        "EQ": lambda: a == b, "NE": lambda: a != b, "GT": lambda: a > b, "GTE": lambda: a >= b, "LT": lambda: a < b, "LTE": lambda: a <= b,
        "CONTAINS": lambda: a.contains(b), "TEXT_MATCH": lambda: a.contains(b), "TEXT_MATCH_INSENSITIVE": lambda: a.contains(b),
    }
    if f.op not in made:
        raise ValueError(f"unsupported operator: {f.op}")
    return F.coalesce(made[f.op](), F.lit(False))


def version_predicate(mode: str, at: int | None = None, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Rows of half-open intervals that a version mode wants; missing bounds are the sentinels."""
    a, b = F.coalesce(F.col(valid_from), F.lit(LOWER)), F.coalesce(F.col(valid_to), F.lit(UPPER))
    return {
        "NO_VERSIONING": lambda: F.lit(True), "CURRENT": lambda: b == UPPER, "PREVIOUS": lambda: b < UPPER, "AT": lambda: (a <= at) & (b > at),
        "BEFORE": lambda: b < at, "ON_OR_AFTER": lambda: a >= at,
    }[mode]()
