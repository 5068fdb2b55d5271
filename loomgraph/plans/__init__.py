"""The registered queries, each beside its DuckDB SQL."""

from loomgraph.plans import building, context, extra, processing, searching  # noqa: F401
from loomgraph.plans.registry import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
