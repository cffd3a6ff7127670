"""Every query of the engine and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from graphloom.plans import analysis, communities, dataflow, graph, history, navigation, ranking, relational, resolution, retrieval, rules  # noqa: F401  they register their queries
from graphloom.plans.query import FOUND, SQL


def queries() -> dict:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
