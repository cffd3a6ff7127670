"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from graphloom.sources.fixture import GRAPH_SQL

FOUND: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = False):
    """Registers a function of (spark, sf_dir) under its name; graph puts the graph's tables before the SQL."""

    def add(f):
        FOUND[f.__name__] = f
        if sql:
            body = sql.strip()
            SQL[f.__name__] = f"WITH RECURSIVE {GRAPH_SQL.strip()}{',' if not body.upper().startswith('SELECT') else ''} {body}" if graph else body
        return f

    return add
