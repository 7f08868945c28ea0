"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, long: str = "", double: str = ""):
    """Register a query `f(spark, sf_dir) -> DataFrame` and, when SQL can say the same, its SQL. `long` and `double`
    name the SQL columns to cast, so that both sides have the same types."""
    casts = [f"CAST({c} AS BIGINT) AS {c}" for c in long.split()] + [f"CAST({c} AS DOUBLE) AS {c}" for c in double.split()]
    if casts:
        sql = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})"

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
