"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from figweave.plans.fixtures import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(names: str, body: str, recursive: bool = False) -> str:
    """SQL with the named fixtures, and what they need, as CTEs before `body` (more CTEs, each with a comma behind, then SELECT)."""
    order: list[str] = []

    def add(name: str) -> None:
        needs, _ = SQL[name]
        for need in needs.split():
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in order)
    start = "WITH " + "RECURSIVE " * recursive + ctes
    body = body.strip()
    return f"{start}{' ' if body.upper().startswith('SELECT') else ', '}{body}"


def query(fixtures: str = "", sql: str | None = None, recursive: bool = False, plain: bool = False):
    """Registers a query under its function's name; without `sql`, rows only. plain: `sql` stands alone."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if plain else with_fixtures(fixtures, sql, recursive)
        return f

    return add
