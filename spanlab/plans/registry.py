"""Queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, and the DuckDB SQL that gives the same rows."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


for _family in ("text", "keys", "joins", "aggregates", "series", "intervals", "splits", "checks", "spans", "sampling", "signals", "detection", "metrics", "diagnostics", "io", "streams"):
    import_module(f"spanlab.plans.{_family}_queries")
