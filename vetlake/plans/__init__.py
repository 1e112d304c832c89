"""Queries over the synthetic tables, each with the SQL that DuckDB checks it by where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame as a query, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def load() -> None:
    for part in ("detection", "scoring", "inventory", "governance", "vectors", "images"):
        import_module(f"{__name__}.{part}")
