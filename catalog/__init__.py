"""Registered queries: each name maps to a Spark plan and, where possible, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query under ``name`` with its SQL statement, if it has one."""
    from oracle.views import with_views

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return add


def load_all() -> None:
    import importlib

    for module in ("transcripts", "evaluation", "context", "scoring", "fusion", "audits", "signals", "framing", "files", "layouts", "subclips", "streams"):
        importlib.import_module(f"catalog.{module}")
