"""Registered queries, the SQL that must give the same rows, and the inventory ids that each covers."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("facts", "labels", "lookups", "graphs", "relations", "retrieval", "evaluation", "ingest", "files", "segments", "questions", "builds", "risks", "patterns", "streams")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        COVERS[f.__name__] = covers
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"ledgerloom.jobs.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
