"""Registered queries of the engine, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query under a name, with the SQL that checks it."""

    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_topk"](spark, sf_dir)


def load() -> None:
    """Import the modules that register queries."""
    from . import calibration_queries, more_queries, reading_queries, relational_queries, retrieval_queries, run_queries, stream_queries  # noqa: F401
