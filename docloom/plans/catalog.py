"""Registered queries of the engine's own operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def note(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return note


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import documents, queries  # noqa: F401

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["embedding_topk"](spark, sf_dir)
