"""Named queries and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerwatch.sources.views import Views, with_views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _CHECKS[name] = with_views(sql)
        return fn

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: fn(Views(spark, folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_checks() -> dict[str, str]:
    return dict(_CHECKS)
