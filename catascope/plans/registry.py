"""The queries by name, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catascope.plans.views import Catalogue, oracle
from catascope.session import configure

QUERIES: dict[str, Callable[[Catalogue], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Catalogue], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _call(fn: Callable[[Catalogue], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Catalogue(configure(spark), sf_dir))


def load() -> None:
    from catascope.plans import catalogue, change, files, fresh, metadata, scalars, streams  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: _call(fn) for name, fn in QUERIES.items()}


def all_sql() -> dict[str, str]:
    load()
    return {name: oracle(text) for name, text in SQL.items()}
