"""Registered queries: each operator over the given tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODULES = ("envelope", "sources", "library", "handlers", "batches", "delivery", "metrics", "logs", "registry", "streams",
           "chains")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, its equivalent."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def chunked(name: str, fn: Callable[..., DataFrame], chunk_rows: int = 700) -> None:
    """Register a query again with chunks far smaller than its table, so that keys go over many of them."""
    query(f"{name}_chunked", SQL[name])(lambda spark, sf_dir: fn(spark, sf_dir, chunk_rows=chunk_rows))


def load_all() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
