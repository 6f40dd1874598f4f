"""Queries of the training-data operators: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def registered():
    import importlib
    import pkgutil

    import talkmill.llm as package

    for module in pkgutil.iter_modules(package.__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{package.__name__}.{module.name}")
    return QUERIES, SQL
