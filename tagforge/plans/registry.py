"""Registry of named queries: a Spark callable each, and DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = (), recursive: bool = False):
    """Register a function under its name; ``ctes`` go before ``sql`` in a WITH clause."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add
