"""Registered queries: importing :func:`all_queries` loads every plan module."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(name to callable, name to DuckDB SQL)."""
    from tagforge.plans import counting, genomes, models, statistics  # noqa: F401
    from tagforge.plans.registry import QUERIES, SQL

    return QUERIES, SQL
