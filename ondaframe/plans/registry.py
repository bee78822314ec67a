"""Queries by key, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plan(key: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under key."""

    def add(f):
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add
