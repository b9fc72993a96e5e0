"""Registered queries: each has a Spark plan over the role tables and, where SQL can say it, the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litquarry.sources.roles import Reader, reader, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *roles: str) -> Callable[[Callable[[Reader], DataFrame]], Callable[[Reader], DataFrame]]:
    """Registers a plan under its function's name. ``sql`` may use the named roles; further tables in it start with a comma."""

    def add(plan: Callable[[Reader], DataFrame]) -> Callable[[Reader], DataFrame]:
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(reader(spark, sf_dir))
        if sql is not None:
            SQL[plan.__name__] = with_roles(*roles, body=sql) if roles else sql
        return plan

    return add
