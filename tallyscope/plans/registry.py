"""Registered queries: each with the SQL another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyscope.plans.session import Session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return run

    return add


def session(spark: SparkSession, folder: str, table: str, *select: str) -> Session:
    """A session over one test table, or over ``select`` expressions of it."""
    path = f"{folder.rstrip('/')}/{table}.parquet"
    if not select:
        return Session.of_file(spark, path, table=f"view_{table}")
    return Session.of(spark, spark.read.parquet(path).selectExpr(*select), f"view_{table}")
