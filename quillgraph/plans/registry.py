"""Registered queries: a name of survey IDs, a plan over the views, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans.domain import Tables, duckdb
from quillgraph.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return plan(Tables(spark, folder))

        QUERIES[name] = run
        if sql:
            SQL[name] = duckdb(sql)
        return plan

    return add
