"""Registry of named queries: Spark builder + (optional) DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrel.plans.standins import with_standins

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, standins: list[str] | None = None, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame` under `key`.

    `sql` is the equivalent DuckDB query over the raw tables; the named
    stand-ins are prepended as CTEs.  Omit `sql` for operators that SQL cannot
    express (iterative fits); those are checked by property tests instead."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_standins(standins or [], sql)
        return fn
    return deco
