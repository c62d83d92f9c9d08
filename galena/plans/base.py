"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galena.sources.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The time that freshness is judged at; never the clock.
AS_OF = "2001-06-01 00:00:00"


def query(key: str, sql: str | None = None) -> Callable:
    """Register a function of the tables under ``key``, with DuckDB SQL for the same rows if there is any."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLES[key] = sql
        return build

    return register
