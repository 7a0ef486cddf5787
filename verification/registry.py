"""Where queries and their SQL are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verification.tables import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf: tidy(build(spark, sf), digits)
    if sql is not None:
        ORACLES[name] = sql
