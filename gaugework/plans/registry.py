"""Registry of the queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


class Tables:
    """The given parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Doubles are compared at six places."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
