"""Queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without sql only its rows are checked."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def missing_where(df: DataFrame, key: str, condition: str) -> DataFrame:
    """All rows; where the condition fails or is unknown, the key is negated, so that lookups miss it."""
    return df.withColumn(key, F.when(F.expr(condition), F.col(key)).otherwise(-F.col(key) - 1))


def missing_sql(name: str, key: str, condition: str) -> str:
    """The same in SQL, as a subquery."""
    return f"(SELECT * REPLACE (CASE WHEN {condition} THEN {key} ELSE -{key} - 1 END AS {key}) FROM {name})"
