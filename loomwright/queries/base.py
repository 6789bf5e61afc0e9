"""Registration and small helpers for the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sums of doubles differ in their last bits with the order of summation. Results are
# rounded half up on both sides; the small surplus keeps exact ties on one side.
def stable(column: Column | str, digits: int = 4) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    factor = float(10**digits)
    return F.floor(column * factor + 0.500001) / factor


def stable_sql(sql: str, digits: int = 4) -> str:
    return f"(floor(({sql}) * 1e{digits} + 0.500001) / 1e{digits})"
