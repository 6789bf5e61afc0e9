"""Feature steps of a spec."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomwright.operators.aggregates import scalar_row, unique_labels
from loomwright.operators.cleaning import mean_and_deviation, require_columns
from loomwright.storage import stage

DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "weekday": F.weekday,
    "hour": F.hour,
    "quarter": F.quarter,
}


#: So many values at most become columns; beyond, the sparse form takes any number.
MAX_FLAGS = 10_000


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """0/1 columns ``<column>_<value>``. Unlisted values are looked up first, since each becomes
    a column; more than ``MAX_FLAGS`` are refused, see ``one_hot_sparse``. Values whose names
    would be equal get a counter, in the order of the values."""
    (column,) = require_columns(df, [column], "one-hot encoding")
    if values is None:
        found = df.select(column).where(F.col(column).isNotNull()).distinct()
        values = sorted(r[0] for r in found.limit(MAX_FLAGS + 1).collect())
        if len(values) > MAX_FLAGS:
            raise ValueError(f"{column!r} has more than {MAX_FLAGS} values; ask for the sparse form")
    flags = {
        f"{column}_{label}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0))
        for v, label in zip(values, unique_labels(values))
    }
    return df.withColumns(flags)


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank): the dense rank from 0 of each distinct value, in the order of values.

    Values are dealt by range and sorted within; a value's rank is its place there after the counts of
    the ranges before. Only these counts, one number a range, meet in one place.
    """
    distinct = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    placed = stage(
        distinct.repartitionByRange("value").sortWithinPartitions("value")
        .withColumn("place", F.monotonically_increasing_id()),  # range number, and place within it
        "value-ranks")
    range_of = F.shiftright("place", 33).alias("range")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(range_of).agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # One row per range: at most as many as there are shuffle partitions.
    return placed.withColumn("range", range_of).join(F.broadcast(starts), "range").select(
        "value", (F.col("start") + F.col("place") - F.shiftleft(F.col("range"), 33)).alias("rank"))


def one_hot_sparse(df: DataFrame, column: str) -> DataFrame:
    """``<column>_vector``: a sparse vector (size, indices, values) with a 1 at the value's rank.

    For any number of values: ranks are made and joined without reading one back. A null has no
    index. Rows of a value that most rows have are split by adaptive execution.
    """
    (column,) = require_columns(df, [column], "one-hot encoding")
    ranks = stage(value_ranks(df, column), "value-dictionary")
    size = ranks.agg(F.count("*").alias("size")).scalar()
    rows = df.select(F.struct("*").alias("row")).join(ranks, F.col("row")[column] == F.col("value"), "left")
    there = F.col("rank").isNotNull()
    vector = F.struct(
        size.alias("size"),
        F.when(there, F.array("rank")).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)")).alias("indices"),
        F.when(there, F.array(F.lit(1.0))).otherwise(F.expr("CAST(array() AS ARRAY<DOUBLE>)")).alias("values"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c.lower() != f"{column}_vector".lower()]
    return rows.select(*kept, vector.alias(f"{column}_vector"))


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """``<column>_scaled`` by z-score or to [0, 1]; null where the range is zero."""
    columns = require_columns(df, columns, "scaling")
    if method == "standard":
        stats = mean_and_deviation(df, columns)
        return df.withColumns(
            {
                f"{c}_scaled": F.try_divide(F.col(c) - stats[f"{c}_mean"], stats[f"{c}_sd"])
                for c in columns
            }
        )
    if method == "minmax":
        stats = scalar_row(
            df.agg(
                *[F.min(c).cast("double").alias(f"{c}_min") for c in columns],
                *[F.max(c).cast("double").alias(f"{c}_max") for c in columns],
            )
        )
        return df.withColumns(
            {
                f"{c}_scaled": F.try_divide(
                    F.col(c) - stats[f"{c}_min"], stats[f"{c}_max"] - stats[f"{c}_min"]
                )
                for c in columns
            }
        )
    raise ValueError(f"unknown scaling method {method!r}; use 'standard' or 'minmax'")


def polynomial(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Squares ``<c>_squared`` and pair products ``<a>_x_<b>``, as doubles: those of integers overflow."""
    columns = require_columns(df, columns, "polynomial features")

    def product(a: str, b: str) -> Column:
        return F.col(a).cast("double") * F.col(b).cast("double")

    products = {f"{c}_squared": product(c, c) for c in columns}
    products |= {f"{a}_x_{b}": product(a, b) for a, b in combinations(columns, 2)}
    return df.withColumns(products)


def date_parts(
    df: DataFrame, columns: Sequence[str], parts: Sequence[str] = tuple(DATE_PARTS)
) -> DataFrame:
    """``<column>_<part>`` for each calendar part; Monday is weekday 0.

    A text that is no date has null parts.
    """
    columns = require_columns(df, columns, "date features")
    unknown = [p for p in parts if p not in DATE_PARTS]
    if unknown:
        raise ValueError(f"unknown date parts {unknown}")

    def moment(c: str) -> Column:
        text = isinstance(df.schema[c].dataType, T.StringType)
        return F.col(c).try_cast("timestamp") if text else F.col(c)

    return df.withColumns({f"{c}_{p}": DATE_PARTS[p](moment(c)) for c in columns for p in parts})


def ratio(df: DataFrame, numerator: str, denominator: str, name: str | None = None) -> DataFrame:
    """Quotient of two columns, null where the divisor is zero."""
    numerator, denominator = require_columns(df, [numerator, denominator], "ratio")
    return df.withColumn(
        name or f"{numerator}_{denominator}_ratio", F.try_divide(numerator, denominator)
    )


def expression(df: DataFrame, name: str, sql: str) -> DataFrame:
    """A column given as SQL text."""
    return df.withColumn(name, F.expr(sql))


def select_features(df: DataFrame, features: Sequence[str] | None, target: str | None) -> DataFrame:
    """Features in their order, then the target; all columns when none are listed."""
    if not features:
        return df
    chosen = list(dict.fromkeys([*features, *([target] if target else [])]))
    return df.select(*require_columns(df, chosen, "feature selection"))
