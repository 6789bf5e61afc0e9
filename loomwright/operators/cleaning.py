"""Cleaning steps of a spec."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomwright.functions.names import strip_blank
from loomwright.operators.aggregates import means, medians, modes, numeric_columns, scalar_row
from loomwright.storage import unused_name

STRATEGIES = ("mean", "median", "mode")


def require_columns(df: DataFrame, columns: Sequence[str], step: str) -> list[str]:
    """The columns as ``df`` spells them: Spark finds names without regard to case by default."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    have = {c if exact else c.lower(): c for c in reversed(df.columns)} | {c: c for c in df.columns}
    found = [have.get(c, have.get(c if exact else c.lower())) for c in columns]
    missing = [c for c, f in zip(columns, found) if f is None]
    if missing:
        raise ValueError(f"{step}: no such columns {missing}")
    return found


def columns_with_nulls(df: DataFrame) -> list[str]:
    counts = df.agg(*[F.count_if(F.col(c).isNull()) for c in df.columns]).first()
    return [c for c, n in zip(df.columns, counts) if n]


def _plain(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def fill(df: DataFrame, values: Column, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), values.getField(c)) for c in columns})


def impute(
    df: DataFrame,
    strategy: str = "mean",
    columns: Sequence[str] | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Replace nulls by a statistic of their column.

    Without columns every column of plain values that has nulls is filled: numbers by
    the strategy, all others by their most frequent value. Arrays, maps and structs are
    filled only where they are named; maps and variants cannot be compared and never are.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown imputation strategy {strategy!r}; use one of {STRATEGIES}")
    if columns is None:
        columns = columns_with_nulls(df.select([f.name for f in df.schema.fields if _plain(f.dataType)]))
    columns = require_columns(df, columns, "imputation")
    numeric = set(numeric_columns(df)) if strategy != "mode" else set()
    by_number = [c for c in columns if c in numeric]
    by_mode = [c for c in columns if c not in numeric]
    out = df
    if by_number:
        stats = means(df, by_number) if strategy == "mean" else medians(df, by_number, accuracy)
        out = fill(out, scalar_row(stats), by_number)
    if by_mode:
        out = fill(out, scalar_row(modes(df, by_mode)), by_mode)
    return out


def mean_and_deviation(df: DataFrame, columns: Sequence[str]) -> Column:
    return scalar_row(
        df.agg(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_samp(c).alias(f"{c}_sd") for c in columns],
        )
    )


def drop_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Keep rows with |z| up to the threshold; null values and constant columns stay."""
    columns = require_columns(df, columns, "outlier removal")
    stats = mean_and_deviation(df, columns)
    keep = F.lit(True)
    for c in columns:
        z = F.try_divide(F.abs(F.col(c) - stats[f"{c}_mean"]), stats[f"{c}_sd"])
        keep = keep & (z.isNull() | (z <= threshold))
    return df.where(keep)


def cap_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Clip values to mean ± threshold deviations; nulls stay null."""
    columns = require_columns(df, columns, "outlier capping")
    stats = mean_and_deviation(df, columns)

    def clipped(c: str) -> Column:
        mean, reach = stats[f"{c}_mean"], stats[f"{c}_sd"] * threshold
        inside = F.least(F.greatest(F.col(c), mean - reach), mean + reach)
        # least and greatest skip nulls: without the guard they would return a bound.
        return F.when(F.col(c).isNotNull() & reach.isNotNull(), inside).otherwise(F.col(c))

    return df.withColumns({c: clipped(c) for c in columns})


def deduplicate(
    df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] | None = None
) -> DataFrame:
    """One row per distinct subset; with an order, the first row of each.

    Ranks are limited before the shuffle as well, so a huge group of copies leaves
    each task as one row.
    """
    if not order_by:
        return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()
    subset = require_columns(df, subset or df.columns, "deduplication")
    order_by = require_columns(df, order_by, "deduplication")
    first = Window.partitionBy(*subset).orderBy(*order_by)
    place = unused_name(df)
    return df.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)


def convert_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that does not convert becomes null."""
    columns = require_columns(df, list(types), "conversion")
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in zip(columns, types.values())})


def clean_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip text columns; blank texts become null."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    columns = require_columns(df, columns, "cleaning")
    return df.withColumns({c: F.nullif(strip_blank(F.col(c)), F.lit("")) for c in columns})
