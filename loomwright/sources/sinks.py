"""Writing results and checking that they are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

from loomwright.storage import path_exists

# The output formats a spec may name.
RETURNED = "dataframe"
WRITTEN = ("parquet", "delta", "csv")


def check_format(output_format: str) -> str:
    fmt = output_format.lower()
    if fmt != RETURNED and fmt not in WRITTEN:
        raise ValueError(
            f"unknown output format {output_format!r}; use one of {(RETURNED, *WRITTEN)}"
        )
    return fmt


def save(df: DataFrame, location: str | None, output_format: str) -> str | None:
    """Write with overwrite and return the location; ``dataframe`` writes nothing."""
    fmt = check_format(output_format)
    if fmt == RETURNED:
        return None
    if not location:
        raise ValueError(f"output format {fmt!r} needs an output location")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    try:
        writer.save(location)
    except AnalysisException as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error):
            raise ValueError(f"no provider for {fmt!r} on the classpath of this session") from error
        raise
    except Exception as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error):
            raise ValueError(f"no provider for {fmt!r} on the classpath of this session") from error
        raise
    return location


def verify_written(spark: SparkSession, location: str, output_format: str) -> None:
    """Fail when the output is absent or cannot be opened."""
    if not path_exists(spark, location):
        raise FileNotFoundError(f"nothing was written to {location}")
    spark.read.format(output_format.lower()).load(location).limit(1).collect()
