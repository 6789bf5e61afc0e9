"""Table scans: CSV and Parquet by name, folder discovery, dictionaries."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomwright.storage import (
    file_uri, first_line, is_folder, list_folder, path_exists, spread, stage, unused_name,
)

# The cell texts that a dictionary reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
INFERENCE_LABEL = "spark_dynamic_inference"

DICTIONARY_SCHEMA = "Table string, Row string, Description string"
PROFILE_SCHEMA = (
    "table_name string, position int, column_name string, data_type string, inferred_from string, n_rows long")
COLUMNS_SCHEMA = "table_name string, position int, column_name string, data_type string, inferred_from string"


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    drop_malformed: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Headered CSV. A given schema saves the inference pass over the file.

    Column pruning in the parser would let a malformed row through whenever the
    query reads few columns, so it is off when such rows are dropped. ``multi_line`` reads
    quoted texts with line breaks; a file is then one task, since it cannot be split.
    """
    reader = spark.read.option("header", True)
    if multi_line:
        reader = reader.option("multiLine", True).option("escape", '"')
    if drop_malformed:
        reader = reader.option("mode", "DROPMALFORMED").option("columnPruning", False)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_with_quarantine(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined): the rows that fit the schema, and (line, file) of those that do not.

    A row with a cell that does not convert, or with more or fewer cells than the schema,
    is quarantined as it stands in the file. The file is parsed once; both results read what that wrote.
    """
    plain = spark.createDataFrame([], schema).schema
    bad = unused_name(spark.createDataFrame([], plain))
    reader = spark.read.option("header", header).option("columnPruning", False).option("mode", "PERMISSIVE")
    if multi_line:
        reader = reader.option("multiLine", True).option("escape", '"')
    full = T.StructType([*plain.fields, T.StructField(bad, T.StringType())])
    parsed = reader.option("columnNameOfCorruptRecord", bad).schema(full).csv(path)
    file = unused_name(parsed)
    parsed = stage(parsed.withColumn(file, F.col("_metadata.file_name")), "parsed")
    rows = parsed.where(F.col(bad).isNull()).select(*plain.names)
    return rows, parsed.where(F.col(bad).isNotNull()).select(F.col(bad).alias("line"), F.col(file).alias("file"))


def discover_csv_tables(
    spark: SparkSession, folder: str, dictionary_path: str | None = None
) -> list[tuple[str, str]]:
    """(table name, path) of each ``*.csv`` entry but the dictionary."""
    skipped = dictionary_path.rstrip("/").rsplit("/", 1)[-1] if dictionary_path else None
    found = []
    for path in list_folder(spark, folder):
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if name.endswith(".csv") and name != skipped:
            stem = name[: -len(".csv")] or name
            found.append((stem.lower(), path))
    return found


# Kinds of a cell, from the narrowest; a column's type follows from the set of its cells' kinds.
_INTEGER, _LONG, _WHOLE, _DOUBLE, _DATE, _TIMESTAMP, _BOOLEAN, _TEXT = (1 << i for i in range(8))
_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?$|^NaN$|^-?Inf(inity)?$"


def _kind_of(cell: Column) -> Column:
    """The bit of the narrowest type that a cell can be read as; 0 for a missing one."""
    whole = cell.rlike("^[+-]?[0-9]+$")
    return (
        F.when(cell.isNull() | (cell == ""), F.lit(0))
        .when(whole & cell.try_cast("int").isNotNull(), _INTEGER)
        .when(whole & cell.try_cast("long").isNotNull(), _LONG)
        .when(whole, _WHOLE)
        .when(cell.rlike(_REAL), _DOUBLE)
        .when(cell.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & cell.try_cast("date").isNotNull(), _DATE)
        .when(cell.try_cast("timestamp").isNotNull(), _TIMESTAMP)
        .when(F.length(cell).isin(4, 5) & F.lower(cell).isin("true", "false"), _BOOLEAN)
        .otherwise(_TEXT))


def _type_of(kinds: Column, digits: Column) -> Column:
    """The text of the least type that holds cells of all these kinds."""
    def only(mask: int) -> Column:
        return kinds.bitwiseAND(F.lit(255 - mask)) == 0

    return (
        F.when(kinds == 0, "StringType()")
        .when(only(_INTEGER), "IntegerType()")
        .when(only(_INTEGER | _LONG), "LongType()")
        .when(only(_INTEGER | _LONG | _WHOLE) & (digits <= 38),
              F.concat(F.lit("DecimalType("), digits.cast("string"), F.lit(",0)")))
        .when(only(_INTEGER | _LONG | _WHOLE | _DOUBLE), "DoubleType()")
        .when(only(_DATE), "DateType()")
        .when(only(_DATE | _TIMESTAMP), "TimestampType()")
        .when(only(_BOOLEAN), "BooleanType()")
        .otherwise("StringType()"))


def _header(spark: SparkSession, path: str) -> list[str] | None:
    """The cells of the first line of a table's first file; None for one without a line."""
    files = [path] if not is_folder(spark, path) else [
        f for f in list_folder(spark, path) if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
    line = next((x for x in (first_line(spark, f) for f in files) if x), None)
    if line is None:
        return None
    return next(csv.reader([line.lstrip("\ufeff")]))


def _column_names(cells: list[str]) -> list[str]:
    """Header cells as column names: blank ones and repeated ones get their position."""
    seen = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not c else f"{c}{i}" if seen[c.lower()] > 1 else c for i, c in enumerate(cells)]


def profile_tables(
    spark: SparkSession, tables: list[tuple[str, str]], parallelism: int = 8, multi_line: bool = False
) -> DataFrame:
    """Inferred columns with ``n_rows``: one Spark job for all files together.

    The headers, one line of a file each, are read beside each other. Each row then gives its cells'
    kinds, whose sets merge by bitwise or, per table; a file that is read in many tasks, and a
    table of many files, combine in the same way. Rows that repeat the header are none. A
    table that cannot be read, or has no header, gets no row.
    """
    def header(item):
        try:
            return item[0], item[1], _header(spark, item[1])
        except Exception as error:  # an unreadable file is a table without columns
            print(f"no schema for {item[0]}: {str(error).splitlines()[0]}")
            return item[0], item[1], None

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        found = [x for x in pool.map(header, tables) if x[2]]
    if not found:
        return spark.createDataFrame([], PROFILE_SCHEMA)
    width = max(len(names) for _, _, names in found)
    cells = [f"c{i}" for i in range(width)]
    reader = spark.read.schema(", ".join(f"{c} string" for c in cells))
    if multi_line:
        reader = reader.option("multiLine", True).option("escape", '"')
    entry = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.csv)(/[^/]*)?$", 1)
    # A file with quoted line breaks is one task to parse; what follows is spread over the cores.
    rows = spread(reader.csv([path for _, path, _ in found]).select(entry.alias("entry"), *cells))
    listed = spark.createDataFrame(
        [(file_uri(spark, path).rsplit("/", 1)[-1], name, _column_names(header_), header_)
         for name, path, header_ in found],
        "entry string, table_name string, names array<string>, header array<string>")
    is_header = reduce(and_, (
        F.nullif(F.col(c), F.lit("")).eqNullSafe(F.nullif(F.get("header", F.lit(i)), F.lit("")))
        for i, c in enumerate(cells)))
    # A line per file, which the driver has just read: rows stay in the tasks that parse them, while a
    # join by file would send all rows of a table to one task.
    data = rows.join(F.broadcast(listed), "entry").where(~is_header)
    kinds = [F.bit_or(_kind_of(F.col(c))).alias(f"k{i}") for i, c in enumerate(cells)]
    digits = [F.max(F.when(F.col(c).rlike("^[+-]?[0-9]+$"), F.length(c) - F.substr(F.col(c), F.lit(1), F.lit(1)).isin("+", "-").cast("int"))).alias(f"d{i}")
              for i, c in enumerate(cells)]
    merged = data.groupBy("table_name").agg(F.count("*").alias("n_rows"), *kinds, *digits)
    # Tables without a data row have no group of their own.
    profile = listed.join(merged, "table_name", "left").select(
        "table_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.posexplode(F.arrays_zip(
            F.col("names").alias("name"), F.array(*(f"k{i}" for i in range(width))).alias("kinds"),
            F.array(*(f"d{i}" for i in range(width))).alias("digits"))).alias("position", "x"))
    return profile.where("x.name IS NOT NULL").select(
        "table_name", "position", F.col("x.name").alias("column_name"),
        _type_of(F.coalesce("x.kinds", F.lit(0)), F.coalesce("x.digits", F.lit(0))).alias("data_type"),
        F.lit(INFERENCE_LABEL).alias("inferred_from"), "n_rows")


def infer_columns(
    spark: SparkSession,
    tables: list[tuple[str, str]],
    parallelism: int = 8,
    multi_line: bool = False,
) -> DataFrame:
    """One row per (table, column) with its inferred type. A table that cannot be read gets no row."""
    return profile_tables(spark, tables, parallelism, multi_line).drop("n_rows")


def table_names(spark: SparkSession, tables: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(name,) for name, _ in tables], "table_name string")


def columns_of(df: DataFrame, table_name: str) -> DataFrame:
    """Column listing of a frame as rows."""
    rows = [
        (table_name, i, f.name, str(f.dataType), INFERENCE_LABEL)
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, COLUMNS_SCHEMA)


def preview(df: DataFrame, *order_by: str, n: int = 5) -> DataFrame:
    """First rows; which ones is only defined with an order."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 data dictionary with trimmed header names and missing cells as null.

    A missing or unreadable file gives an empty frame.
    """
    empty = spark.createDataFrame([], DICTIONARY_SCHEMA)
    if not path_exists(spark, path):
        print(f"no dictionary at {path}: descriptions stay empty")
        return empty
    raw = spark.read.csv(
        path, header=True, encoding="ISO-8859-1", multiLine=True, quote='"', escape='"'
    )
    named = raw.toDF(*[c.strip() for c in raw.columns])
    return blank_na_tokens(
        named.select(
            *[
                (F.col(c) if c in named.columns else F.lit(None)).cast("string").alias(c)
                for c in ("Table", "Row", "Description")
            ]
        )
    )


def blank_na_tokens(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(
        *[F.when(~F.col(c).isin(NA_TOKENS), F.col(c)).alias(c) for c in dictionary.columns]
    )


class TableSource:
    """Tables by name: from ready frames, or from files under a base path."""

    def __init__(
        self,
        spark: SparkSession,
        base_path: str | None = None,
        fmt: str = "csv",
        frames: Mapping[str, DataFrame] | None = None,
        schemas: Mapping[str, T.StructType | str] | None = None,
    ):
        if fmt not in ("csv", "parquet"):
            raise ValueError(f"unknown table format {fmt!r}")
        self._spark = spark
        self._base = base_path.rstrip("/") if base_path else None
        self._fmt = fmt
        self._frames = dict(frames or {})
        self._schemas = dict(schemas or {})

    def table(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        if self._base is None:
            raise ValueError(f"no table {name!r} in the source")
        path = f"{self._base}/{name}.{self._fmt}"
        schema = self._schemas.get(name)
        if self._fmt == "csv":
            return read_csv_table(self._spark, path, schema)
        reader = self._spark.read.schema(schema) if schema is not None else self._spark.read
        return reader.parquet(path)
