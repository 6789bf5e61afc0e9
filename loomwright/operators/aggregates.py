"""Roll-ups to a key and whole-column statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomwright.storage import stage

ROLL_UP_FUNCTIONS = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}

_SKETCH_ACCURACY = 100_000


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def status_label(value: object) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in str(value))


def unique_labels(values: Sequence) -> list[str]:
    """Names of values, in their order; one that is taken gets a counter: ``A_B``, ``A_B_2``."""
    used: set[str] = set()
    names = []
    for value in values:
        base = name = status_label(value)
        number = 1
        while name.lower() in used:  # column names collide without regard to case
            number += 1
            name = f"{base}_{number}"
        used.add(name.lower())
        names.append(name)
    return names


def roll_up(
    child: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    functions: Sequence[str] = tuple(ROLL_UP_FUNCTIONS),
    status: Mapping[str, Sequence] | None = None,
    prefix: str = "",
) -> DataFrame:
    """One row per key: the functions over each numeric column, and how often each
    listed status value occurs (0 when it never does).

    One shuffle, combined on the map side; all expressions in a single ``agg``.
    """
    unknown = [f for f in functions if f not in ROLL_UP_FUNCTIONS]
    if unknown:
        raise ValueError(f"unknown roll-up functions {unknown}")
    status = status or {}
    if columns is None:
        columns = numeric_columns(child, exclude=keys)
    features = [
        ROLL_UP_FUNCTIONS[f](c).alias(f"{prefix}{c}_{f}") for c in columns for f in functions
    ]
    features += [
        F.count_if(F.col(c) == F.lit(v)).alias(f"{prefix}{c}_{label}_count")
        for c, values in status.items()
        for v, label in zip(values, unique_labels(values))
    ]
    if not features:
        raise ValueError("a roll-up needs numeric columns or status values")
    return child.groupBy(*keys).agg(*features)


def scalar_row(row: DataFrame) -> Column:
    """A one-row frame as a struct that other frames read like a literal."""
    return row.select(F.struct("*").alias("row")).scalar()


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of each column, the smallest on ties.

    Values are counted by a distributed group-by (a third of all rows may share
    one value; it is counted before the shuffle) instead of the built-in ``mode``,
    which keeps all distinct values in one task. Each column keeps its own type.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}

    def cell(i: int) -> Column:
        own = [
            (F.col(c) if i == j else F.lit(None).cast(fields[c])).alias(f"v{j}")
            for j, c in enumerate(columns)
        ]
        return F.struct(F.lit(i).alias("i"), F.col(columns[i]).isNotNull().alias("given"), *own)

    keys = ["i", *(f"v{j}" for j in range(len(columns)))]
    cells = df.select(F.explode(F.array(*map(cell, range(len(columns))))).alias("cell"))
    counts = cells.select("cell.*").where("given").groupBy(*keys).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), *keys[1:]))
    winners = counts.groupBy("i").agg(best.alias("best"))
    return winners.groupBy().agg(
        *[
            F.max_by(f"best.v{j}", F.col("i") == j).alias(c)
            for j, c in enumerate(columns)
        ]
    )


def means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def medians(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """One row with the median of each column: exact, unless an accuracy is given.

    The middle ranks of all columns are searched together, in passes over the data that
    return a few numbers per column: a quantile sketch brackets each rank, and counting tells
    whether the rank falls on an end of its bracket or between the ends, where the next
    pass looks. A bracket holds some hundred-thousandth of the rows it came from, so two or
    three passes are the rule, and no values meet in one task.
    """
    if accuracy:
        return df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in columns])
    # Read in each pass: written once, so that what makes the columns is not computed again.
    values = stage(
        df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]), "median-columns")
    around = F.array(*(F.lit(min(max(0.5 + d / _SKETCH_ACCURACY, 0.0), 1.0)) for d in (-2.0, 2.0)))
    first = values.agg(
        *[F.count(f"v{i}") for i in range(len(columns))],
        *[F.percentile_approx(f"v{i}", around, _SKETCH_ACCURACY) for i in range(len(columns))]).first()
    sizes, brackets = first[:len(columns)], first[len(columns):]
    wanted = {(i, r) for i, n in enumerate(sizes) if n for r in ((n - 1) // 2, n // 2)}
    found = _values_at_ranks(values, wanted, sizes, brackets)
    middle = [
        (found[i, (n - 1) // 2] + found[i, n // 2]) / 2.0 if n else None
        for i, n in enumerate(sizes)
    ]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    return df.sparkSession.createDataFrame([tuple(middle)], schema)


def _values_at_ranks(
    values: DataFrame, wanted: set[tuple[int, int]], sizes: Sequence[int], brackets: Sequence[list]
) -> dict[tuple[int, int], float]:
    """The values at 0-based ranks, given as (column, rank); ``brackets`` has a first guess by column.

    A guess need not hold the rank: the counts below, at and between its ends say where the
    next pass has to look.
    """
    margin = 2.0 / _SKETCH_ACCURACY
    # For each open rank: which values are left, how many are below them, how many they are.
    left = {(i, r): (F.lit(True), 0, sizes[i]) for i, r in sorted(wanted)}
    ends = [brackets[i] for i, _ in left]
    found: dict[tuple[int, int], float] = {}
    while left:
        counts = []
        for (i, _), (low, high) in zip(left, ends):
            v = F.col(f"v{i}")
            counts += [F.count_if(v < low), F.count_if(v == low), F.count_if((v > low) & (v < high)), F.count_if(v == high)]
        counted = values.agg(*counts).first()
        still = {}
        for k, ((i, rank), (held, below, inside)) in enumerate(list(left.items())):
            low, high = ends[k]
            under, at_low, between, at_high = counted[4 * k:4 * k + 4]
            upto = under + at_low + between + (at_high if high != low else 0)
            v = F.col(f"v{i}")
            if rank < under:
                still[i, rank] = (held & (v < low), below, under - below)
            elif rank < under + at_low:
                found[i, rank] = low
            elif rank < under + at_low + between:
                still[i, rank] = ((v > low) & (v < high), under + at_low, between)
            elif rank < upto:
                found[i, rank] = high
            else:
                still[i, rank] = (held & (v > high), upto, below + inside - upto)
        left = still
        if left:
            sketches = []
            for (i, rank), (held, below, inside) in left.items():
                share = (rank - below) / inside
                bracket = F.array(
                    F.lit(max(share - margin, 0.0)), F.lit(min(share + margin + 1.0 / inside, 1.0)))
                sketches.append(F.percentile_approx(F.when(held, F.col(f"v{i}")), bracket, _SKETCH_ACCURACY))
            ends = list(values.agg(*sketches).first())
    return found
