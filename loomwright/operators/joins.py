"""Equi-joins on same-named columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loomwright.operators.cleaning import require_columns
from loomwright.storage import stage, unused_name

JOIN_TYPES = ("inner", "left", "right", "outer")


def join_tables(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", right_name: str = "right"
) -> DataFrame:
    """Join on same-named keys; other columns of the right side that collide get
    the suffix ``_<right_name>``.

    Adaptive execution splits a hot key of the left side for inner and left joins,
    but not for right and full outer joins. For these the right rows are marked once by whether
    the left side has their key, and written, so that a derived right side is computed once;
    what is joined then splits, and the rows without the mark are added. Of the left side
    only the keys are read a second time.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}; use one of {JOIN_TYPES}")
    on = list(on)
    if not on:
        raise ValueError("a join needs at least one key column")
    keys = [require_columns(frame, on, f"join, {side} table") for side, frame in
            (("left", left), ("right", right))]
    on = keys[0]
    right = right.withColumnsRenamed(dict(zip(keys[1], on)))
    right = right.withColumnsRenamed(_renamed(left.columns, right.columns, on, right_name))
    if how in ("inner", "left"):
        return left.join(right, on, how)
    mark = unused_name(left, right)
    left_keys = left.select(*on).distinct().withColumn(mark, F.lit(True))
    marked = stage(right.join(left_keys, on, "left"), "join-right")
    matched = left.join(marked.drop(mark), on, "inner" if how == "right" else "left")
    unmatched = marked.where(F.col(mark).isNull()).drop(mark)
    return matched.unionByName(unmatched, allowMissingColumns=True).select(*matched.columns)


def _renamed(
    left: Sequence[str], right: Sequence[str], on: Sequence[str], right_name: str
) -> dict[str, str]:
    """New names of the right columns that collide; a table joined again is suffixed again.

    Spark resolves names without regard to case, so they collide likewise.
    """
    taken = {c.lower() for c in left}
    used = taken | {c.lower() for c in right}
    names = {}
    for column in right:
        if column in on or column.lower() not in taken:
            continue
        name = f"{column}_{right_name}"
        while name.lower() in used:
            name += f"_{right_name}"
        used.add(name.lower())
        names[column] = name
    return names


def described_but_absent(described: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Set difference of two name columns."""
    return described.select(column).subtract(found.select(column))
