"""Running a spec: extract, join, clean, build features, select, load.

The spec is a plain dict. Everything up to the load is one lazy DataFrame, so that
Catalyst prunes columns and pushes filters through all of it; only where steps need
statistics of a joined input is that input written once and read again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomwright.operators import cleaning, features
from loomwright.operators.aggregates import ROLL_UP_FUNCTIONS, roll_up
from loomwright.operators.joins import join_tables
from loomwright.sources.sinks import check_format, save, verify_written
from loomwright.sources.tables import TableSource
from loomwright.storage import stage

# Each step with statistics reads the steps before it twice, so a chain of them is cut.
STATISTICS_PER_STAGE = 3


@dataclass(frozen=True)
class RunResult:
    """The frame of a run and where it was written, if it was."""

    frame: DataFrame
    output_format: str
    location: str | None


class StepError(RuntimeError):
    """A step failed; the message names it."""


def listed(details: Mapping[str, Any], key: str = "columns") -> list | None:
    """A detail that names columns or values, as a list; one text stands for a list of it."""
    value = details.get(key)
    if value is None:
        return None
    return [value] if isinstance(value, str) else list(value)


def _columns(details: Mapping[str, Any]) -> list[str]:
    columns = listed(details)
    if not columns:
        raise ValueError("the step needs 'columns'")
    return columns


def _by_column(details: Mapping[str, Any], key: str) -> dict[str, list]:
    """A detail that maps columns to values; one value stands for a list of it."""
    mapping = details.get(key) or {}
    return {c: v if isinstance(v, (list, tuple)) else [v] for c, v in mapping.items()}


def clean_step(df: DataFrame, step_type: str, details: Mapping[str, Any]) -> DataFrame:
    kind = step_type.lower()
    if "imputation" in kind:
        return cleaning.impute(
            df, details.get("strategy", "mean"), listed(details), details.get("accuracy")
        )
    if "outlier" in kind:
        act = details.get("method", "filter")
        actions = {
            "filter": cleaning.drop_outliers,
            "cap": cleaning.cap_outliers,
            "floor": cleaning.cap_outliers,
        }
        if act not in actions:
            raise ValueError(f"unknown outlier method {act!r}; use one of {sorted(actions)}")
        return actions[act](df, _columns(details), float(details.get("threshold", 3.0)))
    if "deduplication" in kind:
        return cleaning.deduplicate(df, listed(details), listed(details, "order_by"))
    if "conversion" in kind:
        return cleaning.convert_types(df, details["types"])
    if "cleaning" in kind:
        return cleaning.clean_strings(df, listed(details))
    raise ValueError(f"unknown cleaning step {step_type!r}")


# General names that a step's details may use for a kind of step.
_METHODS = {"standard": "scaling", "minmax": "scaling", "group_by": "aggregation"}


def feature_step(
    df: DataFrame, step_type: str, details: Mapping[str, Any], frames: Mapping[str, DataFrame]
) -> DataFrame:
    kind = step_type.lower()
    if details.get("operation") == "ratio":
        top, bottom = _columns(details)
        return features.ratio(df, top, bottom, details.get("name"))
    if "expression" in details:
        return features.expression(df, details["name"], details["expression"])
    if "aggregation" in kind:
        source = frames[details["table"]] if "table" in details else df
        rolled = _roll_up(source, details)
        return join_tables(df, rolled, listed(details, "group_by"), "left", details.get("table", "agg"))
    if "encoding" in kind or "one_hot" in kind:
        for column in _columns(details):
            if details.get("sparse"):
                df = features.one_hot_sparse(df, column)
            else:
                df = features.one_hot(df, column, _by_column(details, "values").get(column))
        return df
    if "scaling" in kind:
        return features.scale(df, _columns(details), details.get("method", "standard"))
    if "polynomial" in kind:
        return features.polynomial(df, _columns(details))
    if "date" in kind:
        return features.date_parts(
            df, _columns(details), listed(details, "parts") or tuple(features.DATE_PARTS)
        )
    if kind == "feature_engineering":
        # A repaired wrapper keeps this general type; what it does stands in its details.
        named = str(details.get("operation") or details.get("method") or "").lower()
        if not named or named == kind:
            raise ValueError("a 'feature_engineering' step names its 'operation' in its details")
        return feature_step(df, _METHODS.get(named, named), details, frames)
    raise ValueError(f"unknown feature step {step_type!r}")


def _roll_up(df: DataFrame, details: Mapping[str, Any]) -> DataFrame:
    return roll_up(
        df,
        listed(details, "group_by"),
        listed(details),
        listed(details, "functions") or tuple(ROLL_UP_FUNCTIONS),
        _by_column(details, "status"),
        details.get("prefix", f"{details['table']}_" if "table" in details else ""),
    )


def _has_statistics(step: Mapping[str, Any]) -> bool:
    words = ("imputation", "outlier", "scaling", "encoding", "one_hot", "aggregation")
    kind = step["type"].lower()
    return kind == "feature_engineering" or any(w in kind for w in words)


def _named(label: str, build, *args):
    try:
        return build(*args)
    except Exception as error:
        raise StepError(f"{label}: {error}") from error


@dataclass(frozen=True)
class _Join:
    left: str
    right: str
    keys: list
    how: str
    roll_ups: list[Mapping[str, Any]]


def _split(spec: Mapping[str, Any]) -> tuple[list[str], list[_Join], list[Mapping[str, Any]]]:
    """Tables, joins with the roll-ups of their right tables, and the feature steps that are left."""
    tables, joins = list(spec.get("initial_tables") or []), []
    rest = list(spec.get("feature_engineering_steps") or [])
    for join in spec.get("join_operations") or []:
        left, right, keys = join["left_table"], join["right_table"], listed(join, "on_columns")
        tables += [t for t in (left, right) if t not in tables]

        def before(step: Mapping[str, Any]) -> bool:
            details = step.get("details") or {}
            return (
                "aggregation" in step["type"].lower()
                and details.get("table") == right
                and (listed(details, "group_by") or []) == keys
            )

        roll_ups = [step["details"] for step in rest if before(step)]
        rest = [step for step in rest if not before(step)]
        joins.append(_Join(left, right, keys, join.get("join_type") or "left", roll_ups))
    return tables, joins, rest


def _recipe(*parts: Any) -> str:
    """A digest of how a frame is made: equal recipes make equal frames of one source."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class _Shared:
    """Frames that several specs make alike, each written once.

    A frame is shared if what is made of it differs; otherwise it is a part of what its
    users share, and not written itself.
    """

    def __init__(self, specs: Mapping[str, Mapping[str, Any]]):
        users: dict[str, set] = {}
        for name, spec in specs.items():
            tables, joins, rest = _split(spec)
            made = {t: _recipe(t) for t in tables}
            for join in joins:
                child = made[join.right]
                for details in join.roll_ups:
                    rolled = _recipe("roll-up", child, details)
                    users.setdefault(child, set()).add(rolled)
                    child = rolled
                joined = _recipe("join", made[join.left], child, join.keys, join.how, join.right)
                for part in (made[join.left], child):
                    users.setdefault(part, set()).add(joined)
                made[join.left] = joined
            read = [*tables[:1], *((s.get("details") or {}).get("table") for s in rest)]
            for table in read:
                users.setdefault(made.get(table, ""), set()).add(("spec", name))
        self._shared = {recipe for recipe, names in users.items() if len(names) > 1}
        self._frames: dict[str, DataFrame] = {}

    def make(self, recipe: str, build) -> DataFrame:
        if recipe not in self._shared:
            return build()
        if recipe not in self._frames:
            self._frames[recipe] = stage(build(), "shared")
        return self._frames[recipe]

    def written(self, recipe: str) -> bool:
        return recipe in self._frames


def run_spec(spec: Mapping[str, Any], source: TableSource) -> DataFrame:
    """The result of a spec as a DataFrame; nothing is written.

    Tables live under their names and each join replaces its left table, so a chain
    of joins grows the first table. An aggregation step that names the right table of
    a join and groups by that join's keys is applied before the join: child rows are
    rolled up to the parent's key and never fan it out.
    """
    return _run(spec, source, _Shared({}))


def run_specs(specs: Mapping[str, Mapping[str, Any]], source: TableSource) -> dict[str, DataFrame]:
    """The result of each spec, as ``run_spec`` gives it; what several specs roll up or join
    alike is computed once, written, and read by all of them.

    Alike are steps that name the same tables and details; specs that say the same in other
    words do not share.
    """
    shared = _Shared(specs)
    return {name: _named(name, _run, spec, source, shared) for name, spec in specs.items()}


def _run(spec: Mapping[str, Any], source: TableSource, shared: _Shared) -> DataFrame:
    check_format(spec.get("output_format") or "dataframe")
    tables, joins, rest = _split(spec)
    clean = list(spec.get("data_cleaning_steps") or [])
    if not tables:
        raise StepError("extract: the spec names no tables")
    frames = {t: _named(f"extract {t}", source.table, t) for t in tables}
    made = {t: _recipe(t) for t in tables}

    for number, join in enumerate(joins, 1):
        child, recipe = frames[join.right], made[join.right]
        for details in join.roll_ups:
            recipe = _recipe("roll-up", recipe, details)
            build = partial(_named, f"roll-up of {join.right}", _roll_up, child, details)
            child = shared.make(recipe, build)
        made[join.left] = _recipe("join", made[join.left], recipe, join.keys, join.how, join.right)
        frames[join.left] = shared.make(made[join.left], partial(
            _named, f"join {number}",
            join_tables, frames[join.left], child, join.keys, join.how, join.right,
        ))

    df = frames[tables[0]]
    if joins and any(map(_has_statistics, clean + rest)) and not shared.written(made[tables[0]]):
        df = stage(df, "joined")
    chained = 0
    for number, step in enumerate(clean + rest):
        if _has_statistics(step):
            if chained == STATISTICS_PER_STAGE:
                df, chained = stage(df, "steps"), 0
            chained += 1
        details = step.get("details") or {}
        if number < len(clean):
            df = _named(f"cleaning {step['type']}", clean_step, df, step["type"], details)
        else:
            df = _named(f"feature {step['type']}", feature_step, df, step["type"], details, frames)
    scoring = spec.get("scoring_model")
    if scoring:
        df = _named(
            "selection",
            features.select_features, df, scoring.get("features"), scoring.get("target_column"),
        )
    return df


def run_and_save(spark: SparkSession, spec: Mapping[str, Any], source: TableSource) -> RunResult:
    """Run a spec, write its result where it says, and check that it is there."""
    fmt = check_format(spec.get("output_format") or "dataframe")
    df = run_spec(spec, source)
    location = _named("load", save, df, spec.get("output_location"), fmt)
    if location is not None:
        _named("check of the output", verify_written, spark, location, fmt)
    return RunResult(df, fmt, location)
