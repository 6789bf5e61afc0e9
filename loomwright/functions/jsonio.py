"""Strict JSON tests and typed access to variants."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf


#: What ``with_normalized_json`` gives for a text whose only fault is a number that JSON lacks.
NOT_A_NUMBER = "NaN"


class _NoNumber(ValueError):
    pass


def _refuse(constant: str):
    raise _NoNumber(constant)


def _normalized(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text, parse_constant=_refuse), ensure_ascii=False)
    except _NoNumber:
        return NOT_A_NUMBER
    except (ValueError, RecursionError):
        return None


@pandas_udf(T.StringType())
def _normalized_rest(text: pd.Series) -> pd.Series:
    return text.map(_normalized, na_action="ignore")


# A number that stands behind a tested text; the text itself must not hold its digits.
_MARK = "730602581397"


def jvm_accepts(text: Column) -> Column:
    """True for one JSON value with nothing around it, by the JVM's parser alone.

    The parser stops after a value. So the text is put into a list, before a mark: the mark is the
    second element just when the text is one value and closes nothing that it has not opened.
    A text with the mark in it is left to Python.
    """
    marked = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f",{_MARK}]")))
    second = F.try_variant_get(marked, "$[1]", "variant")
    # Other spellings of the number, or a text of it, are of another type.
    one = (F.schema_of_variant(second) == "BIGINT") & (F.try_variant_get(marked, "$[1]", "bigint") == int(_MARK))
    return F.coalesce(~F.contains(text, F.lit(_MARK)) & one, F.lit(False))


def readable(text: Column) -> Column:
    """Whether the JVM can do with a text as it is; a missing one needs no parser."""
    return text.isNull() | jvm_accepts(text)


def with_normalized_json(df: DataFrame, text: Column, out: str, fine: str | None = None) -> DataFrame:
    """Add ``out``: a text the JVM can parse, or null where it is not one JSON value.

    Rows whose text the JVM's parser accepts, or that have none, stay on the JVM as they are. Only
    the others go through Python, in a branch of their own: it also takes repeated keys (the last
    one stands). ``NOT_A_NUMBER`` stands for texts with NaN or infinities. ``fine`` names a written
    column that tells the rows apart; without it both branches test every text.
    """
    row = df.select(F.struct("*").alias("row"), text.alias("text"),
                    (F.col(fine) if fine else readable(text)).alias("fine"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c.lower() != out.lower()]
    accepted = row.where("fine").select(*kept, F.col("text").alias(out))
    return accepted.unionByName(row.where("NOT fine").select(*kept, _normalized_rest("text").alias(out)))


def with_strict_json(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add ``out``: whether the whole text is one JSON value, NaN and infinities included; false for null."""
    return with_normalized_json(df, text, out).withColumn(out, F.col(out).isNotNull())


def shape(value: Column) -> Column:
    """Type text of a variant: ``STRING``, ``ARRAY<...>``, ``OBJECT<...>``, ``VOID`` for a
    JSON null; ``MISSING`` for no value at all."""
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def members(value: Column, names: Iterable[str], path: str = "$") -> Column:
    """An object's members as a struct of variants, null when there is no object."""
    return F.try_variant_get(value, path, _struct_of(names))


def list_of_members(value: Column, names: Iterable[str]) -> Column:
    """The same for an array of objects, null unless every element is one."""
    return F.try_variant_get(value, "$", f"array<{_struct_of(names)}>")


def _struct_of(names: Iterable[str]) -> str:
    return f"struct<{','.join(f'{n}:variant' for n in names)}>"


def text_of(value: Column) -> Column:
    """The text of a variant that is known to hold a string or nothing."""
    return F.try_variant_get(value, "$", "string")


def texts_of(value: Column) -> Column:
    """The texts of a variant that is known to hold an array of strings or nothing."""
    return F.try_variant_get(value, "$", "array<string>")
