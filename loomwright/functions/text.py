"""Payloads and fences in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwright.functions.jsonio import with_strict_json
from loomwright.functions.names import strip_blank

# The fence forms that mark a payload.
JSON_FENCE = r"(?sU)```json\s*\n(.*?)```"
BARE_FENCE = r"(?sU)```\s*\n(.*?)```"
EDITED_JSON = r"(?s)```json\n(.*?)\n```"
EDITED_SCRIPT = r"(?s)```python\n(.*?)\n```"
SCRIPT_OPEN = "```python\n"
SCRIPT_CLOSE = "\n```"


def group_or_null(text: Column, pattern: str) -> Column:
    """First group of the first match, null without a match (``''`` stays a match)."""
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def _outer_braces(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, null when there is no such span."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = (start > 0) & (F.instr(text, "}") > 0) & (end > start)
    return F.when(found, F.substr(text, start, end - start + 1))


def with_payload(df: DataFrame, text_col: str, out: str = "payload") -> DataFrame:
    """Add the payload of each response text.

    A ``json`` fence wins over a bare fence, which wins over the outermost braces
    when these hold valid JSON; otherwise the payload is the stripped text.
    """
    text = strip_blank(F.col(text_col))
    fenced = F.coalesce(group_or_null(text, JSON_FENCE), group_or_null(text, BARE_FENCE))
    braced = F.when(fenced.isNull(), _outer_braces(text))
    found = df.withColumns({"_fenced": fenced, "_braced": braced})
    return (
        with_strict_json(found, F.col("_braced"), "_valid")
        .withColumn(
            out,
            F.coalesce(
                strip_blank(F.col("_fenced")),
                F.when(F.col("_valid"), F.col("_braced")),
                text,
            ),
        )
        .drop("_fenced", "_braced", "_valid")
    )


def unwrap_script(text: Column) -> Column:
    """Drop a script fence, but only when the text both starts and ends with it."""
    wrapped = text.startswith(SCRIPT_OPEN) & text.endswith(SCRIPT_CLOSE)
    inner_length = F.length(text) - len(SCRIPT_OPEN) - len(SCRIPT_CLOSE)
    inner = F.substr(text, F.lit(len(SCRIPT_OPEN) + 1), F.greatest(inner_length, F.lit(0)))
    return F.when(wrapped, inner).otherwise(text)


def without_fences(text: Column) -> Column:
    """Drop every fence marker, for display."""
    bare = F.replace(F.replace(text, F.lit("```python"), F.lit("")), F.lit("```"), F.lit(""))
    return strip_blank(bare)


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
