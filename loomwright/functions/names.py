"""Names of columns, tables and files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a text strip removes (Unicode white space and the four
# separator controls).
_BLANK = r"[\s\x1c-\x1f]"


def strip_blank(text: Column) -> Column:
    """Strip white space of every kind at both ends (``trim`` strips spaces only)."""
    return F.regexp_replace(text, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def normalize_column_name(name: Column) -> Column:
    """Upper case, without underscores and spaces at the ends, then without other blanks."""
    return strip_blank(F.btrim(F.upper(name), F.lit("_ ")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*\z", "")


def table_name_from_path(path: Column) -> Column:
    return F.lower(file_stem(path))


def safe_output_name(name: Column) -> Column:
    """Keep letters, digits, space, dot and underscore; spaces become underscores."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N} ._]", "")
    return F.regexp_replace(F.rtrim(kept), " ", "_")
