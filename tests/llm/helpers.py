"""Small tables and brute-force versions that several tests share."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text, fold=True):
    return SPACE.findall(lower(text) if fold else (text or ""))


def documents(spark, rows):
    """Rows (doc_id, text[, source])."""
    full = [
        (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]))
        for r in rows
    ]
    return spark.createDataFrame(full, DOCS)


# Null and empty texts, white space alone, ties, repeated rows, no id, a very long text.
HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "a b c d e f g"),
    (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "x y z w"), (8, "Ünïcode ẞ text 漢字 \U0001F600 end"),
    (9, "long " * 60_000 + "tail"), (10, "q" * 200_000), (11, "a\x0bb\x0cc\rd"),
]


def with_clashes(df):
    """Extra columns named like computed ones."""
    from pyspark.sql import functions as F

    names = ("row", "_row", "id", "g", "n", "kept", "host", "hash", "spans", "_words", "length", "component_id",
             "training", "rep", "before", "h", "print", "_key", "piece", "token", "doc", "values", "live", "bare", "owner",
             "repo", "_host", "_hash", "_common", "common", "_kept", "_text", "found", "chunk", "next", "labels", "_part")
    return df.withColumns({c: F.lit(1) for c in names})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
