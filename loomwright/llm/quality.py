"""Quality rules: per-text counts, and lines that too many documents of one host share.

A line that stands in ``max_documents`` distinct texts of a host is frequent there; the limit does
not grow with the host. Exact copies are one text. Near copies share nearly all their lines,
which makes none of them boilerplate, so a frequent line needs as many witnesses: texts that
hold it and are, by words, at least half made of lines that are not frequent. Boilerplate goes,
and a document that is mostly boilerplate is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwright.llm.common import SPACE_CLASS, ascii_lower, let, narrow, packed, register, unpacked
from loomwright.queries.base import table
from loomwright.storage import stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCUMENTS = 20
MIN_OWN_PERCENT = 50
MIN_LEFT_PERCENT = 30

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window which the text has twice or more.

    Windows are hashed and sorted with their places; equal hashes are then neighbours. Texts
    whose windows all differ, most texts, skip the rest.
    """
    def measure(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

        def covered(h: Column) -> Column:
            rows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def of(s: Column) -> Column:
                twice = F.filter(s, lambda x, i: (
                    (i > 0) & (F.get(s, i - 1)["h"] == x["h"])
                    | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
                ))
                places = F.flatten(F.transform(
                    twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
                return F.size(F.array_distinct(places))

            return let(rows, of)

        return let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, measure)).cast("long")


def normalised_line(line: Column) -> Column:
    """A-Z in lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(ascii_lower(line), SPACE_CLASS + "+", " "))


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts per document and its distinct normalised lines as (hash, words); no text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def hashed(line: Column) -> Column:
        spaces = F.length(line) - F.length(F.translate(line, " ", ""))
        return F.struct(F.xxhash64(line).alias("hash"), (spaces + 1).alias("words"))

    return (
        docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("_text"))
        .withColumn("_words", words_of(F.col("_text")))
        .select(
            "doc_id", "host",
            F.xxhash64("_text", F.length("_text")).alias("text_hash"),
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.translate("_text", _SPACES, "")).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long")
            .alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
            .alias("n_dup_lines"),
            repeated_words(F.col("_words")).alias("n_repeat_words"),
            F.transform(lines, lambda x: let(normalised_line(x), hashed)).alias("lines"),
        )
    )


def boilerplate(
    measured: DataFrame, max_documents: int = MAX_DOCUMENTS, min_own: int = MIN_OWN_PERCENT
) -> DataFrame:
    """host, text_hash, hash, words: each boilerplate line of each distinct text.

    Counts combine on the map side by (host, line), so neither a hot host nor a hot line meets
    in one task; the joins are by (host, line) and (host, text), whose hot keys can be split.
    """
    texts = stage(
        measured.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"), F.first("n_words").alias("n_words")),
        "quality-texts")
    hashes = F.array_distinct(F.transform("lines", lambda x: x["hash"]))
    frequent = texts.select("host", F.explode(hashes).alias("hash")).groupBy("host", "hash").agg(
        F.count("*").alias("n")).where(F.col("n") >= max_documents)
    lines = texts.select("host", "text_hash", "n_words", F.explode("lines").alias("line")).select(
        "host", "text_hash", "n_words", "line.*")
    found = stage(
        _matching(lines, frequent.select("host", "hash"), "hash")
        .groupBy("host", "text_hash", "hash").agg(F.sum("words").alias("words"), F.first("n_words").alias("n_words")),
        "quality-frequent")
    witnesses = found.groupBy("host", "text_hash").agg(
        F.sum("words").alias("words"), F.first("n_words").alias("n_words")
    ).where((F.col("n_words") - F.col("words")) * 100 >= F.col("n_words") * min_own).select("host", "text_hash")
    above = _matching(found, witnesses, "text_hash").groupBy("host", "hash").agg(
        F.count("*").alias("n")).where(F.col("n") >= max_documents).select("host", "hash")
    return _matching(found, above, "hash").select("host", "text_hash", "hash", "words")


def _matching(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose host (also a null one) and ``name`` are among ``keys``."""
    keys = keys.select(F.col("host").alias("_host"), F.col(name).alias("_key"))
    return rows.join(keys, F.col("host").eqNullSafe(F.col("_host")) & (F.col(name) == F.col("_key"))).drop("_host", "_key")


def judge(
    docs: DataFrame,
    host: str = "source",
    min_words: int = MIN_WORDS,
    max_repeat: int = MAX_REPEAT_PERCENT,
    max_documents: int = MAX_DOCUMENTS,
    min_own: int = MIN_OWN_PERCENT,
    min_left: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """One row per input row: counts, ``words_left`` without boilerplate, and the verdict.

    Null or empty text: no words, so it fails the base rule. A null host is a host of its own.
    Repeated rows are judged alike. Columns other than doc_id, text and the host are not read.
    ``common`` has the hashes of the text's own boilerplate lines, null if there are none.
    """
    measured = stage(measures(docs, host), "quality-measures")
    removed = boilerplate(measured, max_documents, min_own).groupBy("host", "text_hash").agg(
        F.sum("words").alias("removed"), F.collect_list("hash").alias("common"))
    removed = removed.select(F.col("host").alias("_host"), F.col("text_hash").alias("_hash"), "removed", "common")
    joined = measured.drop("lines").join(
        removed, F.col("host").eqNullSafe(F.col("_host")) & (F.col("text_hash") == F.col("_hash")), "left")
    base_failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    return (
        joined.withColumn("words_left", F.col("n_words") - F.coalesce("removed", F.lit(0)))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (
            F.col("words_left") * 100 >= F.col("n_words") * min_left))
        .select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                "n_repeat_words", "words_left", "base_failed", "kept", "common")
    )


def clean(docs: DataFrame, host: str = "source") -> DataFrame:
    """The kept documents with boilerplate lines removed; the columns of ``docs``.

    A document keeps all its other lines as they are. The verdict of a text depends on its
    host and text alone, so the judged rows come back by these two.
    """
    names = docs.columns
    judged = judge(docs, host)
    verdicts = judged.where("kept").select(
        F.col("host").alias("_host"), F.col("text_hash").alias("_hash"), F.col("common").alias("_common"),
    ).dropDuplicates(["_host", "_hash"])
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    keyed = packed(docs).withColumns({
        "host": F.col("doc")[host].cast("string"), "hash": F.xxhash64(text, F.length(text))})
    kept = keyed.join(verdicts, F.col("host").eqNullSafe(F.col("_host")) & (F.col("hash") == F.col("_hash")))
    left = F.array_join(F.filter(F.split("doc.text", "\n"), lambda x: ~F.array_contains(
        "_common", F.xxhash64(normalised_line(x)))), "\n")
    left = F.when(F.col("_common").isNull(), F.col("doc.text")).otherwise(left)
    return kept.select(*unpacked(names, text=left, n_chars=F.length(left).cast("long")))


def op3(spark, sf_dir) -> DataFrame:
    judged = judge(narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return judged.drop("host", "text_hash", "common")


ORACLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
split AS (
  SELECT *, [w FOR w IN string_split_regex(t, '[\x20\x09-\x0D]+') IF w <> ''] AS ws,
         [l FOR l IN string_split(t, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls
  FROM docs),
windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)),
twice AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM twice GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, t, len(string_split(l, ' ')) AS words, l FROM (
    SELECT doc_id, source, t, unnest([trim(regexp_replace(translate(l,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')
      FOR l IN ls]) AS l FROM split)),
frequent AS (
  SELECT source, l FROM lines GROUP BY source, l HAVING count(DISTINCT t) >= {MAX_DOCUMENTS}),
found AS (
  SELECT source, t, l, sum(words) / count(DISTINCT doc_id) AS words
  FROM lines JOIN frequent USING (source, l) GROUP BY source, t, l),
witnesses AS (
  SELECT f.source, f.t FROM found f GROUP BY f.source, f.t
  HAVING 100 * (len([w FOR w IN string_split_regex(f.t, '[\x20\x09-\x0D]+') IF w <> '']) - sum(words))
    >= {MIN_OWN_PERCENT} * len([w FOR w IN string_split_regex(f.t, '[\x20\x09-\x0D]+') IF w <> ''])),
common AS (
  SELECT source, l FROM found JOIN witnesses USING (source, t) GROUP BY source, l HAVING count(*) >= {MAX_DOCUMENTS}),
removed AS (
  SELECT doc_id, sum(words) AS words FROM lines JOIN common USING (source, l) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         list_sum([0] || [length(w) FOR w IN ws])::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(x.words, 0))::BIGINT AS words_left
  FROM split LEFT JOIN repeats r USING (doc_id) LEFT JOIN removed x USING (doc_id))
SELECT *, NOT base_failed AND words_left * 100 >= n_words * {MIN_LEFT_PERCENT} AS kept FROM (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM base)"""

register("op3_quality", op3, ORACLE)
