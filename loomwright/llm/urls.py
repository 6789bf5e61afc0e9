"""URL filters: pattern rules behind an index of their rarest literal token.

A pattern is literal text in which ``*`` stands for any run, ``^`` for a character that is no
letter, digit, ``-``, ``_``, ``.`` or ``%`` (or the end), ``||`` at the start for the start of
a host label, ``|`` for the start or end of the address. Each rule is filed under the token of
its text that is rarest among the addresses. The tokens of an address fetch the rules, and only
those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomwright.llm.common import ascii_lower, narrow, register
from loomwright.queries.base import table
from loomwright.storage import stage


@dataclass(frozen=True)
class Rule:
    """``text`` names the rule; of the rules that fit, the highest (rank, length, text) decides."""

    text: str
    pattern: str
    verdict: str
    rank: int = 0


# Fixed rules of the task: verdict, host and path prefix. They outrank the pattern rules.
BASE_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
# Pattern rules of this operator, for addresses that no base rule fits.
PATTERN_RULES = (
    Rule("casino", "||casino-win.", "block"),
    Rule("bets", "||free-bets.", "block"),
    Rule("pills", "||cheap-pills.", "block"),
    Rule("ads", "||ads-track.", "block"),
    Rule("spam", "||spam-farm.", "block"),
    Rule("adult", "||adult-x.", "block"),
    Rule("print", "/print/*.html|", "block"),
    Rule("session", "^sessionid=", "block"),
)


def base_rules() -> list[Rule]:
    return [Rule(text, "||" + text, verdict, 1) for verdict, text in BASE_RULES]


def compiled(pattern: str) -> str:
    """The regular expression of a pattern, over host and rest of the address in one text."""
    head = tail = ""
    if pattern.startswith("||"):
        head, pattern = r"^(?:[^/?#]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        head, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        tail, pattern = "$", pattern[:-1]
    marks = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
    return "(?s)" + head + "".join(marks.get(c) or re.escape(c) for c in pattern) + tail


def literal_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that every fitting address has as whole tokens."""
    anchored_head = pattern.startswith("|")
    text = pattern.strip("|")
    found = []
    for m in re.finditer("[A-Za-z0-9]+", text):
        left = text[m.start() - 1] if m.start() else ("|" if anchored_head else "*")
        right = text[m.end()] if m.end() < len(text) else ("|" if pattern.endswith("|") else "*")
        if left != "*" and right != "*" and left.isascii() and right.isascii():
            found.append(m.group().lower())
    return found


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host with A-Z in lower case, path, and all that follows the host; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.regexp_replace(rest, "^[^/?#]*", "")
    return ascii_lower(host), F.regexp_extract(after, "^[^?#]*", 0), after


def literal_rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of a rule table as literals of the plan; no row passes through Python workers."""
    kind = f"ARRAY<STRUCT<{', '.join(': '.join(c.split()) for c in schema.split(', '))}>>"
    names = [c.split()[0] for c in schema.split(", ")]
    values = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows))
    return spark.range(1).select(F.inline(values.cast(kind)))


def tokens_of(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(address), F.lit("([a-z0-9]+)"), F.lit(1)))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """One row per input row: its other columns, host, path, deciding rule and verdict.

    An input column with the name of an added one gives way to it.

    Null, empty or malformed addresses have an empty host and path, which no anchored rule fits;
    without a fitting rule the verdict is allow and the rule null. Repeated rows are judged
    each. Equal ranks: the longer rule text decides, then the greater text.
    """
    spark = pages.sparkSession
    added = ("host", "path", "rule", "verdict", "rule_rank")
    kept = [c for c in pages.columns if c.lower() not in (url.lower(), *added)]
    host, path, after = split_url(F.col("_url"))
    parts = stage(
        pages.select(
            F.monotonically_increasing_id().alias("_row"), F.struct(*(kept or [F.lit(0)])).alias("_kept"),
            F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"),
        ).select("_row", "_kept", host.alias("_host"), path.alias("_path"),
                 F.concat(host, after).alias("_address")),
        "urls",
    )
    tokens = parts.select("_row", "_address", F.explode(tokens_of(F.col("_address"))).alias("_token"))
    options = [(i, t) for i, r in enumerate(rules) for t in literal_tokens(r.pattern)]
    schema = "_rule int, _token string"
    listed = literal_rows(spark, options, schema)
    # How many addresses have each token that some rule could be filed under.
    counts = tokens.join(listed.select("_token").distinct(), "_token").groupBy("_token").count()
    ranked = listed.join(counts, "_token", "left").groupBy("_rule").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)), F.col("_token"))).alias("best"))
    filed = ranked.select("_rule", F.col("best._token").alias("_token"))
    bodies = literal_rows(
        spark, [(i, compiled(r.pattern), r.text, r.verdict, r.rank) for i, r in enumerate(rules)],
        "_rule int, _regex string, _text string, _verdict string, _rank int",
    )
    by_token = tokens.join(filed.join(bodies, "_rule"), "_token")
    # Rules without a token of their own are tried on every address; few rules are like that.
    filed_ids = {i for i, _ in options}
    fits = by_token.where("rlike(_address, _regex)").select("_row", "_rank", "_text", "_verdict")
    for i, r in enumerate(rules):
        if i not in filed_ids:
            fits = fits.unionByName(parts.where(F.col("_address").rlike(compiled(r.pattern))).select(
                "_row", F.lit(r.rank).alias("_rank"), F.lit(r.text).alias("_text"),
                F.lit(r.verdict).alias("_verdict")))
    best = fits.groupBy("_row").agg(F.max(F.struct(
        "_rank", F.length("_text").alias("long"), "_text", "_verdict")).alias("best"))
    return parts.join(best, "_row", "left").select(
        *(F.col("_kept")[c].alias(c) for c in kept), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("best._text").alias("rule"),
        F.coalesce("best._verdict", F.lit("allow")).alias("verdict"),
        F.col("best._rank").alias("rule_rank"),
    )


def op6(spark, sf_dir) -> DataFrame:
    judged = judge(
        narrow(table(spark, sf_dir, "pages"), "page_id", "url"), [*base_rules(), *PATTERN_RULES])
    base = F.col("rule_rank") == 1
    return judged.select(
        "page_id", "host", "path", F.when(base, F.col("rule")).alias("rule"), "verdict",
        F.when(~base, F.col("rule")).alias("pattern_rule"))


def _oracle() -> str:
    rules = [*base_rules(), *PATTERN_RULES]
    rows = ", ".join(
        "('{}', '{}', '{}', {})".format(r.text, compiled(r.pattern).replace("'", "''"), r.verdict, r.rank)
        for r in rules)
    return f"""
    WITH rules(text, regex, verdict, rank) AS (VALUES {rows}),
    split AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_replace(rest, '^[^/?#]*', '') AS after FROM split),
    best AS (
      SELECT page_id, max(struct_pack(rank := rank, long := length(text), text := text, verdict := verdict)) AS b
      FROM parts, rules WHERE regexp_matches(host || after, regex) GROUP BY page_id)
    SELECT page_id, host, regexp_extract(after, '^[^?#]*') AS path,
           CASE WHEN b.rank = 1 THEN b.text END AS rule, coalesce(b.verdict, 'allow') AS verdict,
           CASE WHEN b.rank = 0 THEN b.text END AS pattern_rule
    FROM parts LEFT JOIN best USING (page_id)"""


register("op6_url_filter", op6, _oracle())
