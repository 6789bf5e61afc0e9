"""Secret scans: fixed patterns, then ownership frequency over the whole corpus.

A value that many owners or many repositories share is a copied example or a placeholder; one
that few of both have looks live, however often it stands there. Values are compared by hash, counted
by distinct repositories and owners, and the verdict goes back to each place of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwright.llm.common import let, narrow, packed, register, unpacked
from loomwright.queries.base import table
from loomwright.storage import stage

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Added by this operator: keys behind a vendor prefix, and long values of mixed characters.
VENDOR = r"(?:ghp_|gho_|xoxb-|xoxp-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}"
MIXED = r"[A-Za-z0-9+/_-]{32,}"

KINDS = ("assign", "access", "hex", "vendor", "mixed")
BASE_KINDS = 3
MAX_OWNERS = 2
MAX_REPOS = 4
RANDOM_LENGTH = 12
_BOTH = "(?:" + "|".join((ASSIGN, ACCESS, HEX, VENDOR, MIXED)) + ")"


def _spans(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Places of the leftmost matches: lengths of matches and of the gaps between them.

    Spark gives matches without places; the parts between matches have the missing lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    gaps = F.split(text, pattern, -1)

    def places(pair: Column) -> Column:
        step = F.zip_with(pair["m"], F.slice(pair["g"], 1, F.size(pair["m"])), lambda m, g: F.struct(
            F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("long")))
        zero = F.struct(
            F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("starts")
        )
        starts = F.aggregate(
            step, zero,
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["long"]).alias("at"),
                F.array_append(acc["starts"], acc["at"] + x["gap"]).alias("starts"),
            ),
            lambda acc: acc["starts"],
        )
        rows = F.arrays_zip(starts.alias("s"), pair["m"].alias("m"), pair["v"].alias("v"))
        return F.transform(rows, lambda x: F.struct(
            x["s"].alias("start"), F.lit(kind).alias("kind"),
            (x["s"] + F.length(x["m"])).alias("end"), x["v"].alias("value")))

    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, kind: INT, end: BIGINT, value: STRING>>)")
    found = F.struct(matches.alias("m"), values.alias("v"), gaps.alias("g"))
    return F.when(text.rlike(pattern), let(found, places)).otherwise(empty)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start and then kind; code points, end exclusive."""
    assign = F.filter(_spans(text, 0, ASSIGN, 1), lambda x: F.length(x["value"]) >= 6)
    mixed = F.filter(  # long words and paths are no keys: a key has digits and both cases
        _spans(text, 4, MIXED, 0),
        lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"),
    )
    kinds = F.concat(
        assign, _spans(text, 1, ACCESS, 0), _spans(text, 2, HEX, 0), _spans(text, 3, VENDOR, 0), mixed
    )
    return F.array_sort(kinds)


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories per value hash, of rows (hash, owner, repo).

    Each step combines on the map side, so a value that stands everywhere costs each task
    one row per owner. Null owners and repositories count as one of their own.
    """
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("uses"))
    by_owner = by_repo.groupBy("hash", "owner").agg(
        F.count("*").alias("repos"), F.sum("uses").alias("uses")
    )
    return by_owner.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("uses").alias("uses")
    )


def _repository(docs: DataFrame, owner: str, row: str = "") -> Column:
    """Owner and language, the closest to a repository that documents have; without a language the owner."""
    names = [row + c for c in (owner, "lang") if c in docs.columns]
    return F.concat_ws("/", *(F.col(c).cast("string") for c in names))


def scan(
    docs: DataFrame, owner: str = "source", repo: Column | None = None, max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """One row per input row: doc_id, its ``spans`` and counts.

    ``spans`` is an array of (start, kind, end, n_owners, n_repos, live): base kinds always;
    added kinds only where the value looks live, that is, where at most ``max_owners`` owners and
    ``max_repos`` repositories have it, and no base span covers it. Null or empty text: no spans.
    Repeated rows are scanned each. ``repo`` defaults to the pair of owner and language.
    """
    repo = repo if repo is not None else _repository(docs, owner)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wide = docs.select(
        "doc_id", F.col(owner).cast("string").alias("owner"), repo.alias("repo"),
        F.when(text.rlike(_BOTH), candidates(text)).alias("found"),
    )
    wide = stage(
        wide.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo",
            F.transform("found", lambda x: F.struct(
                x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"),
                F.xxhash64(x["value"]).alias("hash"))).alias("found"),
        ),
        "secret-candidates",
    )
    places = wide.select("row", "owner", "repo", F.explode("found").alias("x")).select(
        "row", "owner", "repo", "x.*"
    )
    known = ownership(places.select("hash", "owner", "repo"))
    judged = (
        places.join(known, "hash")
        .withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(
            F.struct("start", "kind", "end", "n_owners", "n_repos", "live"))).alias("spans"))
    )
    base = F.filter("spans", lambda x: x["kind"] < BASE_KINDS)
    keep = F.filter("spans", lambda x: (x["kind"] < BASE_KINDS) | (
        x["live"] & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, kind: INT, end: BIGINT, "
                   "n_owners: BIGINT, n_repos: BIGINT, live: BOOLEAN>>)")
    return (
        wide.select("row", "doc_id").join(judged, "row", "left")
        .withColumn("spans", F.coalesce("spans", empty))
        .withColumn("base", base).withColumn("spans", keep).select("row", "doc_id", "spans")
    )


def looks_random(value: Column) -> Column:
    """Long, with digits and letters: a value that does not stand in a text by chance."""
    return (F.length(value) >= RANDOM_LENGTH) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """The text with the values of the spans replaced at their places.

    Between them, those that look random are replaced as well, as whole tokens; an
    everyday word behind ``token:`` stays wherever else it stands.
    """
    # A value stands at the end of its match. Longer values first: one that holds another must
    # not lose a part to it.
    places = F.array_sort(F.transform(spans, lambda x: F.struct(
        (x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"))))
    values = F.sort_array(F.array_distinct(F.transform(
        F.filter(spans, lambda x: looks_random(x["value"])),
        lambda x: F.struct(F.length(x["value"]).alias("long"), x["value"].alias("value")))), asc=False)
    any_value = F.when(F.size(values) > 0, F.concat(
        F.lit("(?<![A-Za-z0-9+/_-])(?:"),
        F.array_join(F.transform(values, lambda x: F.concat(F.lit(r"\Q"), x["value"], F.lit(r"\E"))), "|"),
        F.lit(")(?![A-Za-z0-9+/_-])")))

    def between(pattern: Column, first: Column, end: Column) -> Column:
        part = F.substring(text, (first + 1).cast("int"), (end - first).cast("int"))
        return F.when(pattern.isNull(), part).otherwise(F.array_join(F.split(part, pattern, -1), mark))

    def rebuilt(x: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            return F.struct(
                F.greatest(acc["at"], p["end"]).alias("at"),
                F.when(p["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                    acc["out"], between(x["pattern"], acc["at"], p["start"]), F.lit(mark))).alias("out"))

        return F.aggregate(x["places"], zero, step, lambda acc: F.concat(
            acc["out"], between(x["pattern"], acc["at"], F.length(text).cast("long"))))

    return let(F.struct(places.alias("places"), any_value.alias("pattern")), rebuilt)


def redact(
    docs: DataFrame, mark: str = "[secret]", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """The documents with every live-looking value replaced by ``mark``.

    All spans that ``scan`` calls live are replaced at their places, whatever their kind (of
    ``assign`` the value, not the key name); overlapping ones become one mark. Other places
    of the same values in a text are replaced where they are whole tokens that look random.
    Widely copied examples stay. Texts without any match pass through, unread by the rest and
    unshuffled. Without a column ``lang`` the owner stands for the repository.
    """
    names = docs.columns
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    rows = packed(docs).withColumn("hit", text.rlike(_BOTH))
    without = rows.where("NOT hit")
    # The few texts with a match are written: they are listed, counted and changed.
    staged = stage(
        rows.where("hit").select(
            F.monotonically_increasing_id().alias("row"), "doc", candidates(text).alias("found")),
        "secret-texts").withColumn(
            "values", F.array_distinct(F.transform("found", lambda x: x["value"])))
    places = staged.select(
        F.col("doc.source").cast("string").alias("owner"),
        _repository(docs, "source", "doc.").alias("repo"), F.explode("values").alias("value"))
    copied = ownership(places.select(F.xxhash64("value").alias("hash"), "owner", "repo")).where(
        (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)).select("hash")
    live = (
        staged.select("row", F.explode("values").alias("value"))
        .withColumn("hash", F.xxhash64("value")).join(copied, "hash", "left_anti")
        .groupBy("row").agg(F.collect_list("value").alias("live"))
    )
    cleaned = staged.join(live, "row", "left")
    base = F.filter("found", lambda x: x["kind"] < BASE_KINDS)
    spans = F.filter("found", lambda x: F.array_contains("live", x["value"]) & (
        (x["kind"] < KINDS.index("mixed"))
        | ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    cleaned = cleaned.withColumn("spans", F.when(F.size("live") > 0, spans))
    bare = F.when(F.size("spans") > 0, _marked(F.col("doc.text"), F.col("spans"), mark)).otherwise(
        F.col("doc.text"))
    changed = cleaned.withColumn("bare", bare).select(*unpacked(
        names, text=F.col("bare"), n_chars=F.length("bare").cast("long")))
    return changed.unionByName(without.select(*unpacked(names)))


def op10(spark, sf_dir) -> DataFrame:
    spans = scan(narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source"))
    kind = F.array(*(F.lit(k) for k in KINDS))

    def joined(rows: Column) -> Column:
        parts = F.transform(rows, lambda x: F.concat_ws(
            ":", F.get(kind, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
        return F.array_join(parts, ",")

    def count(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(number: int):
        return lambda x: x["kind"] == number

    return spans.select(
        "doc_id",
        *(count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] < BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_copied"),
    )


def _oracle() -> str:
    def spans(kind: int, pattern: str, group: int, test: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
        SELECT d.doc_id, d.source, d.lang, {kind} AS kind, x.v AS value,
               x.s AS start, x.s + length(x.m) AS "end"
        FROM (SELECT *, regexp_extract_all(t, '{quoted}', 0) AS ms,
                     regexp_extract_all(t, '{quoted}', {group}) AS vs,
                     string_split_regex(t, '{quoted}') AS gs
              FROM docs WHERE regexp_matches(t, '{quoted}')) d,
             LATERAL (SELECT unnest([{{'m': ms[i], 'v': vs[i],
               's': list_sum([length(g)::BIGINT FOR g IN gs[1:i]])
                    + coalesce(list_sum([length(m)::BIGINT FOR m IN ms[1:i - 1]]), 0)}}
               FOR i IN range(1, len(ms) + 1)]) AS x)
        WHERE {test}"""

    def listing(test: str) -> str:
        return (f"coalesce(string_agg(k || ':' || start || ':' || \"end\", ',' ORDER BY start, kind) "
                f"FILTER (WHERE {test}), '')")

    parts = " UNION ALL ".join((
        spans(0, ASSIGN, 1, "length(x.v) >= 6"), spans(1, ACCESS, 0, "true"), spans(2, HEX, 0, "true"),
        spans(3, VENDOR, 0, "true"),
        spans(4, MIXED, 0, "regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[a-z]') "
                           "AND regexp_matches(x.v, '[A-Z]')"),
    ))
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = {k})::BIGINT AS n_{KINDS[k]}" for k in range(BASE_KINDS))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
    WITH docs AS (SELECT *, coalesce(text, '') AS t FROM documents),
    found AS MATERIALIZED ({parts}),
    owners AS (SELECT value, count(DISTINCT coalesce(source, '-')) AS n,
                      count(DISTINCT [coalesce(source, '-'), concat_ws('/', source, lang)]) AS repos
               FROM found GROUP BY value),
    judged AS (
      SELECT f.*, {names}[kind + 1] AS k, o.n <= {MAX_OWNERS} AND o.repos <= {MAX_REPOS} AS live,
             EXISTS (SELECT 1 FROM found b WHERE b.doc_id = f.doc_id AND b.kind < {BASE_KINDS}
                     AND b.start < f."end" AND f.start < b."end") AS covered
      FROM found f JOIN owners o USING (value)),
    kept AS (SELECT * FROM judged WHERE kind < {BASE_KINDS} OR (live AND NOT covered)),
    per AS (SELECT doc_id, {counts}, {listing(f"kind < {BASE_KINDS}")} AS base,
                   {listing("true")} AS spans, count(*) FILTER (WHERE live) AS n_live,
                   count(*) FILTER (WHERE NOT live) AS n_copied
            FROM kept GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
           coalesce(n_copied, 0) AS n_copied
    FROM documents d LEFT JOIN per USING (doc_id)"""


register("op10_secrets", op10, _oracle())
