"""Not-modified revisits of a web archive: as-of join to the latest earlier full response.

Records are dealt by range of (address, time), so an address that has a third of all records is
spread over as many parts as it needs. Within a part the last response before each revisit comes from a
window; where an address goes on from an earlier part, the last response of the earlier parts does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwright.llm.common import register
from loomwright.queries.base import table
from loomwright.storage import stage

# Header fields that a 304 response may update (RFC 9110, section 15.4.5); fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


# Escapes of letters, digits, "-", ".", "_" and "~": the same address with and without them.
_UNRESERVED = r"^(?i:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|2[DE]|5F|7E)"


def _escapes(text: Column) -> Column:
    """Escapes of unreserved characters undone, all others in upper case."""
    def part(x: Column, i: Column) -> Column:
        rest = F.substr(x, F.lit(3))
        return (
            F.when(i == 0, x)
            .when(x.rlike(_UNRESERVED), F.concat(F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("long")), rest))
            .when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), rest))
            .otherwise(F.concat(F.lit("%"), x)))

    return F.when(text.contains("%"), F.array_join(F.transform(F.split(text, "%", -1), part), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """Segments ``.`` and ``..`` resolved (RFC 3986, section 5.2.4)."""
    segments = F.split(path, "/", -1)  # the first is empty: the path starts with a slash
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    resolved = F.aggregate(
        F.slice(segments, 2, F.size(segments)), none,
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, x)))
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(resolved, ends), "/"))).otherwise(path)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, sorted query without utm_*.

    User information stays as it is, in front of an ``@``; a host in brackets keeps its colons.
    Escapes of unreserved characters are undone and dot segments resolved. A text that is no
    address stays as it is; an empty path becomes ``/``.
    """
    # Parts by one pattern: scheme, user information, host, port, path, query.
    pattern = (r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)(:[0-9]*)?"
               r"(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$")
    part = lambda i: F.regexp_extract(url, pattern, i)
    scheme = F.lower(part(1))
    port = F.when(
        (part(4) == ":") | ((scheme == "http") & (part(4) == ":80")) | ((scheme == "https") & (part(4) == ":443")),
        "").otherwise(part(4))
    path = F.when(part(5) == "", "/").otherwise(_without_dots(_escapes(part(5))))
    query = F.array_join(F.array_sort(F.filter(
        F.split(_escapes(part(6)), "&"), lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    clean = F.concat(
        scheme, F.lit("://"), part(2), F.lower(part(3)), port, path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(pattern), clean).otherwise(url)


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then clash, the last stands."""
    entries = F.map_entries(F.coalesce(headers, F.expr("CAST(map() AS MAP<STRING, STRING>)")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(
        F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"])))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records``.

    Input: record_id, url, time (any ordered type), kind (``response`` or ``revisit``), headers
    (map), digest. Output: record_id, canonical_url, time, response_id, outcome, headers, digest.
    A revisit refers to the last response of its address with a lesser time; of responses of one
    time the greatest record_id counts. Validators decide: equal ETags (weak comparison) where the
    revisit has one, else equal Last-Modified, else equal digests. ``outcome`` is ``resolved``,
    ``no_response``, ``validator_mismatch`` or ``no_validator``; only resolved rows have
    response_id, digest and headers, which are the response's, updated by the permitted fields of
    the revisit. Null addresses and times match nothing. Repeated rows are resolved each.
    """
    own = F.struct("record_id", "headers", "digest")
    events = records.where("kind IN ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url").cast("string")).alias("address"), "time",
        (F.col("kind") == "response").alias("full"), _lower_keys(F.col("headers")).alias("headers"), "digest")
    # At equal times revisits come first, so that no response of the same time is before them.
    order = ["time", "full", "record_id"]
    dealt = stage(
        events.repartitionByRange("address", *order).withColumn("part", F.spark_partition_id()),
        "revisit-events")
    inside = Window.partitionBy("address", "part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    response = F.when(F.expr("full AND time IS NOT NULL AND address IS NOT NULL"), own)
    seen = dealt.withColumn("near", F.last(response, ignorenulls=True).over(inside))

    tails = dealt.where("address IS NOT NULL").groupBy("address", "part").agg(
        F.max(F.when(F.expr("full AND time IS NOT NULL"), F.struct("time", "record_id"))).alias("top"))
    spread_out = tails.groupBy("address").agg(F.count("*").alias("n")).where("n > 1").select("address")
    tails = stage(tails.join(spread_out, "address"), "revisit-tails")
    tops = dealt.where("full").join(
        tails.where("top IS NOT NULL").select(
            "address", "part", F.col("top.time").alias("time"), F.col("top.record_id").alias("record_id")),
        ["address", "part", "time", "record_id"], "left_semi",
    ).dropDuplicates(["address", "part"]).select("address", "part", own.alias("far"))
    earlier = Window.partitionBy("address").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("address", "part").join(tops, ["address", "part"], "left").select(
        "address", "part", F.last("far", ignorenulls=True).over(earlier).alias("far")
    ).where("far IS NOT NULL")

    found = seen.where("NOT full").join(carried, ["address", "part"], "left").withColumn(
        "source", F.when(F.expr("time IS NOT NULL AND address IS NOT NULL"), F.coalesce("near", "far")))
    plain = lambda tag: F.regexp_replace(tag, "^W/", "")
    mine = F.col("headers")
    theirs = F.col("source.headers")
    same = (
        F.when(mine["etag"].isNotNull(), F.coalesce(plain(mine["etag"]) == plain(theirs["etag"]), F.lit(False)))
        .when(mine["last-modified"].isNotNull(),
              F.coalesce(mine["last-modified"] == theirs["last-modified"], F.lit(False)))
        .when(F.col("digest").isNotNull() & F.col("source.digest").isNotNull(),
              F.col("digest") == F.col("source.digest"))
    )
    outcome = (
        F.when(F.col("source").isNull(), "no_response").when(same.isNull(), "no_validator")
        .when(same, "resolved").otherwise("validator_mismatch"))
    permitted = F.array(*(F.lit(h) for h in PERMITTED))
    update = F.map_filter(mine, lambda k, v: F.array_contains(permitted, k))
    kept = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k))
    good = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", F.col("address").alias("canonical_url"), "time",
        F.when(good, F.col("source.record_id")).alias("response_id"), "outcome",
        F.when(good, F.map_concat(kept, update)).alias("headers"),
        F.when(good, F.col("source.digest")).alias("digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl derived from ``pages``: each page once in full, and its site's front page revisited.

    The front page of a site is fetched with each of its pages, so a site with many pages has
    one address with many captures.
    """
    i = F.col("page_id")
    front = F.concat(F.regexp_extract("url", "^[^:]*://[^/?#]*", 0), F.lit("/#"), i.cast("string"))
    version = F.concat(F.lit('"v'), F.floor(i / 40).cast("string"), F.lit('"'))
    modified = F.concat(F.lit("day "), F.floor(i / 40).cast("string"))
    page = F.struct(
        (i * 2).alias("record_id"), F.col("url"), (i * 10).alias("time"), F.lit("response").alias("kind"),
        F.create_map(
            F.lit("ETag"), F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.lit("Server"), F.lit("a"),
        ).alias("headers"), F.md5("html").alias("digest"))
    site = F.struct(
        (i * 2 + 1).alias("record_id"), front.alias("url"), (i * 10 + 5).alias("time"),
        F.when(i % 7 == 0, "response").otherwise("revisit").alias("kind"),
        F.map_filter(F.create_map(
            F.lit("ETag"), F.when(i % 3 == 0, version).when((i % 3 == 1) & (i % 7 != 0), F.concat(F.lit("W/"), version)),
            F.lit("Last-Modified"), F.when((i % 3 != 1), modified),
            F.lit("Cache-Control"), F.concat(F.lit("max-age="), (i % 5).cast("string")),
            F.lit("Server"), F.concat(F.lit("s"), (i % 4).cast("string")),
        ), lambda k, v: v.isNotNull()).alias("headers"),
        F.md5(version).alias("digest"))
    return pages.select(F.explode(F.array(page, site)).alias("r")).select("r.*")


def op2(spark, sf_dir) -> DataFrame:
    resolved = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return resolved.withColumn("headers", F.array_join(F.array_sort(F.transform(
        F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "; "))


ORACLE = """
WITH sites AS (
  SELECT page_id AS i, lower(regexp_extract(url, '^[^:]*://[^/?#]*')) || '/' AS address,
         '"v' || floor(page_id / 40)::BIGINT || '"' AS version,
         'day ' || floor(page_id / 40)::BIGINT AS modified FROM pages),
records AS (
  SELECT i, address, i % 7 = 0 AS is_full,
         CASE WHEN i % 3 = 0 THEN version WHEN i % 3 = 1 AND i % 7 <> 0 THEN 'W/' || version END AS etag,
         CASE WHEN i % 3 <> 1 THEN modified END AS modified,
         'max-age=' || i % 5 AS cache, 's' || i % 4 AS server, md5(version) AS digest FROM sites),
found AS (
  SELECT r.*, s.i AS si, s.etag AS s_etag, s.modified AS s_modified, s.server AS s_server,
         s.digest AS s_digest
  FROM (SELECT * FROM records WHERE NOT is_full) r
  ASOF LEFT JOIN (SELECT * FROM records WHERE is_full) s ON r.address = s.address AND r.i > s.i),
judged AS (
  SELECT *, CASE WHEN si IS NULL THEN 'no_response'
    WHEN CASE WHEN etag IS NOT NULL THEN coalesce(ltrim(etag, 'W/') = ltrim(s_etag, 'W/'), false)
              WHEN modified IS NOT NULL THEN coalesce(modified = s_modified, false)
              ELSE digest = s_digest END THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM found)
SELECT i * 2 + 1 AS record_id, address AS canonical_url, i * 10 + 5 AS time,
       CASE WHEN outcome = 'resolved' THEN si * 2 + 1 END AS response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN concat_ws('; ', 'cache-control: ' || cache,
         'etag: ' || coalesce(etag, s_etag), 'last-modified: ' || s_modified,
         'server: ' || s_server) END AS headers,
       CASE WHEN outcome = 'resolved' THEN s_digest END AS digest
FROM judged"""

register("op2_revisits", op2, ORACLE)
