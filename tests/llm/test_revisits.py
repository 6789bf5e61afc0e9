import random

import pytest
from pyspark.sql import functions as F

from loomwright.llm import revisits

SCHEMA = "record_id long, url string, time long, kind string, headers map<string,string>, digest string"


def brute(records, canonical):
    out = []
    for rid, url, time, kind, headers, digest in records:
        if kind != "revisit":
            continue
        mine = {k.lower(): v for k, v in (headers or {}).items()}
        before = [r for r in records if r[3] == "response" and None not in (url, time, r[1], r[2])
                  and canonical[r[1]] == canonical[url] and r[2] < time]
        if not before:
            out.append((rid, "no_response", None, None))
            continue
        source = max(before, key=lambda r: (r[2], r[0]))
        theirs = {k.lower(): v for k, v in (source[4] or {}).items()}
        plain = lambda t: t.removeprefix("W/") if t else t
        if "etag" in mine:
            same = plain(mine["etag"]) == plain(theirs.get("etag"))
        elif "last-modified" in mine:
            same = mine["last-modified"] == theirs.get("last-modified")
        elif digest is not None and source[5] is not None:
            same = digest == source[5]
        else:
            same = None
        if not same:
            out.append((rid, "no_validator" if same is None else "validator_mismatch", None, None))
            continue
        merged = {**theirs, **{k: v for k, v in mine.items() if k in revisits.PERMITTED}}
        out.append((rid, "resolved", source[0], tuple(sorted(merged.items()))))
    return sorted(out, key=repr)


def crawl(seed, n):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        url = draw.choice(["http://hot.com/"] * 6 + ["HTTP://Hot.com:80#a", "http://b.com/x?b=1&a=2", "http://b.com/x?a=2&b=1&utm_s=1",
                           "http://c.com/X", None, ""])
        headers = {}
        if draw.random() < 0.6:
            headers["ETag"] = draw.choice(["", "W/"]) + f'"{draw.randint(0, 2)}"'
        if draw.random() < 0.6:
            headers["Last-Modified"] = str(draw.randint(0, 2))
        headers |= {"Server": str(i), "Cache-Control": str(i)} if draw.random() < 0.8 else {}
        out.append((i, url, draw.choice([None, *range(n // 4)]), draw.choice(["response", "revisit", "request"]),
                    headers if draw.random() < 0.95 else None, draw.choice(["x", "y", None])))
    return out


@pytest.mark.parametrize("seed, n", [(1, 30), (2, 400)])
def test_matches_brute_force(spark, seed, n):
    records = crawl(seed, n)
    frame = spark.createDataFrame(records, SCHEMA)
    urls = frame.select("url").distinct().select("url", revisits.canonical_url(F.col("url"))).collect()
    canonical = {r[0]: r[1] for r in urls}
    wide = frame.withColumns({c: F.lit(1) for c in ("address", "part", "full", "far", "near", "top", "outcome")})
    got = revisits.resolve_revisits(wide).collect()
    digest = sorted(((r.record_id, r.outcome, r.response_id, None if r.headers is None else tuple(sorted(r.headers.items())))
                     for r in got), key=repr)
    assert digest == brute(records, canonical)


def test_repeated_rows_and_no_rows(spark):
    records = [(1, "http://a.b", 1, "response", {"ETag": "q"}, "d")] * 3 + [(2, "http://a.b/", 2, "revisit", {"etag": "q"}, None)] * 2
    got = revisits.resolve_revisits(spark.createDataFrame(records, SCHEMA)).collect()
    assert [(r.response_id, r.digest) for r in got] == [(1, "d"), (1, "d")]
    assert revisits.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("url, expected", [
    ("HTTP://Example.com:80/a?b=2&a=1#f", "http://example.com/a?a=1&b=2"), ("https://x.org:443", "https://x.org/"),
    ("https://x.org:8443/P?utm_source=q", "https://x.org:8443/P"), ("not a url", "not a url"), (None, None), ("", ""),
])
def test_canonical_urls(spark, url, expected):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(revisits.canonical_url(F.col("u"))).first()[0] == expected


def test_canonical_addresses(spark):
    from pyspark.sql import functions as F

    cases = {
        "http://user:pw@Host.com/a": "http://user:pw@host.com/a", "http://userpw@host.com/a": "http://userpw@host.com/a",
        "http://a@b@host.com:80": "http://a@b@host.com/", "HTTP://[::1]:80/x": "http://[::1]/x",
        "https://[2001:DB8::1]:8443/x": "https://[2001:db8::1]:8443/x", "http://h/%7Euser/%2f%c3%A9": "http://h/~user/%2F%C3%A9",
        "http://h/~user": "http://h/~user", "http://h/x/../y": "http://h/y", "http://h/a/./b/..": "http://h/a/",
        "http://h/../../a": "http://h/a", "http://h/a..b/.c": "http://h/a..b/.c", "http://h/%": "http://h/%",
        "http://h/%4": "http://h/%4", "http://h/%zz%41": "http://h/%zzA", "http://h?b=%41&a=1&utm_x=2#f": "http://h/?a=1&b=A",
        "http://h:80:90/": "http://h:80:90/", "http://[::1/x": "http://[::1/x", "no address": "no address", "": "",
        "http://": "http:///", "http://h/" + "d/../" * 2000 + "e": "http://h/e", "http://h/" + "x" * 100_000: "http://h/" + "x" * 100_000,
    }
    frame = spark.createDataFrame(list(cases.items()), "url string, expected string")
    got = frame.select("url", "expected", revisits.canonical_url(F.col("url")).alias("got"))
    assert got.where("NOT got <=> expected").collect() == []
