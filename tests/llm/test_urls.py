import re

from loomwright.llm import urls
from tests.llm.helpers import lower, with_clashes

URLS = [
    None, "", "no scheme", "http://", "http://example.com", "http://Example.COM/en/1?x#y", "https://www.example.com/en/2",
    "https://a.www.example.com/en/2", "http://notexample.com/en/1", "http://x.net/es/1", "http://x.net/es", "http://net/fr/#a",
    "http://x.net:80/es/1", "ftp://a.b/://c", "http://free-bets.org/a", "http://my-free-bets.org/a", "http://x.org/print/a.html",
    "http://x.org/print/a.html?x", "http://x.org/?SESSIONID=4", "http://x.org/a?b&sessionid=1", "http://é.com/ü?", "http://x.com?a/en/",
    "http://" + "a" * 50_000 + ".com/", "http://x.net/es/1", "http://x.net/es/1",
]


def split(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host):])[0], rest[len(host):]


def base(url):
    host, path, _ = split(url)
    best = None
    for verdict, rule in urls.BASE_RULES:
        at = rule.index("/")
        suffix, prefix = rule[:at], rule[at:]
        if (host == suffix or host.endswith("." + suffix)) and path.startswith(prefix):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return best


def test_verdicts_match_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = [*urls.base_rules(), *urls.PATTERN_RULES, urls.Rule("anything", "*bet*", "block"), urls.Rule("tie-a", "||a.b/", "block", 0)]
    got = {r.page_id: r for r in urls.judge(with_clashes(pages), rules).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, after = split(url)
        assert (got[i].host, got[i].path) == (host, path)
        fitting = [(r.rank, len(r.text), r.text, r.verdict) for r in rules
                   if re.search(urls.compiled(r.pattern), host + after)]
        best = max(fitting, default=None)
        assert (got[i].rule, got[i].verdict) == ((best[2], best[3]) if best else (None, "allow")), url
        by_hand = base(url)
        assert (got[i].rule, got[i].verdict) == by_hand[1:] if by_hand else got[i].rule_rank in (None, 0), url
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_tokens_are_whole():
    assert urls.literal_tokens("||casino-win.") == ["casino", "win"]
    assert urls.literal_tokens("*bet*") == [] and urls.literal_tokens("bet^") == []
    assert urls.literal_tokens("|bet|") == ["bet"] and urls.literal_tokens("/a*b/c/") == ["c"]
    assert urls.literal_tokens("||example.com/en") == ["example", "com"]
