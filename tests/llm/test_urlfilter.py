import random
import re

from lumigrid.llm import urlfilter as U

URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/x?y#z", "http://a.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "ftp://www.site.com/fr/a",
    "http://www.site.com/de/", "http://site.com/DE/", "http://org/", "http://x.org", "http://x.org?a=/b", "http://x.net/ads/1", "http://ads-track.x.net/", "http://x.net/loads/1",
    "http://x.net/p?a=1&session=9", "http://u:p@www.x.com:80/fr/", "http://casino.x.com/fr/", "a://b://c.org/d", "http://x.net/track/a/click/", "HTTP://X.COM/fr/", "http://é.org/ü", "http://x.net/" + "a/" * 20000,
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    found = sorted(p for p in U.PATTERNS if url is not None and re.search(U.pattern_rule(p).regex, url.lower()))
    _, rule, verdict = max(fits, default=(0, None, "block" if found else "allow"))
    return host, path, rule, verdict, found[0] if found else None


def test_against_all_rules(spark):
    rnd = random.Random(1)
    more = ["http://" + rnd.choice(["", "www.", "ads."]) + rnd.choice(["example.org", "b.com", "c.net"]) + rnd.choice(["/", "/es/", "/en/1", "/de/", "/fr/q"]) + rnd.choice(["", "x", "?a#b", "banner/"]) for _ in range(200)]
    rows = [(i, u) for i, u in enumerate(URLS + more)] + [(3, URLS[3]), (None, URLS[4])]
    out = U.judge_urls(spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(((i, *brute(u)) for i, u in rows), key=key)


def test_rules_without_tokens_and_empty(spark):
    rows = spark.createDataFrame([(1, "http://a.b/xyzzy1"), (2, "http://a.b/")], "page_id long, url string")
    out = {r.page_id: r.pattern for r in U.judge_urls(rows, patterns=("xyzzy*",)).collect()}
    assert out == {1: "xyzzy*", 2: None}
    assert U.judge_urls(rows.limit(0)).count() == 0


def test_key_is_the_rarest_token():
    assert U.site_rule("allow", "org", "/").tokens == ("org",)
    assert set(U.site_rule("block", "example.org", "/en/1").tokens) == {"example", "org", "en"}
    assert U.pattern_rule("^track*^click^").tokens == ("click",)
