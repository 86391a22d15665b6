from glyphflow.llm.url_filter import RULES, SortedDigests, candidates, judge_urls, split_url

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "https://example.org", "https://example.org/", "https://a.example.org/en/1x", "https://notexample.org/es/",
    "http://x.com/fr/", "http://com/de/a", "http://x.net/de/", "a://b?c/d", "a://b#c", "://x.org/p", "http://x.org/\n/y", "http://ÀB.org/", "http://example.org/es", "http://example.org./es/",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(r, v) for r, v in RULES if (host == r[: r.find("/")] or host.endswith("." + r[: r.find("/")])) and path.startswith(r[r.find("/") :])]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def table(spark):
    return spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[4], "h", "r")], "page_id long, url string, host string, rule string")


def test_both_ways_match_brute_force(spark):
    for size in (1 << 20, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(table(spark), index_bytes=size).collect()}
        assert got.pop(None) == brute(URLS[4])
        assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_empty_tables(spark):
    assert judge_urls(table(spark).where("false")).count() == 0
    assert {r.verdict for r in judge_urls(table(spark), rules=[]).collect()} == {"allow"}


def test_colliding_digests_are_confirmed():
    index = SortedDigests([("a/", "block"), ("b/", "allow")])
    digests = index.mapped().copy()
    digests[:] = digests[0]
    index._mapped = digests
    assert index.confirm(0, "b/") == ("b/", "allow") and index.confirm(0, "c/") is None


def test_split():
    assert split_url("x://A.B:80/p?q") == ("a.b:80", "/p")


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 200_000 + "org/x", "http://www.example.org/" + "es/" * 200_000, "http://" + "b" * 500_000 + ".com/de/", "http://example.org/es/" + "?" * 100_000]
    assert max(len(candidates(*split_url(u), [1, 4], [1, 2])) for u in urls) <= 4
    for size in (1 << 20, 0):
        got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), index_bytes=size).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u) for i, u in enumerate(urls)}
