import re

from spreadlab.llm import urls as U

RULES = [
    U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("block", "example.org", "/en/1"), U.Rule("allow", "com", "/fr/"),
    U.Rule("block", "com", "/de/"), U.Rule("block", "a.example.org", ""), U.Rule("allow", "a.example.org", "/x/y/"), U.Rule("block", "", "/q"),
    U.Rule("allow", "com", "/de/"),
]
URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "http://example.org/es/1", "http://example.org/es", "https://m.EXAMPLE.org/en/12?x=/es/",
    "http://badexample.org/es/", "http://x.com/fr/#a", "http://x.com/de/", "http://com/de/", "http://a.example.org", "http://b.a.example.org/x/y/z",
    "http://a.example.org/x/yz", "http://É.org/", "http://org./", "http://u@h:80/q/r", "http:///q", "x://y://z/q", "http://org?x/", "http://" + "a." * 300 + "org/" + "p/" * 300,
]


def brute(url, rules=RULES):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host.split(".")), len(r.path), r.verdict), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def made(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], "", ""), (None, URLS[6], "", "")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie_and_join_match_brute_force(spark):
    pages = made(spark)
    want = sorted(((r.page_id, *brute(r.url)) for r in pages.collect()), key=str)
    assert rows(U.judge(pages, RULES)) == want
    assert rows(U.judge(pages, RULES, trie_rules=2)) == want
    table = spark.createDataFrame([*RULES, ("block", None, "/")], "verdict string, host string, path string")
    assert rows(U.judge(pages, table)) == want
    assert rows(U.judge(pages, table, trie_rules=2)) == want


def test_default_and_empty(spark):
    pages = made(spark)
    assert {r.verdict for r in U.judge(pages, [], default="block").collect()} == {"block"}
    assert U.judge(pages.limit(0), RULES).count() == 0
