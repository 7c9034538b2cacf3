from placerank.llm import url_filter as u
from helpers import clashing

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("Org", "", "block")]
RULE_DDL = "host string, path string, verdict string"


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].translate({i: i + 32 for i in range(65, 91)}), rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h.lower() + p, v) for h, p, v in rules
            if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme/en/", "http://", "http://www.EXAMPLE.com/en/x?y#z", "https://a.example.com/en/1", "https://example.com/de/1",
        "http://notexample.com/en/", "http://x.net/es/9#t", "http://x.net/es", "http://net/es/", "http://com", "http://a.com?x=/en/",
        "http://q.org", "http://q.org/any", "x://y://z.com/", "http://" + "a." * 5000 + "com/" + "p" * 20000, "http://x.net/fr/9"]


def test_equals_brute_force(spark):
    pages = clashing(spark.createDataFrame([(i % 7, x) for i, x in enumerate(URLS * 2)], "page_id long, url string"), "rule", "key", "block", "n", "best")
    for blocks in (1, 2, 1 << 12):
        got = u.filter_urls(pages, spark.createDataFrame(RULES + RULES[:1] + [(None, "/", "block"), ("com", None, "block")], RULE_DDL), blocks=blocks)
        rows = got.select("url", "host", "path", "rule", "verdict").collect()
        assert len(rows) == len(URLS) * 2
        for r in rows:
            assert tuple(r)[1:] == brute(r.url, RULES), r.url
        assert set(pages.columns) - {"rule"} <= set(got.columns)


def test_no_false_negatives(spark):
    rules = spark.range(3000).selectExpr("concat('h', id, '.com') as host", "concat('/', id) as path", "'block' as verdict")
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://www.h', id, '.com/', id, '/x') as url")
    assert u.filter_urls(pages, rules, blocks=64).where("verdict = 'block'").count() == 3000


def test_empty(spark):
    pages, rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], RULE_DDL)
    assert u.filter_urls(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in u.filter_urls(one, rules).collect()] == ["allow"]
