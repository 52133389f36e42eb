from sparvane.llm import urlfilter
from sparvane.llm.queries import URL_RULES


def brute_force(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


URLS = [None, "", "example.com/en/7", "http://", "HTTP://M.Example.COM/en/71?x=/en/", "https://example.com/en/6#a", "http://notexample.com/en/7", "http://example.net/de/8/9", "http://example.net/de/7", "x://org/es/", "http://org.org/es", "http://a.org?/es/", "http://example.com:80/en/7", "a://b://com/en/", "http://com//en/", "http://sub.com/en/7", "http://ÄB.com/en/"]


def test_trie_and_join_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], "y"), (4, URLS[4], None)], "page_id long, url string, verdict string")
    rows = [(r.page_id, *brute_force(r.url, URL_RULES)) for r in pages.collect()]
    wanted = sorted(rows, key=str)
    assert sorted(map(tuple, urlfilter.judge(pages, URL_RULES).collect()), key=str) == wanted
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    assert sorted(map(tuple, urlfilter.judge(pages, rules).collect()), key=str) == wanted
    assert sorted(map(tuple, urlfilter._judge_by_join(pages.select("page_id", "url"), rules, "allow").collect()), key=str) == wanted
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0
