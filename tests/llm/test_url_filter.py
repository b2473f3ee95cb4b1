from veilframe.llm.url_filter import judge_urls, make_rules

RULES = [("net", "/", "block"), ("example.net", "/en", "allow"), ("a.example.net", "/en/x/", "block"), ("org", "", "block"), ("b.org", "", "allow")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [r for r in RULES if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///x", "http://net", "http://NET/", "http://x.Example.Net/en/1?q=/#f", "http://a.example.net/en/x/y",
    "http://a.example.net/english", "http://xexample.net/en/", "http://q.b.org?x", "http://b.org", "http://É.org/", "http://.org", "http://a..net/",
    "x://y://net/", "http://net/\nline", "http://" + "a." * 500 + "net/" + "p/" * 500, "http://net:80/", "http://u@net/",
]


def test_same_as_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, make_rules(spark, RULES)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS * 2)}


def test_clashing_columns_repeats_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "h", "r", 1)] * 2, "page_id long, url string, host string, row string, _rule int")
    out = judge_urls(pages, make_rules(spark, RULES))
    assert [(r.host, r.row, r.rule) for r in out.collect()] == [("a.net", "r", "net/")] * 2
    none = judge_urls(pages.drop("_rule"), make_rules(spark, []), default="block").collect()
    assert [(r.rule, r.verdict) for r in none] == [(None, "block")] * 2
    assert judge_urls(pages.limit(0), make_rules(spark, RULES)).count() == 0
    nulls = make_rules(spark, [(None, "/", "block"), ("net", None, "block"), ("net", "/", None)])
    assert {r.verdict for r in judge_urls(pages, nulls).collect()} == {"allow"}
