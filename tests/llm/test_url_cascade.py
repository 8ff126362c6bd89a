import random

from factledger.llm.url_cascade import build_cascade, filter_urls, host_and_path

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URLS = [
    "http://a.example.net/en/x",
    "http://a.example.net/fr/x?q=/en/",
    "HTTPS://A.EXAMPLE.COM/de/1",
    "http://example.com/DE/1",
    "http://net",
    "http://net/",
    "http://example.net?x=/en/",
    "http://notexample.com/de/",
    "http://sub.org/fr/#x",
    "ftp://user@host.net:80/x://y",
    "no scheme.net/",
    "",
    None,
    "://net/a",
    "http://..net/x",
    "http://example.com/de/" + "deep/" * 20_000,
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end].translate({c: c + 32 for c in range(65, 91)}), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for rule, verdict in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return (host, path, *(best or (None, "allow")))


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, keys int")


def test_rules(spark):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in filter_urls(pages(spark, URLS), rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r["verdict"] for r in filter_urls(pages(spark, URLS), none).collect()} == {"allow"}
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    assert filter_urls(pages(spark, []), rules).count() == 0


def test_membership_is_exact_over_the_universe(spark):
    rng = random.Random(1)
    keys = [f"host{i}.example/{rng.random()}" for i in range(6000)]
    universe = spark.createDataFrame([(k,) for k in keys + keys[:100]], "key string")
    listed = spark.createDataFrame([(k,) for k in keys[:900]], "key string")
    cascade = build_cascade(listed, universe, 6000)
    assert len(cascade.levels) > 2
    held = {r[0] for r in universe.filter(cascade.holds(universe["key"])).collect()}
    assert held == set(keys[:900])
    # the filters' size follows the list
    assert sum(len(f.table) for f in cascade.levels) < 900 * 2


def test_native(spark):
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    plan = filter_urls(pages(spark, URLS), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_host_and_path_of_line_breaks(spark):
    host, path = host_and_path("url")
    row = pages(spark, ["http://a\nb/c\nd?e"]).select(host, path).first()
    assert tuple(row) == ("a\nb", "/c\nd")
