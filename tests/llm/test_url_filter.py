import random
import re
import time

from siftwell.llm import url_filter
from siftwell.llm.common import importable


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    lower = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    return (lower(m.group(1)), m.group(2)) if m else ("", "")


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def pages(spark, urls):
    importable(spark)
    return spark.createDataFrame([(i, u, 1, 2, 3) for i, u in urls], "page_id long, url string, key int, rule int, host int")


def test_against_brute_force(spark):
    draw = random.Random(7)
    label = lambda: draw.choice(["a", "b", "com", "org", "example"])
    path = lambda: "".join(draw.choice(["/a", "/b", "/", "x", "/en/1", "é"]) for _ in range(draw.randint(0, 4)))
    host = lambda: ".".join(label() for _ in range(draw.randint(1, 4)))
    rules = list({(host(), "/" + path()): None for _ in range(60)})
    rules = [(draw.choice(["allow", "block"]), h, p) for h, p in rules] + [("allow", "example.org", "/"), ("block", "example.org", "/")]
    urls = [f"{draw.choice(['http', 'HTTPS'])}://{host().replace('a', draw.choice('aA'))}{path()}{draw.choice(['', '?q=://x/y', '#f', '/?a#b'])}" for _ in range(1500)]
    urls += ["", "nothing", "://", ":///p", "x://h", "x://h?y", None, "http://a..b/", "http://.com/", "http://com./", "\nhttp://a.com/b\n"] + [urls[0]] * 50
    rows = list(enumerate(urls)) + [(None, urls[3]), (5, urls[5])]
    for given in (rules, spark.createDataFrame(rules, "verdict string, host string, path string")):
        found = url_filter.judge(pages(spark, rows).repartition(4), given, default="allow").collect()
        want = sorted(((i, *brute(u, rules)) for i, u in rows), key=str)
        assert sorted(map(tuple, found), key=str) == want


def test_one_very_common_url(spark):
    rows = [(i, "http://www.example.org/en/1") for i in range(4000)] + [(9000, "http://other.com/")]
    found = url_filter.judge(pages(spark, rows), [("block", "org", "/en"), ("allow", "example.org", "/en/1")])
    assert {(r.rule, r.verdict) for r in found.where("page_id < 9000").collect()} == {("example.org/en/1", "allow")}
    assert found.count() == 4001


def test_nothing(spark):
    assert url_filter.judge(pages(spark, []), [("block", "org", "/")]).collect() == []
    found = url_filter.judge(pages(spark, [(1, "http://a.org/x")]), [], default="block").collect()
    assert [tuple(r) for r in found] == [(1, "a.org", "/x", None, "block")]


def test_rules_without_path_end_at_a_label(spark):
    importable(spark)
    pages = spark.createDataFrame([(1, "http://organic/x"), (2, "http://a.org"), (3, "http://org?q"), (4, "http://borg/")], "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, [("block", "org", "")]).collect()}
    assert found == {1: (None, "allow"), 2: ("org", "block"), 3: ("org", "block"), 4: (None, "allow")}


def test_very_long_urls(spark):
    importable(spark)
    host = "a." * 50_000 + "example.org"
    pages = spark.createDataFrame([(1, f"http://{host}/es/{'p' * 100_000}"), (2, "http://x.org/" + "q" * 500_000)], "page_id long, url string")
    started = time.time()
    found = {r.page_id: (r.rule, r.verdict, len(r.host), len(r.path)) for r in url_filter.judge(pages, [("allow", "org", "/"), ("block", "example.org", "/es/")]).collect()}
    assert found == {1: ("example.org/es/", "block", len(host), 100_004), 2: ("org/", "allow", 5, 500_001)}
    assert time.time() - started < 60
