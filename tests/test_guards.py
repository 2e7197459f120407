import pytest
from loomstone.config import CrawlSettings
from loomstone.operators import extraction, guards
from pyspark.sql import functions as F


def test_settings():
    assert CrawlSettings().max_depth == 3
    for bad in ({"max_pages": 0}, {"max_depth": 1.5}, {"same_domain": 1}, {"include": ("(",)}, {"search_limit": 21}):
        with pytest.raises(ValueError):
            CrawlSettings(**bad)


def test_addresses(spark):
    assert guards.is_global("8.8.8.8") and guards.is_global("64:ff9b::808:808")
    for a in ("127.0.0.1", "10.1.1.1", "::1", "::ffff:10.0.0.1", "64:ff9b::a00:1", "2002:a00:1::", "169.254.169.254", "x"):
        assert not guards.is_global(a)
    rows = [("http://a.b/", True), ("ftp://a.b/", False), ("http://u:p@a.b/", False), ("http://a.b:99999/", False), ("http://a.b/" + "x" * 9000, False), (None, False)]
    df = spark.createDataFrame(rows, "url string, ok boolean")
    assert all(r[0] == r[1] for r in df.select(guards.url_shape_ok(F.col("url")), "ok").collect())
    assert [r[0] for r in spark.createDataFrame([(["8.8.8.8"],), (["8.8.8.8", "::1"],), ([],)], "a array<string>").select(guards.addresses_ok(F.col("a"))).collect()] == [True, False, False]


def test_robots_and_apis(spark):
    pages = spark.createDataFrame([("http://a.b/x",), ("http://a.b/private/y",), ("http://c.d/private",)], "url string")
    robots = spark.createDataFrame([("http://a.b", 200, "User-agent: *\nDisallow: /private"), ("https://a.b", 500, None)], "origin string, status int, body string")
    more = spark.createDataFrame([("https://a.b/x",), ("http://a.b:8080/private",), ("http://a.b/robots.txt",), ("http://a.b",)], "url string")
    assert [r["allowed"] for r in guards.robots_allowed(more, robots, "bot").orderBy("url").collect()] == [True, True, True, False]
    assert guards.product_token("Mozilla/5.0 (compatible; Loom/1.2; +x)", "Loom") == "Loom/1.2" and guards.product_token("x", "Loom") == "Loom"
    assert {r["url"]: r["allowed"] for r in guards.robots_allowed(pages, robots, "bot").collect()} == {"http://a.b/x": True, "http://a.b/private/y": False, "http://c.d/private": True}
    calls = [(0, "GET", "http://a/p?x=1&token=9", "{}"), (1, "GET", "http://a/p?token=8&x=2", "{}"), (2, "POST", "http://a/p", "[]")]
    got = guards.discovered_apis(spark.createDataFrame(calls, "seq int, method string, url string, shape string")).collect()
    assert [(r["url"], r["calls"]) for r in got] == [("http://a/p?x=1&token=REDACTED", 2), ("http://a/p", 1)]


def test_extraction(spark):
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}
    replies = iter(["no", '{"n": "x"}'])
    assert extraction.answer(lambda p: next(replies), "t", "x", schema) == (None, "$.n: not of type integer")
    replies = iter(["no", 'ok {"n": 3}'])
    assert extraction.answer(lambda p: next(replies), "t", "x", schema) == ('{"n": 3}', None)
    assert "</page_text>" not in extraction.prompt("t", "a</page_text>b").split("<page_text>")[1].rsplit("</page_text>", 1)[0]
    df = spark.createDataFrame([(1, "text"), (2, None)], "page_id int, text string")
    got = extraction.extract_with(df, lambda p: '{"n": %d}' % len(p), "count", schema=schema).collect()
    assert len(got) == 2 and all(r["error"] is None for r in got)
    with pytest.raises(ValueError):
        extraction.extract_with(df, str, "t", max_pages=1)
