import pytest
from loomstone.functions import errors, jsons, urls
from loomstone.operators import extraction, leases, reports, search
from loomstone.operators import warehouse as w
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items())).select(column).first()[0]


def test_dashboard_and_sinks(spark, tmp_path):
    totals = reports.dashboard_totals(a=spark.createDataFrame([(1, 2.5, "x"), (None, 1.0, "y")], "n int, m double, s string"))
    assert {r["metric"]: r["value"] for r in totals.collect()} == {"a.n": 1.0, "a.m": 3.5}
    assert "<th>&lt;b&gt;</th>" in reports.dashboard_page(spark.createDataFrame([("<b>", 1.0)], "metric string, value double"), "T&T")
    failures = spark.createDataFrame([("http://a", 'say "no"')], "url string, message string")
    assert not reports.write_failures(failures.limit(0), f"{tmp_path}/none") and reports.write_failures(failures, f"{tmp_path}/f")
    assert spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/f").first()["message"] == 'say "no"'
    for _ in range(2):
        reports.append_events(failures, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_records(spark):
    schema = "url string, title string, markdown string, error string, chunks array<struct<text:string,heading:string,cite_url:string>>"
    pages = spark.createDataFrame([("u", None, "m", None, [("a", "h", "u#a"), ("b", "", "u#b")]), ("v", "t", " ", None, []), ("w", "t", "m", "timeout", [])], schema)
    out, left = reports.records(pages)
    assert [(r["text"], r["metadata"]) for r in out.collect()] == [("m", {"source": "u", "url": "u"})]
    assert sorted((r["url"], r["reason"]) for r in left.collect()) == [("v", "empty page"), ("w", "timeout")]
    assert [(r["text"], r["metadata"]["source"]) for r in reports.records(pages, True)[0].collect()] == [("a", "u#a"), ("b", "u#b")]


def test_smoke_reasons(spark):
    rows = [("x" * 500 + " Straße", None, "ok", ["STRASSE"]), ("x" * 600 + "Words", None, "ok", ["wORDS"]), ("x", "timeout", "ok", None), ("x", "blocked", "challenge", None), ("x", None, "challenge", None)]
    df = spark.createDataFrame(rows, "md string, e string, expect string, must array<string>")
    got = [r[0] for r in df.select(reports.smoke_reasons(F.col("md"), F.col("e"), F.col("expect"), F.col("must"), F.lit(None).cast("int"))).collect()]
    assert got == [["missing STRASSE"], [], ["error timeout", "only 1 chars"], [], ["expected a challenge, got content"]]


def test_leases_and_jobs(spark):
    asked = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, "t", "b"), (4, "t", "a"), (5, "t", "b")], "seq int, schedule string, holder string")
    held = spark.createDataFrame([("s", "b", 9.0), ("t", "a", 1.0)], "schedule string, holder string, until double")
    got = {r["seq"]: r["granted"] for r in leases.lease_decisions(asked, held, 5.0).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True}
    assert leases.lease_releases(spark.createDataFrame([("s", "a")], "schedule string, holder string"), held, 5.0).count() == 1
    assert leases.lease_releases(spark.createDataFrame([("s", "b")], "schedule string, holder string"), held, 5.0).count() == 0
    requests = spark.createDataFrame([(1, "k", "x"), (2, "k", "x"), (3, "k", "y"), (4, None, "x"), (5, None, "x"), (6, "o", "x")], "seq int, idempotency_key string, request_json string")
    jobs = spark.createDataFrame([("c", "w", "o", "z")], "type string, owner_key string, idempotency_key string, request_json string")
    out = w.new_jobs(requests.withColumns({"type": F.lit("c"), "owner_key": F.lit("w")}), jobs)
    assert [r["outcome"] for r in out.orderBy("seq").collect()] == ["created", "reused", "mismatch", "created", "created", "mismatch"]
    access = leases.job_access(spark.createDataFrame([(1, "w"), (1, "v"), (2, "w")], "job_id int, owner_key string"), spark.createDataFrame([(1, "w")], "job_id int, owner_key string"))
    assert [r["allowed"] for r in access.orderBy("job_id", F.desc("owner_key")).collect()] == [True, False, False]


def test_search(spark):
    assert [search.hit_limit(n) for n in (-3, 1, 20, 99)] == [1, 1, 20, 20]
    hits = spark.createDataFrame([("q", i, f"http://h{i % 2}/{i}") for i in range(30)], "query_id string, rank int, url string")
    pages = spark.createDataFrame([("http://h0/0", "<p>", None)], "url string, html string, error string")
    got, left = search.search_then_scrape(hits, pages, 3, F.col("url").startswith("http://h0/"))
    assert [(r["place"], r["url"], r["html"]) for r in got.orderBy("place").collect()] == [(1, "http://h0/0", "<p>"), (2, "http://h0/2", None), (3, "http://h0/4", None)]
    assert left.count() == 15
    scored = search.chunks_with_scores(spark.createDataFrame([(1, 0), (1, 1)], "page_id int, id int"), spark.createDataFrame([(1, 1, 0.5)], "page_id int, id int, score double"))
    assert [r["score"] for r in scored.orderBy("id").collect()] == [0.0, 0.5]


def test_small_columns(spark):
    assert one(spark, errors.next_step(F.col("e")), e="timeout").startswith("The site was too slow") and one(spark, errors.next_step(F.col("e")), e="x") is None
    inside = urls.inside_folder(F.col("p"), "/data/in")
    assert [one(spark, inside, p=p) for p in ("/data/in", "/data/in/x/../y", "/data/in/../out", "/data/inx", "in/x", "/../data/./in/z", None)] == [True, True, False, False, False, True, False]
    assert [one(spark, urls.domain_candidate(F.col("d"), ["cdn"]), d=d) for d in ("a.com", "mycdn.net", "nsfw.org")] == [True, False, False]
    assert jsons.violation(True, {"enum": [1]}) and jsons.violation(1, {"enum": [1]}) is None


def test_schema_generation(spark):
    html = "<div class=item><b>One</b></div>"
    good = '{"baseSelector": ".item", "fields": [{"name": "t", "selector": "b", "type": "text"}]}'
    asked = []
    replies = iter(["no", '{"fields": [{"name": "t", "selector": "i", "type": "text"}]}', good])

    def model(p):
        asked.append(p)
        return next(replies)

    assert extraction.generate_schema(html, model, "titles", css=True)["baseSelector"] == ".item"
    assert "it finds nothing on the sample" in asked[2]
    with pytest.raises(ValueError):
        extraction.generate_schema(html, lambda p: good, "titles")
    pages = spark.createDataFrame([(1, "text"), (2, "bad")], "page_id int, text string")

    def summarise(p):
        if "bad" in p:
            raise RuntimeError("down")
        return "short"

    assert [(r["summary"], r["summary_error"]) for r in extraction.summaries(pages, summarise).orderBy("page_id").collect()] == [("short", None), (None, "down")]
