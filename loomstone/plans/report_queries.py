"""Queries over reports, leases, searches and lists of pages; their SQL derives each answer from the tables' own rows.

A conversation turn stands for a tool's output on a page: conv_id is the page, role the tool.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import guards, leases, reports, search
from loomstone.plans.registry import query
from loomstone.runtime import table


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    marks = F.length("text") - F.length(F.regexp_replace("text", "[ae]", ""))
    vowels = F.length("text") - F.length(F.regexp_replace("text", "[ou]", ""))
    n = F.greatest(F.length("text"), F.lit(1))
    return c.select("conv_id", "turn", "role", "text", (marks / n).alias("recall"), (vowels / n).alias("noise"))


TURNS = """t AS (SELECT conv_id, turn, role, text, length(regexp_replace(text, '[^ae]', '', 'g')) / greatest(length(text), 1) AS recall,
  length(regexp_replace(text, '[^ou]', '', 'g')) / greatest(length(text), 1) AS noise FROM conversations)"""


@query("report_batch", "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events")
def report_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reports.batch_summary(e.withColumn("error", F.when(F.col("event_type") == "error", F.col("props"))))


@query("report_changes", """SELECT count(*) FILTER (before IS NULL) AS new, count(*) FILTER (before <> event_type) AS changed, count(*) FILTER (before = event_type) AS unchanged
FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)""")
def report_changes(spark, sf_dir):
    """A user's last state against each event, counted."""
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("event_type"), "unchanged").otherwise("changed")
    return reports.change_counts(table(spark, sf_dir, "events").withColumn("before", before).withColumn("change", change))


@query("report_totals", """SELECT 'orders.o_totalprice' AS metric, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS value FROM orders
UNION ALL SELECT 'parts.p_size', sum(p_size)::DOUBLE FROM part UNION ALL SELECT 'parts.p_partkey', sum(p_partkey)::DOUBLE FROM part""")
def report_totals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    return reports.dashboard_totals(orders=orders, parts=table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"))


@query("report_web", """SELECT event_type AS tool, grp AS stratum, count(*) AS pages, count(*) FILTER (bucket = 'junk') AS junk, count(*) FILTER (bucket = 'failed') AS failed,
  count(*) FILTER (bucket = 'thin') AS thin, count(*) FILTER (bucket = 'content') AS content, count(*) FILTER (bucket = 'content') / count(*) AS rate,
  median(CAST(floor(value) AS BIGINT)) AS median_tokens, median(user_id) AS median_seconds
FROM (SELECT *, user_id % 3 AS grp, CASE WHEN value < 5 THEN 'junk' WHEN value < 20 THEN 'failed' WHEN value < 40 THEN 'thin' ELSE 'content' END AS bucket FROM events)
GROUP BY GROUPING SETS ((event_type, grp), (event_type))""")
def report_web(spark, sf_dir):
    """Buckets of events by type (the tool) and group of users (the stratum), with the types' subtotals."""
    v = F.col("value")
    bucket = F.when(v < 5, "junk").when(v < 20, "failed").when(v < 40, "thin").otherwise("content")
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tool"), (F.col("user_id") % 3).alias("stratum"), bucket.alias("bucket"), F.floor(v).cast("bigint").alias("tokens"), F.col("user_id").alias("seconds")
    )
    return reports.web_report(e, "stratum")


@query("report_quality", "SELECT avg(p_retailprice) AS average, count(*) FILTER (p_retailprice >= 1200) AS passed, count(*) FILTER (p_retailprice < 1200) AS failed FROM part")
def report_quality(spark, sf_dir):
    s = reports.quality_summary(table(spark, sf_dir, "part"), 1200, "p_retailprice")
    return s.select("average", "passed", "failed")


@query("report_live_quality", f"WITH {TURNS} SELECT role AS tool, count(*) AS pages, round(avg(recall), 9) AS recall, round(avg(noise), 9) AS noise, round(avg(recall * (1 - noise)), 9) AS quality FROM t GROUP BY role")
def report_live_quality(spark, sf_dir):
    q = reports.live_quality(_turns(spark, sf_dir).withColumnRenamed("role", "tool"))
    return q.select("tool", "pages", *(F.round(c, 9).alias(c) for c in ("recall", "noise", "quality")))


@query("report_quality_signs", f"""WITH {TURNS}, q AS (SELECT conv_id, turn, recall * (1 - noise) AS q FROM t)
SELECT 't' || a.turn AS first, 't' || b.turn AS second, count(*) FILTER (a.q > b.q) AS better, count(*) FILTER (a.q < b.q) AS worse
FROM q a JOIN q b ON a.conv_id = b.conv_id AND 't' || a.turn < 't' || b.turn GROUP BY ALL""")
def report_quality_signs(spark, sf_dir):
    """Turns of a conversation against each other."""
    t = _turns(spark, sf_dir).select("conv_id", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("tool"), "recall", "noise")
    return reports.quality_signs(t, "conv_id")


@query("report_smoke", """SELECT doc_id, array_to_string(list_filter([CASE WHEN source = 'web' THEN 'error ' || source END, CASE WHEN length(text) < 500 THEN 'only ' || length(text) || ' chars' END,
  CASE WHEN NOT contains(lower(text), lang) THEN 'missing ' || lang END], lambda x: x IS NOT NULL), '; ') AS reasons FROM documents""")
def report_smoke(spark, sf_dir):
    """Documents as smoke checks: those of one source carry an error, each must contain its language's name."""
    d = table(spark, sf_dir, "documents")
    error = F.when(F.col("source") == "web", F.col("source"))
    r = reports.smoke_reasons(F.col("text"), error, F.lit("ok"), F.array("lang"), F.lit(None).cast("int"))
    return d.select("doc_id", F.array_join(r, "; ").alias("reasons"))


@query("report_json", "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
def report_json(spark, sf_dir):
    return reports.as_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("report_records", """SELECT text, coalesce(source, '') AS source, coalesce(title, '') AS title FROM (SELECT text, 'd' || doc_id AS source, lang AS title FROM documents)
WHERE trim(coalesce(text, ''), ' ') <> '' AND NOT starts_with(title, 'e')""")
def report_records(spark, sf_dir):
    """Documents as records, those in English and Spanish counted as failed."""
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("title"), F.col("text").alias("markdown"), F.when(F.col("lang").startswith("e"), "failed").alias("error"))
    out, _ = reports.records(pages)
    return out.select("text", F.col("metadata")["source"].alias("source"), F.col("metadata")["title"].alias("title"))


LEASES = """r AS (SELECT event_id AS seq, 's' || (user_id % 20) AS schedule, 'h' || user_id AS holder FROM events WHERE event_type = 'click'),
l AS (SELECT 's' || (user_id % 20) AS schedule, 'h' || user_id AS holder, max(event_id) AS until FROM events WHERE event_type = 'signup' GROUP BY ALL),
now AS (SELECT max(event_id) * 0.98 AS cutoff FROM events)"""


def _lease_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    named = e.select("event_id", "event_type", F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("schedule"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("holder"))
    requests = named.filter("event_type = 'click'").select(F.col("event_id").alias("seq"), "schedule", "holder")
    held = named.filter("event_type = 'signup'").groupBy("schedule", "holder").agg(F.max("event_id").alias("until"))
    return requests, held


@query("lease_decisions", f"""WITH {LEASES}, held AS (SELECT schedule, arg_max(holder, until) AS owner FROM l, now WHERE until > cutoff GROUP BY schedule),
first AS (SELECT schedule, arg_min(holder, seq) AS owner FROM r GROUP BY schedule)
SELECT seq, r.holder = coalesce(held.owner, first.owner) AS granted FROM r JOIN first USING (schedule) LEFT JOIN held USING (schedule)""")
def lease_decisions(spark, sf_dir):
    requests, held = _lease_rows(spark, sf_dir)
    at = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] * 0.98
    return leases.lease_decisions(requests, held, at).select("seq", "granted")


@query("run_fences", """WITH j AS (SELECT user_id AS job_id, max(event_id) AS last, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id)
SELECT event_id, status IN ('view', 'click') AND event_id > last - 400 AND event_id % 2 = last % 2 AS accepted FROM events JOIN j ON user_id = job_id WHERE event_type = 'view'""")
def run_fences(spark, sf_dir):
    """Heartbeats (views) of jobs (users) that run while their last event is a view or click; the token is the parity of an event."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), "event_type")
    token = lambda c: (F.col(c) % 2).cast("string")
    jobs = e.groupBy("job_id").agg(F.max("event_id").alias("last"), F.max_by("event_type", "event_id").alias("kind")).select(
        "job_id", F.when(F.col("kind") == "view", "running").when(F.col("kind") == "click", "cancelling").otherwise("failed").alias("status"), token("last").alias("run_token"), F.col("last").alias("lease_until"))
    beats = e.filter("event_type = 'view'").select("event_id", "job_id", token("event_id").alias("run_token"))
    # The lease of a run holds 400 events before its end; each heartbeat is judged at its own time.
    fenced = leases.fenced_updates(beats, jobs, float("-inf"))
    late = fenced.join(jobs.select("job_id", "lease_until"), "job_id")
    return late.select("event_id", (F.col("accepted") & (F.col("event_id") > F.col("lease_until") - 400)).alias("accepted"))


@query("job_access", """SELECT o_orderkey, c_nationkey IS NOT NULL AND (o_orderpriority = '1-URGENT' OR CAST(c_nationkey AS VARCHAR) = CAST(o_orderkey % 25 AS VARCHAR)) AS allowed
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def job_access(spark, sf_dir):
    """Orders ask for their customer's job; customers with debts are unknown, urgent orders are asked by the admin."""
    o = table(spark, sf_dir, "orders")
    asker = F.when(F.col("o_orderpriority") == "1-URGENT", "admin").otherwise((F.col("o_orderkey") % 25).cast("string"))
    jobs = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").cast("string").alias("owner_key"))
    asked = o.select("o_orderkey", F.col("o_custkey").alias("job_id"), asker.alias("owner_key"))
    return leases.job_access(asked, jobs, admin="admin").select("o_orderkey", "allowed")


@query("page_quanta", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE i <= 5")
def page_quanta(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return leases.page_quantum(e, 5, "user_id", "event_id")


@query("link_scores", """SELECT page_id, round((CAST(list_contains(w, 'docs') AS INTEGER) + CAST(list_contains(w, 'page') AS INTEGER)) / 2.0 + 0.5 * (page_id % 10) / 10.0, 4) AS score FROM (
  SELECT page_id, regexp_split_to_array(lower(regexp_replace(url, '^https?://[^/]*', '')), '[^a-z0-9]+') AS w FROM pages)""")
def link_scores(spark, sf_dir):
    score = search.link_score(F.col("url"), "docs page", (F.col("page_id") % 10) / 10.0)
    return table(spark, sf_dir, "pages").select("page_id", score.alias("score"))


@query("search_hits", """SELECT o_custkey AS query_id, rank, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
WHERE rank <= 20 AND (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 7) = 0""")
def search_hits(spark, sf_dir):
    """A customer's orders by price as hits; those with a seventh line were not fetched."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    hits = o.select(F.col("o_custkey").alias("query_id"), rank.alias("rank"), F.col("o_orderkey").cast("string").alias("url"))
    long = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").cast("string").alias("url")).distinct()
    pages = hits.select("url").join(long, "url", "left_anti").select("url", F.lit("<p>").alias("html"), F.lit(None).cast("string").alias("error"))
    got, _ = search.search_then_scrape(hits, pages, 50)
    return got.filter("html is not null").select("query_id", F.col("place").alias("rank"), F.col("url").cast("bigint").alias("o_orderkey"))


@query("positional_documents", """SELECT a.conv_id, a.turn, b.text IS NOT NULL AS found FROM (SELECT * FROM conversations WHERE role = 'user') a
LEFT JOIN (SELECT * FROM conversations WHERE length(text) > 200) b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def positional_documents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "role", "text")
    got = search.hits_with_documents(c.filter("role = 'user'").select("query_id", "rank"), c.filter("length(text) > 200").select("query_id", "rank", "text"))
    return got.select(F.col("query_id").alias("conv_id"), F.col("rank").alias("turn"), F.col("text").isNotNull().alias("found"))


@query("scraped_lists", """WITH w AS (SELECT page_id AS seq, url, (row_number() OVER (PARTITION BY regexp_extract(lower(url), '^https?://([^/:?#]*)', 1) ORDER BY page_id) - 1) // 2 AS wave FROM pages)
SELECT seq, CASE WHEN length(html) <= 3000 THEN 'not fetched' WHEN length(html) > 3500 THEN 'too long' END AS error, CAST(wave AS INTEGER) AS wave FROM w JOIN pages ON seq = page_id""")
def scraped_lists(spark, sf_dir):
    """All pages as a list of URLs with numbers for fragments; short ones were not fetched and long ones failed."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("own"), "html")
    wanted = p.select(F.col("page_id").alias("seq"), F.col("own").alias("url"))
    got = p.filter("length(html) > 3000").select(F.col("own").alias("url"), "html", F.when(F.length("html") > 3500, "too long").alias("error"))
    return search.scrape_many(wanted, got).select("seq", "error", "wave")


@query("robots_verdicts", """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN false WHEN page_id % 5 = 0 THEN true
  ELSE NOT starts_with(path, '/docs') OR starts_with(path, '/docs/page') END AS allowed FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages)""")
def robots_verdicts(spark, sf_dir):
    """Pages, each with an origin of its own: some robots files cannot be read, some do not exist, the others allow a part of what they forbid."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("host"), F.regexp_replace("url", "^https?://[^/]*", "").alias("path"))
    own = F.concat(F.lit("https://h"), "host", F.lit(".example.com"))
    status = F.when(F.col("page_id") % 7 == 0, 503).when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    robots = p.select(own.alias("origin"), status.alias("status"), F.lit("User-agent: *\nAllow: /docs/page\nDisallow: /docs").alias("body"))
    return guards.robots_allowed(p.select("page_id", F.concat(own, "path").alias("url")), robots, "loom").select("page_id", "allowed")
