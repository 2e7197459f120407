"""Operational queries; the events table stands for jobs, failures, usage and cache.

A user is a job, user_id modulo 5 its owner; error events are failures; views are
cache entries; every event is also a usage record.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import errors
from loomstone.operators import warehouse as w
from loomstone.plans.registry import query
from loomstone.runtime import table

NOW = 1_705_000_000.0
TYPES = ["timeout", "blocked", "network_error", "not_found", "rate_limited"]
_T = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
CTE = f"""e AS (SELECT event_id, user_id AS job_id, event_type, epoch(ts) AS stamp, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
jobs AS (SELECT job_id, CAST(job_id % 5 AS VARCHAR) AS owner_key, ['queued', 'running', 'completed', 'cancelling', 'failed'][(max(event_id) % 5) + 1] AS status, max(stamp) AS available_at FROM e GROUP BY job_id),
failures AS (SELECT event_id, job_id, 'https://h' || (event_id % 40) || '.example.com' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/p' || event_id END AS url, {_T}[(k % 5) + 1] AS error_type,
  k % 2 = 0 AS retryable, ['open', 'retried', 'resolved'][(event_id % 3) + 1] AS status, stamp AS failed_at FROM e WHERE event_type = 'error'),
usage AS (SELECT event_id, 'key' || (job_id % 7) AS api_key, event_type AS endpoint, CAST(floor(value) AS BIGINT) AS units, stamp FROM e),
cache AS (SELECT event_id, 'c' || k AS cache_key, 'https://h' || (k % 9) || '.example.com/x' AS url, stamp AS created_at, stamp + 1000 * value AS expires_at FROM e WHERE event_type = 'view')"""


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("job_id"), "event_type",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _choice(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _jobs(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy("job_id").agg(F.max("event_id").alias("m"), F.max("at").alias("available_at"))
    return g.select("job_id", (F.col("job_id") % 5).cast("string").alias("owner_key"), _choice(["queued", "running", "completed", "cancelling", "failed"], F.col("m") % 5).alias("status"), "available_at")


def _failures(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_type = 'error'")
    tail = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("/p"), F.col("event_id").cast("string")))
    url = F.concat(F.lit("https://h"), (F.col("event_id") % 40).cast("string"), F.lit(".example.com"), tail)
    return e.select("event_id", "job_id", url.alias("url"), _choice(TYPES, F.col("k") % 5).alias("error_type"), (F.col("k") % 2 == 0).alias("retryable"),
                    _choice(["open", "retried", "resolved"], F.col("event_id") % 3).alias("status"), F.col("at").alias("failed_at"))


def _usage(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.concat(F.lit("key"), (F.col("job_id") % 7).cast("string")).alias("api_key"), F.col("event_type").alias("endpoint"), F.floor("value").cast("bigint").alias("units"), "at")


def _cache(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_type = 'view'")
    return e.select("event_id", F.concat(F.lit("c"), F.col("k").cast("string")).alias("cache_key"), F.concat(F.lit("https://h"), (F.col("k") % 9).cast("string"), F.lit(".example.com/x")).alias("url"),
                    F.col("at").alias("created_at"), (F.col("at") + 1000 * F.col("value")).alias("expires_at"))


@query("event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_counts(spark, sf_dir):
    return w.counts_by(table(spark, sf_dir, "events"), "event_type")


@query("ops_job_counts", f"WITH {CTE} SELECT status, count(*) AS n FROM jobs GROUP BY status")
def ops_job_counts(spark, sf_dir):
    return w.counts_by(_jobs(spark, sf_dir), "status")


@query("ops_public_status", f"WITH {CTE} SELECT CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN status ELSE 'scraping' END AS status, count(*) AS n FROM jobs GROUP BY 1")
def ops_public_status(spark, sf_dir):
    return _jobs(spark, sf_dir).groupBy(w.public_status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query("ops_queue_metrics", f"WITH {CTE} SELECT count(*) FILTER (status = 'queued' AND available_at <= {NOW}) AS ready, count(*) FILTER (status = 'queued' AND available_at > {NOW}) AS delayed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'cancelling') AS cancelling FROM jobs")
def ops_queue_metrics(spark, sf_dir):
    return w.queue_metrics(_jobs(spark, sf_dir), NOW)


@query("ops_event_counts_owner", f"WITH {CTE} SELECT event_type, count(*) AS n FROM e JOIN jobs USING (job_id) WHERE owner_key = '2' GROUP BY event_type")
def ops_event_counts_owner(spark, sf_dir):
    return w.event_counts(_events(spark, sf_dir), _jobs(spark, sf_dir), "2")


@query("ops_failure_metrics", f"""WITH {CTE} SELECT 'status' AS kind, status AS name, count(*) AS n FROM failures GROUP BY status UNION ALL
SELECT 'open_type', error_type, count(*) FROM failures WHERE status = 'open' GROUP BY error_type UNION ALL
SELECT 'open_retryable', '', count(*) FROM failures WHERE status = 'open' AND retryable""")
def ops_failure_metrics(spark, sf_dir):
    return w.failure_metrics(_failures(spark, sf_dir))


@query("ops_list_failures", f"WITH {CTE} SELECT event_id, url, error_type FROM failures WHERE status = 'open' AND retryable AND job_id IN (SELECT job_id FROM jobs WHERE owner_key = '1') ORDER BY failed_at DESC, url LIMIT 20 OFFSET 5")
def ops_list_failures(spark, sf_dir):
    return w.list_failures(_failures(spark, sf_dir), _jobs(spark, sf_dir), "1", retryable=True, offset=5, limit=20).select("event_id", "url", "error_type")


@query("ops_failures_of_domain", f"WITH {CTE} SELECT event_id FROM failures WHERE url LIKE '%://h9.example.com/%' OR url LIKE '%://h9.example.com:%' OR url LIKE '%://h9.example.com' ORDER BY failed_at DESC, url LIMIT 100")
def ops_failures_of_domain(spark, sf_dir):
    return w.list_failures(_failures(spark, sf_dir), status=None, domain="H9.example.com ").select("event_id")


@query("ops_usage", f"WITH {CTE} SELECT endpoint, CAST(coalesce(sum(units), 0) AS BIGINT) AS units FROM usage GROUP BY endpoint")
def ops_usage(spark, sf_dir):
    return w.usage_by_endpoint(_usage(spark, sf_dir))


@query("ops_usage_key", f"WITH {CTE} SELECT endpoint, CAST(sum(units) AS BIGINT) AS units FROM usage WHERE api_key = 'key3' GROUP BY endpoint")
def ops_usage_key(spark, sf_dir):
    return w.usage_by_endpoint(_usage(spark, sf_dir), "key3")


@query("ops_billed_pages", f"WITH {CTE} SELECT job_id, (SELECT count(*) FROM e WHERE e.job_id = jobs.job_id AND event_type = 'purchase') AS billed_pages FROM jobs")
def ops_billed_pages(spark, sf_dir):
    return w.billed_pages(_jobs(spark, sf_dir), _events(spark, sf_dir).filter("event_type = 'purchase'"))


@query("ops_billing_units", f"WITH {CTE} SELECT job_id, greatest(1, count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'purchase')) AS units FROM e GROUP BY job_id")
def ops_billing_units(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy("job_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    return g.select("job_id", w.billing_units(F.col("v"), F.col("p")).alias("units"))


@query("ops_cache_domains", f"WITH {CTE} SELECT regexp_extract(url, '://([^/]*)', 1) AS domain, count(*) AS n FROM cache GROUP BY 1")
def ops_cache_domains(spark, sf_dir):
    return w.cache_domains(_cache(spark, sf_dir))


@query("ops_cache_valid", f"WITH {CTE} SELECT cache_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC) AS r FROM cache) WHERE r = 1 AND expires_at > 1706590000")
def ops_cache_valid(spark, sf_dir):
    return w.cache_valid(_cache(spark, sf_dir), 1_706_590_000.0).select("cache_key", "event_id")


@query("ops_cache_cleared", f"WITH {CTE} SELECT count(*) AS n FROM cache WHERE url NOT LIKE '%://h3.example.com/%'")
def ops_cache_cleared(spark, sf_dir):
    return w.cache_clear(_cache(spark, sf_dir), domain="h3.example.com").agg(F.count("*").alias("n"))


@query("ops_upsert_positions", f"WITH {CTE} SELECT cache_key, min(event_id) AS position, arg_max(url, event_id) AS url FROM cache GROUP BY cache_key")
def ops_upsert_positions(spark, sf_dir):
    return w.upsert_positions(_cache(spark, sf_dir), ["cache_key"], "event_id", "url")


@query("ops_rate_windows", f"WITH {CTE} SELECT event_id, CAST(sum(units) OVER (PARTITION BY api_key ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM (SELECT *, CAST(floor(stamp) AS BIGINT) AS s FROM usage)")
def ops_rate_windows(spark, sf_dir):
    u = _usage(spark, sf_dir).withColumn("s", F.floor("at").cast("bigint"))
    return w.rate_windows(u, "api_key", "s", "units", 3600).select("event_id", "in_window")


@query("ops_spaced_slots", f"""WITH {CTE}, q AS (SELECT event_id, job_id, CAST(floor(stamp) AS BIGINT) AS s, row_number() OVER (PARTITION BY job_id ORDER BY stamp, event_id) - 1 AS i FROM e)
SELECT event_id, CAST(max(s - 600 * i) OVER (PARTITION BY job_id ORDER BY i) + 600 * i AS BIGINT) AS slot FROM q""")
def ops_spaced_slots(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("s", F.floor("at").cast("bigint"))
    return w.spaced_slots(e, "job_id", "s", ["at", "event_id"], 600).select("event_id", F.col("slot").cast("bigint").alias("slot"))


@query("ops_error_streaks", f"""WITH {CTE}, n AS (SELECT job_id, event_id, event_type IN ('error', 'click') AS bad, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS a FROM e),
g AS (SELECT *, a - row_number() OVER (PARTITION BY job_id, bad ORDER BY event_id) AS g FROM n) SELECT job_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g WHERE bad GROUP BY job_id, g HAVING count(*) >= 3""")
def ops_error_streaks(spark, sf_dir):
    return w.streaks(_events(spark, sf_dir), "job_id", "event_id", F.col("event_type").isin("error", "click")).filter("length >= 3")


@query("ops_latest_event", f"WITH {CTE} SELECT job_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY stamp DESC, event_id DESC) AS r FROM e) WHERE r = 1")
def ops_latest_event(spark, sf_dir):
    return w.latest(_events(spark, sf_dir), ["job_id"], ["at", "event_id"]).select("job_id", "event_id", "event_type")


@query("ops_event_page", f"WITH {CTE} SELECT event_id, event_type FROM e WHERE job_id = 7 ORDER BY stamp DESC, event_id LIMIT 10 OFFSET 10")
def ops_event_page(spark, sf_dir):
    return w.page_of(_events(spark, sf_dir).filter("job_id = 7"), [F.col("at").desc(), F.col("event_id")], 10, 10).select("event_id", "event_type")


@query("ops_event_envelope", f"WITH {CTE} SELECT 10 AS offset, 25 AS limit, greatest(0, least(25, count(*) - 10)) AS returned, count(*) AS total, count(*) > 10 + greatest(0, least(25, count(*) - 10)) AS has_more FROM e WHERE job_id = 7".replace("AS offset", 'AS "offset"').replace("AS limit", 'AS "limit"'))
def ops_event_envelope(spark, sf_dir):
    return w.envelope(_events(spark, sf_dir).filter("job_id = 7"), 10, 25)


@query("ops_daily_usage", f"WITH {CTE} SELECT api_key, CAST(floor(stamp / 86400) AS BIGINT) AS day, CAST(sum(units) AS BIGINT) AS units, count(*) AS n FROM usage GROUP BY ALL")
def ops_daily_usage(spark, sf_dir):
    return _usage(spark, sf_dir).groupBy("api_key", F.floor(F.col("at") / 86400).cast("bigint").alias("day")).agg(F.sum("units").alias("units"), F.count("*").alias("n"))


@query("ops_idempotent_jobs", f"""WITH {CTE}, r AS (SELECT event_id, 't' || (k % 3) AS type, CAST(job_id % 5 AS VARCHAR) AS owner_key, 'i' || k AS idempotency_key, 'v' || (event_id % 2) AS request_json FROM e WHERE event_type = 'signup'),
j AS (SELECT 't' || (k % 3) AS type, CAST(job_id % 5 AS VARCHAR) AS owner_key, 'i' || k AS idempotency_key, 'v' || min(event_id % 2) AS request_json FROM e WHERE event_type = 'purchase' GROUP BY ALL)
SELECT event_id, CASE WHEN j.request_json IS NULL AND event_id = min(event_id) OVER k THEN 'created'
  WHEN coalesce(j.request_json, first_value(r.request_json) OVER (k ORDER BY event_id)) = r.request_json THEN 'reused' ELSE 'mismatch' END AS outcome FROM r LEFT JOIN j USING (type, owner_key, idempotency_key)
WINDOW k AS (PARTITION BY type, owner_key, idempotency_key)""")
def ops_idempotent_jobs(spark, sf_dir):
    e = _events(spark, sf_dir).select(
        "event_id", "event_type", F.concat(F.lit("t"), (F.col("k") % 3).cast("string")).alias("type"), (F.col("job_id") % 5).cast("string").alias("owner_key"),
        F.concat(F.lit("i"), F.col("k").cast("string")).alias("idempotency_key"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("request_json"))
    jobs = e.filter("event_type = 'purchase'").groupBy("type", "owner_key", "idempotency_key").agg(F.min("request_json").alias("request_json"))
    return w.new_jobs(e.filter("event_type = 'signup'").withColumn("seq", F.col("event_id")), jobs).select("event_id", "outcome")


@query("ops_job_states", None)
def ops_job_states(spark, sf_dir):
    """Job states after folding the events as transitions."""
    names = {"signup": "queue", "view": "claim", "purchase": "finish", "error": "fail", "click": "requeue"}
    action = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type"))
    return w.job_states(_events(spark, sf_dir).select("job_id", F.col("event_id").alias("seq"), action.alias("action")))


@query("ops_failure_classes", f"""WITH {CTE}, m AS (SELECT event_id, ['HTTP Error 403: Forbidden', 'connection reset', 'Read timed out', 'SSL certificate expired', 'Tunnel connection failed: 403', 'Page not found', 'odd', ''][(event_id % 8) + 1] AS message FROM e WHERE event_type = 'error')
SELECT CASE WHEN message = '' THEN 'none' WHEN message LIKE 'Tunnel%' THEN 'network_error' WHEN message LIKE '%403%' THEN 'blocked' WHEN message LIKE '%not found' THEN 'not_found' WHEN message LIKE '%timed out' THEN 'timeout'
 WHEN message LIKE 'SSL%' THEN 'tls_error' WHEN message LIKE 'connection%' THEN 'network_error' ELSE 'fetch_error' END AS error_type, count(*) AS n FROM m GROUP BY 1""")
def ops_failure_classes(spark, sf_dir):
    texts = ["HTTP Error 403: Forbidden", "connection reset", "Read timed out", "SSL certificate expired", "Tunnel connection failed: 403", "Page not found", "odd", ""]
    m = _events(spark, sf_dir).filter("event_type = 'error'").select(_choice(texts, F.col("event_id") % 8).alias("message"))
    return m.groupBy(F.coalesce(errors.classify(F.col("message")), F.lit("none")).alias("error_type")).agg(F.count("*").alias("n"))


@query("ops_retry_plan", f"WITH {CTE} SELECT event_id, least(0.5 * pow(2.0, k % 6), 8.0) AS delay FROM (SELECT * FROM e WHERE event_type = 'error' AND k % 6 < 4)")
def ops_retry_plan(spark, sf_dir):
    """Failures that may be tried again, and after how long."""
    e = _events(spark, sf_dir).filter("event_type = 'error'").withColumn("attempt", F.col("k") % 6).filter("attempt < 4")
    return e.select("event_id", errors.crawl_delay(0.5, F.col("attempt"), 8.0).alias("delay"))


@query("ops_event_shares", f"WITH {CTE} SELECT event_type, count(*) AS n, avg(value) AS mean_value, median(value) AS median_value FROM e GROUP BY event_type")
def ops_event_shares(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.median("value").alias("median_value"))


@query("ops_revenue_by_nation", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def ops_revenue_by_nation(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
