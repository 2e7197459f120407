"""Operational tables: jobs, events, failures, usage, cache, and what is asked of them.

State is append-only: a job, failure or cache entry has versions, and the latest
one counts.  No row is ever locked; a transition is a row that is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How internal job states read outside.
PUBLIC_STATUS = {
    "queued": "scraping", "running": "scraping", "cancelling": "scraping", "completed": "completed", "failed": "failed",
    "cancelled": "cancelled",
}


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*key).orderBy(*(F.col(o).desc() for o in order))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def upsert_positions(df: DataFrame, key: list[str], seq: str, content: str) -> DataFrame:
    """Each key at its first position with its last content, as an update in place would leave it."""
    return df.groupBy(*key).agg(F.min(seq).alias("position"), F.max_by(content, seq).alias(content))


def owned(df: DataFrame, owner: str | None, column: str = "owner_key") -> DataFrame:
    """Rows of an owner; all without one."""
    return df if owner is None else df.filter(F.col(column) == owner)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def event_counts(events: DataFrame, jobs: DataFrame, owner: str | None = None) -> DataFrame:
    """Events by type, of the jobs of an owner."""
    return counts_by(events.join(owned(jobs, owner).select("job_id"), "job_id"), "event_type")


def queue_metrics(jobs: DataFrame, now: float) -> DataFrame:
    """One row: ready, delayed, running, cancelling."""
    queued = F.col("status") == "queued"
    return jobs.agg(
        F.count_if(queued & (F.col("available_at") <= now)).alias("ready"),
        F.count_if(queued & (F.col("available_at") > now)).alias("delayed"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status") == "cancelling").alias("cancelling"),
    )


def failure_metrics(failures: DataFrame) -> DataFrame:
    """(kind, name, n): failures by status, open ones by type, and open ones that may be retried, in one pass."""
    open_ = F.col("status") == "open"
    facts = F.array(
        F.struct(F.lit("status").alias("kind"), F.col("status").alias("name")),
        F.when(open_, F.struct(F.lit("open_type").alias("kind"), F.col("error_type").alias("name"))),
        F.when(open_ & F.col("retryable"), F.struct(F.lit("open_retryable").alias("kind"), F.lit("").alias("name"))),
    )
    return failures.select(F.explode(F.array_compact(facts)).alias("f")).groupBy("f.kind", "f.name").agg(F.count("*").alias("n"))


def list_failures(
    failures: DataFrame, jobs: DataFrame | None = None, owner: str | None = None, status: str | None = "open",
    retryable: bool | None = None, error_type: str | None = None, domain: str | None = None, offset: int = 0, limit: int = 100,
) -> DataFrame:
    """A page of failures, newest first."""
    out = failures
    if owner is not None:
        out = out.join(owned(jobs, owner).select("job_id"), "job_id", "left_semi")
    for column, value in (("status", status), ("retryable", retryable), ("error_type", error_type)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if domain:
        d = domain.lower().strip()
        out = out.filter(F.col("url").contains(f"://{d}/") | F.col("url").contains(f"://{d}:") | F.col("url").endswith(f"://{d}"))
    return out.orderBy(F.col("failed_at").desc(), "url").offset(offset).limit(limit)


def usage_by_endpoint(usage: DataFrame, api_key: str | None = None) -> DataFrame:
    rows = usage if api_key is None else usage.filter(F.col("api_key") == api_key)
    return rows.groupBy("endpoint").agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"))


def billed_pages(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of each job, 0 for none."""
    n = documents.groupBy("job_id").agg(F.count("*").alias("n"))
    return jobs.join(n, "job_id", "left").select("job_id", F.coalesce("n", F.lit(0)).alias("billed_pages"))


def billing_units(pages: Column, billed: Column, least: int = 1) -> Column:
    return F.greatest(F.lit(least), pages - billed)


def change_status(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """``now`` with a column change: new, changed or unchanged against an earlier snapshot."""
    old = before.select(F.col(key).alias("_key"), F.col(digest).alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(digest), "changed").otherwise("unchanged")
    return now.join(old, F.col(key) == F.col("_key"), "left").withColumn("change", state).drop("_key", "_old")


def cache_valid(cache: DataFrame, now: float, owner: str | None = None) -> DataFrame:
    """Entries that have not expired, the latest version of each key."""
    return owned(latest(cache, ["cache_key"], ["created_at"]), owner).filter(F.col("expires_at") > now)


def cache_clear(cache: DataFrame, domain: str | None = None, url: str | None = None) -> DataFrame:
    """What is left after clearing a domain, a URL or, with neither, everything."""
    if url is not None:
        return cache.filter(F.col("url") != url)
    if domain is not None:
        return cache.filter(F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")) != domain.lower())
    return cache.limit(0)


def cache_domains(cache: DataFrame) -> DataFrame:
    """Entries by domain, most first."""
    d = F.lower(F.try_parse_url("url", F.lit("AUTHORITY")))
    return cache.groupBy(F.coalesce(F.when(d != "", d), F.lit("local")).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "domain")


def rate_windows(requests: DataFrame, key: str, seconds: str, units: str, span: int = 60) -> DataFrame:
    """``requests`` with the units of the same key within the last ``span`` seconds, the row's own included.

    The window ends are whole seconds; equal times see each other.
    """
    w = Window.partitionBy(key).orderBy(F.col(seconds)).rangeBetween(-span + 1, 0)
    return requests.withColumn("in_window", F.sum(units).over(w))


def spaced_slots(requests: DataFrame, domain: str, ts: str, order: list[str], delay: float) -> DataFrame:
    """When each request may start if those of a domain keep ``delay`` apart.

    slot_i = max over j <= i of (ts_j - j d) + i d, a running maximum instead of a fold.
    """
    w = Window.partitionBy(domain).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    i = F.row_number().over(w) - 1
    return requests.withColumn("_i", i).withColumn("slot", F.max(F.col(ts) - F.col("_i") * delay).over(run) + F.col("_i") * delay).drop("_i")


def streaks(df: DataFrame, key: str, order: str, bad: Column) -> DataFrame:
    """Runs of rows for which ``bad`` holds: (key, first, last, length)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_bad", bad).withColumn("_n", F.row_number().over(w))
    wb = Window.partitionBy(key, "_bad").orderBy(order)
    runs = marked.withColumn("_g", F.col("_n") - F.row_number().over(wb)).filter("_bad")
    return runs.groupBy(key, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_g")


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def envelope(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row: offset, limit, returned, total, has_more."""
    n = F.count("*")
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), n - offset))
    return df.agg(
        F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), returned.alias("returned"), n.alias("total"),
        (n > offset + returned).alias("has_more"),
    )


def new_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (seq, ...) marked created, reused (same key, same request) or mismatch, by (type, owner_key, idempotency_key).

    A request without a key is always created.  Of requests with one new key the
    first by seq is created, and the others are judged by it.
    """
    keys = ["type", "owner_key", "idempotency_key"]
    old = jobs.filter("idempotency_key is not null").select(*keys, F.col("request_json").alias("_old"))
    first = requests.filter("idempotency_key is not null").groupBy(*keys).agg(
        F.min("seq").alias("_seq"), F.min_by("request_json", "seq").alias("_first")
    )
    known = first.join(old, keys, "left")
    same = lambda c: F.when(F.col(c) == F.col("request_json"), "reused").otherwise("mismatch")
    outcome = (
        F.when(F.col("_old").isNotNull(), same("_old"))
        .when(F.col("_seq").isNull() | (F.col("_seq") == F.col("seq")), "created")
        .otherwise(same("_first"))
    )
    return requests.join(known, keys, "left").withColumn("outcome", outcome).drop("_old", "_seq", "_first")


def job_states(transitions: DataFrame) -> DataFrame:
    """(job_id, status) after all transitions (job_id, seq, action), folded in order.

    Actions: queue, claim, finish, fail, cancel, requeue.  A cancelled job stays
    so; a cancel of a running job becomes final when the run ends; claims of what
    is not queued change nothing.
    """
    def step(s: Column, a: Column) -> Column:
        return (
            F.when(s == "cancelled", s)
            .when(a == "queue", F.when(s == "new", "queued").otherwise(s))
            .when(a == "claim", F.when(s == "queued", "running").otherwise(s))
            .when(a == "cancel", F.when(s == "queued", "cancelled").when(s == "running", "cancelling").otherwise(s))
            .when(a.isin("finish", "fail", "requeue") & (s == "cancelling"), "cancelled")
            .when((a == "finish") & (s == "running"), "completed")
            .when((a == "fail") & (s == "running"), "failed")
            .when((a == "requeue") & (s == "running"), "queued")
            .otherwise(s)
        )

    steps = transitions.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("t"))
    return steps.select("job_id", F.aggregate("t", F.lit("new"), lambda s, t: step(s, t["action"])).alias("status"))


def expired_leases(jobs: DataFrame, now: float) -> DataFrame:
    """Running jobs whose lease has run out, as rows that queue them again."""
    return jobs.filter((F.col("status") == "running") & (F.col("lease_until") <= now)).select("job_id", F.lit("requeue").alias("action"))


def batch_remaining(urls: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct URLs of a batch in first order that have no document yet."""
    first = urls.groupBy("url").agg(F.min("seq").alias("seq"))
    return first.join(done.select("url"), "url", "left_anti").orderBy("seq")


def public_status(status: Column) -> Column:
    out = None
    for inside, outside in PUBLIC_STATUS.items():
        out = F.when(status == inside, outside) if out is None else out.when(status == inside, outside)
    return out.otherwise("scraping")
