"""Who may run and see what: leases of schedules, the fence of a run, access to jobs, fairness among jobs.

Spark has no row locks; these are set-based decisions over the latest state,
applied by one writer that appends what they grant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lease_decisions(requests: DataFrame, leases: DataFrame, now: float) -> DataFrame:
    """``requests`` (seq, schedule, holder) with granted.

    A lease (schedule, holder, until) that has not run out is granted to its
    holder alone, again and again; a free one goes to the holder that asks first.
    """
    held = leases.filter(F.col("until") > now).groupBy("schedule").agg(F.max_by("holder", "until").alias("_held"))
    first = requests.groupBy("schedule").agg(F.min_by("holder", "seq").alias("_first"))
    owner = first.join(held, "schedule", "left").select("schedule", F.coalesce("_held", "_first").alias("_owner"))
    return requests.join(owner, "schedule", "left").withColumn("granted", F.coalesce(F.col("holder") == F.col("_owner"), F.lit(False))).drop("_owner")


def lease_releases(releases: DataFrame, leases: DataFrame, now: float) -> DataFrame:
    """The leases that remain: a holder's own release ends a lease, anybody else's does nothing, and so does time."""
    return leases.filter(F.col("until") > now).join(releases.select("schedule", "holder"), ["schedule", "holder"], "left_anti")


def fenced_updates(updates: DataFrame, jobs: DataFrame, now: float) -> DataFrame:
    """``updates`` (job_id, run_token, ...) with accepted: the job runs, with this token, and its lease holds.

    jobs: job_id, status, run_token, lease_until.  A heartbeat or result of a run that has lost its job is refused.
    """
    state = jobs.select(
        "job_id", F.col("run_token").alias("_token"), (F.col("status").isin("running", "cancelling") & (F.col("lease_until") > now)).alias("_alive")
    )
    mine = (F.col("run_token") == F.col("_token")) & F.col("_alive")
    return updates.join(state, "job_id", "left").withColumn("accepted", F.coalesce(mine, F.lit(False))).drop("_token", "_alive")


def job_access(requests: DataFrame, jobs: DataFrame, auth: bool = True, admin: str | None = None) -> DataFrame:
    """``requests`` (job_id, owner_key) with allowed: the job is known, and is the asker's, or nobody is asked, or the admin asks."""
    owned = jobs.select("job_id", F.col("owner_key").alias("_owner"), F.lit(True).alias("_known"))
    free = F.lit(not auth) | (F.col("owner_key") == F.lit(admin) if admin is not None else F.lit(False))
    may = F.coalesce(F.col("_known"), F.lit(False)) & F.coalesce(free | (F.col("owner_key") == F.col("_owner")), F.lit(False))
    return requests.join(owned, "job_id", "left").withColumn("allowed", may).drop("_owner", "_known")


def page_quantum(frontier: DataFrame, quantum: int, job: str = "job_id", order: str = "seq") -> DataFrame:
    """The next pages of each job, ``quantum`` at most, before it lets the others run; a group limit, so tasks send no more."""
    w = Window.partitionBy(job).orderBy(order)
    return frontier.withColumn("_turn", F.row_number().over(w)).filter(F.col("_turn") <= quantum).drop("_turn")
