"""The crawl queue's states as projections: what the task table holds after each step, for an explicit instant.

Spark's scheduler takes the place of workers' leases and of a leader; what remains is what a task may do next and when.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempts after which a task is dead, and seconds before the first retry.
ATTEMPTS, BASE = 3, 30


def backoff(attempts: Column, base: int = BASE) -> Column:
    """Seconds until the next attempt: twice as long each time."""
    return (F.lit(base) * F.pow(F.lit(2.0), attempts - 1)).cast("long")


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """``tasks`` with the pages of ``new`` that a run does not have yet (run_id, retailer, path, page)."""
    key = ["run_id", "retailer", "path", "page"]
    return tasks.unionByName(new.dropDuplicates(key).join(tasks.select(*key), key, "left_anti"), allowMissingColumns=True)


def claimable(tasks: DataFrame, limits: DataFrame) -> DataFrame:
    """Queued tasks in the order in which workers take them: the domain whose slot comes first, then the least id. A domain without a
    limit may be fetched at once."""
    return tasks.where("state = 'queued'").join(limits.select("domain", "next_allowed_at"), "domain", "left").orderBy(F.asc_nulls_first("next_allowed_at"), "task_id")


def reserve(limits: DataFrame, domain: str, now: datetime, seconds: int) -> DataFrame:
    """``limits`` after a slot of ``domain`` is taken: the later of its next slot and now, plus the interval."""
    at = F.greatest(F.col("next_allowed_at"), F.lit(now)) + F.make_dt_interval(secs=F.lit(seconds))
    return limits.withColumn("next_allowed_at", F.when(F.col("domain") == domain, at).otherwise(F.col("next_allowed_at")))


def held(worker: str, now: datetime) -> Column:
    """Whether a worker still holds a task: leased to it, and the lease not over."""
    return F.coalesce((F.col("state") == "leased") & (F.col("worker") == worker) & (F.col("lease_until") > F.lit(now)), F.lit(False))


def heartbeat(tasks: DataFrame, worker: str, now: datetime, seconds: int) -> DataFrame:
    """Leases that the worker still holds last ``seconds`` from now."""
    until = F.lit(now) + F.make_dt_interval(secs=F.lit(seconds))
    return tasks.withColumn("lease_until", F.when(held(worker, now), until).otherwise(F.col("lease_until")))


def finish(tasks: DataFrame, results: DataFrame, worker: str, now: datetime, attempts: int = ATTEMPTS, base: int = BASE) -> DataFrame:
    """``tasks`` after a worker reports ``results`` (task_id, ok). A report on a task that it no longer holds counts as nothing.

    A failed task waits for its next attempt, or is dead after the last.
    """
    rows = tasks.join(results.select("task_id", "ok"), "task_id", "left")
    mine = held(worker, now) & F.col("ok").isNotNull()
    spent = F.col("attempts") >= attempts
    state = F.when(mine & F.col("ok"), "done").when(mine & spent, "dead").when(mine, "retry").otherwise(F.col("state"))
    due = F.timestamp_seconds(F.unix_timestamp(F.lit(now)) + backoff(F.col("attempts"), base))
    return rows.withColumns({"state": state, "retry_at": F.when(mine & ~F.col("ok") & ~spent, due).otherwise(F.col("retry_at")), "lease_until": F.when(~mine, F.col("lease_until")), "worker": F.when(~mine, F.col("worker"))}).drop("ok")


def throughput(fetches: DataFrame) -> DataFrame:
    """For each run: pages, offers, seconds from the first start to the last finish, and offers a second."""
    seconds = (F.unix_micros(F.max("finished_at").cast("timestamp")) - F.unix_micros(F.min("started_at").cast("timestamp"))) / 1e6
    rows = fetches.groupBy("run_id").agg(F.count("*").alias("pages"), F.sum("offers").alias("offers"), seconds.alias("seconds"))
    return rows.withColumn("offers_per_second", F.try_divide("offers", "seconds"))
