"""Writes as tables to come: what a table holds after an upsert, an insert-if-absent or a purge."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with their key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str], fallback: list[str] = ()) -> DataFrame:
    """As ``upsert``, but ``kept`` columns stay as they were, and ``fallback`` ones where the new value is null."""
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    joined = a.join(b, keys, "full")
    out = list(keys)
    for c in [c for c in old.columns if c not in keys]:
        was, now = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in kept:
            out.append(F.when(F.col("a.__old"), was).otherwise(now).alias(c))
        elif c in fallback:
            out.append(F.coalesce(now, was).alias(c))
        else:
            out.append(F.when(F.col("b.__new"), now).otherwise(was).alias(c))
    return joined.select(*out)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_machine_rows(rows: DataFrame, made: DataFrame, pair: list[str], human: str = "status = 'reviewed'") -> DataFrame:
    """Human decisions stay; all others are replaced by ``made``, save for pairs that a human owns."""
    kept = rows.where(human)
    return kept.unionByName(made.join(kept.select(*pair), pair, "left_anti"))


def retain(rows: DataFrame, at: str, since: datetime, subject: Column) -> DataFrame:
    """Without the rows under ``subject`` that are older than ``since``."""
    return rows.where((F.col(at) >= F.lit(since)) | ~subject)


def write_observations(observations: DataFrame, path: str, parts: int = 1, months: set[str] | None = None) -> None:
    """Appends by month, clustered by offer inside each file, so that time and offer bounds skip data.

    ``parts`` files a month, for months too large for one task. With ``months`` (yyyy_MM), a row of any other is an error.
    """
    month = F.date_format("observed_at", "yyyy_MM")
    if months is not None:
        month = F.when(month.isin(sorted(months)), month).otherwise(F.raise_error(F.concat(F.lit("no partition for month "), month)).cast("string"))
    rows = observations.withColumn("obs_month", month)
    rows.repartition("obs_month", F.pmod(F.xxhash64("offer_id"), F.lit(parts))).sortWithinPartitions("offer_id", "observed_at").write.mode("append").partitionBy("obs_month").parquet(path)


def read_observations(spark, path: str, after: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Observations later than ``after``, up to ``until``; months outside are pruned."""
    rows = spark.read.option("basePath", path).parquet(path)
    if after is not None:
        rows = rows.where((F.col("obs_month") >= after.strftime("%Y_%m")) & (F.col("observed_at") > F.lit(after)))
    if until is not None:
        rows = rows.where((F.col("obs_month") <= until.strftime("%Y_%m")) & (F.col("observed_at") <= F.lit(until)))
    return rows


def fetch_audit(fetches: DataFrame, path: str) -> None:
    """Appends the audit of fetches; rows are never changed."""
    fetches.write.mode("append").parquet(path)


def stored_bodies(bodies: DataFrame) -> DataFrame:
    """``bodies`` (run_id, kind, body) as files by content: run_id, name (<run>/<sha256>.<kind>), body; equal bodies of a run once."""
    digest = F.sha2(F.col("body").cast("binary"), 256)
    return bodies.select("run_id", F.concat_ws("", F.col("run_id").cast("string"), F.lit("/"), digest, F.lit("."), "kind").alias("name"), "body").dropDuplicates(["name"])


def cached_robots(cache: DataFrame, now: datetime, seconds: int) -> DataFrame:
    """Entries no older than ``seconds``; older ones must be fetched again."""
    return cache.where(F.col("fetched_at") + F.make_dt_interval(secs=F.lit(seconds)) >= F.lit(now))


def put_robots(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """``cache`` after ``fresh`` (domain, body, status, fetched_at) is put; no body holds a NUL."""
    return upsert(cache, fresh.withColumn("body", F.translate("body", "\x00", "")), ["domain"])
