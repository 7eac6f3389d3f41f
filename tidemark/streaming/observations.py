"""Observations as they come: idempotent replays, rollups of touched offers, retention.

An observation carries its run's start as its instant, so a page that is fetched again lands where it was; the watermark must
exceed the longest time that a retry may take.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import prices

KEYS = ["offer_id", "observed_at"]


def distinct_observations(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """The first row of each (offer, instant); state is dropped once the watermark has passed, and rows older than it are late."""
    return stream.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(KEYS)


def keep_rollups(stream: DataFrame, folder: str, checkpoint: str, as_of: Callable[[DataFrame], datetime], interval: str | None = None) -> StreamingQuery:
    """Appends each batch to ``folder``/observations by month and writes the rollups of the offers that it touched.

    A batch's files are named by its number, and its rollups replace whatever an earlier try has left, so that a batch that runs
    twice leaves the same tables. ``as_of`` gives the instant of a batch's rollups. Without ``interval`` all that is there is
    processed, then the query ends.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        month = F.date_format("observed_at", "yyyy_MM")
        batch.withColumn("obs_month", month).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "obs_month").parquet(f"{folder}/observations")
        every = spark.read.option("basePath", f"{folder}/observations").parquet(f"{folder}/observations").drop("obs_month")
        # a row that came in two batches counts by the earlier one
        every = prices.insert_absent(every, ["batch"]).drop("batch")
        touched = batch.select("offer_id").distinct()
        rows = every.join(touched, "offer_id", "left_semi")
        prices.rollup_offers(rows, touched.withColumnRenamed("offer_id", "key"), as_of(batch)).write.mode("overwrite").parquet(f"{folder}/rollups/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def current_rollups(spark, folder: str) -> DataFrame:
    """Each offer's rollup of the last batch that touched it."""
    rows = spark.read.option("basePath", f"{folder}/rollups").parquet(f"{folder}/rollups")
    newest = rows.groupBy("key").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["key", "batch"])


def recent(stream: DataFrame, at: str, days: int, now: datetime) -> DataFrame:
    """Rows of the last ``days`` days by processing time."""
    return stream.where(F.col(at) >= F.lit(now) - F.make_dt_interval(days=F.lit(days)))
