"""Community opinion: weighted consensus of mentions, quotes, and evaluation of labelled decisions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIKED, DISLIKED = 0.25, -0.25


def polarity(sentiment: Column) -> Column:
    return F.when(sentiment == "positive", 1).when(sentiment == "negative", -1).otherwise(0)


def leaning(score: Column) -> Column:
    return F.when(score.isNull(), "unheard").when(score >= LIKED, "liked").when(score <= DISLIKED, "disliked").otherwise("mixed")


def consensus(products: DataFrame, mentions: DataFrame, since: datetime) -> DataFrame:
    """A row for each product over its automatic mentions after ``since``; no mention leaves the score null and counts 0.

    ``mentions``: mention_id, product_id, community, weight (null: 1), sentiment, status, posted_at.
    """
    s = polarity(F.col("sentiment"))
    w = F.coalesce("weight", F.lit(1.0))
    heard = mentions.where((F.col("status") == "auto") & (F.col("posted_at") > F.lit(since)))
    newest = F.struct(F.unix_micros("posted_at").alias("at"), (-F.col("mention_id")).alias("id"))
    pick = lambda cond: F.max(F.when(cond, newest))
    found = heard.groupBy("product_id").agg(
        F.coalesce(F.try_divide(F.sum(w * s), F.sum(w)), F.lit(0.0)).alias("score"),
        F.count("*").alias("mention_count"),
        F.count_if(s > 0).alias("positive_count"),
        F.count_if(s < 0).alias("negative_count"),
        F.count_if(s == 0).alias("neutral_count"),
        F.avg((s > 0).cast("double")).alias("positive_share"),
        F.count_distinct("community").alias("communities"),
        pick(s > 0).alias("up"),
        pick(s < 0).alias("down"),
    )
    # the two newest of each product: a limit that runs before the shuffle, so that a product's mentions never meet
    order = Window.partitionBy("product_id").orderBy(F.desc("posted_at"), "mention_id")
    fresh = heard.select("product_id", "posted_at", "mention_id").withColumn("n", F.row_number().over(order)).where("n <= 2")
    fresh = fresh.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("n", (-F.col("mention_id")).alias("id")))).alias("fresh"))
    whole = products.select("product_id").join(found, "product_id", "left").join(fresh, "product_id", "left")
    ids = F.array_distinct(F.array_compact(F.array(-F.col("up.id"), -F.col("down.id"))))
    rest = F.transform(F.coalesce("fresh", F.array().cast("array<struct<n:int,id:bigint>>")), lambda x: -x["id"])
    quotes = F.slice(F.array_distinct(F.concat(ids, rest)), 1, 2)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("mention_count", "positive_count", "negative_count", "neutral_count", "communities")]
    return whole.select("product_id", "score", leaning(F.col("score")).alias("leaning"), *counts, "positive_share", quotes.alias("quote_mention_ids"))


def threshold_sweep(scored: DataFrame, steps: int = 20) -> DataFrame:
    """Precision, recall and F1 of ``score`` against boolean ``truth`` at i / steps; 1 where undefined.

    One pass: each row counts at every threshold that it reaches.
    """
    found = scored.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    said = F.col("score") >= F.col("step") / steps
    n = found.groupBy("step").agg(F.count_if(said & F.col("truth")).alias("tp"), F.count_if(said & ~F.col("truth")).alias("fp"), F.count_if(~said & F.col("truth")).alias("fn"))
    one = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(1.0))
    n = n.withColumn("precision", one(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", one(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
