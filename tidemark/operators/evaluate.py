"""Evaluation of resolution, mentions and sentiment against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.community import threshold_sweep

CLASSES = ("positive", "negative", "neutral")


def judged_links(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each label whose subject was decided: subject, product_id, truth, score (0 if another product, or none, was chosen).

    ``decisions``: subject, product_id, score; ``labels``: subject, product_id, truth.
    """
    said = decisions.select("subject", F.col("product_id").alias("__p"), "score")
    rows = labels.join(said, "subject")
    return rows.select("subject", "product_id", "truth", F.when(F.col("__p").eqNullSafe(F.col("product_id")), F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("score"))


def unjudged(decisions: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links of ``least`` or more of labelled subjects to products that no label of theirs mentions."""
    links = decisions.where((F.col("score") >= least) & F.col("product_id").isNotNull()).join(labels.select("subject").distinct(), "subject", "left_semi")
    return links.join(labels.select("subject", "product_id"), ["subject", "product_id"], "left_anti").select("subject", "product_id", "score")


def link_report(decisions: DataFrame, labels: DataFrame, auto: float, review: float) -> dict[str, DataFrame]:
    """sweep (precision, recall, F1 at 21 thresholds), point (at ``auto``, with the number in the review band), skipped labels and
    unjudged links."""
    rows = judged_links(decisions, labels)
    said = F.col("score") >= auto
    n = rows.agg(F.count_if(said & F.col("truth")).alias("tp"), F.count_if(said & ~F.col("truth")).alias("fp"), F.count_if(~said & F.col("truth")).alias("fn"), F.count_if((F.col("score") >= review) & ~said).alias("in_review"), F.count("*").alias("judged"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(1.0))
    return {
        "sweep": threshold_sweep(rows.where("score > 0 or truth").select("score", "truth")),
        "point": n.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")}),
        "skipped": labels.join(decisions.select("subject"), "subject", "left_anti"),
        "unjudged": unjudged(decisions, labels, auto),
    }


def confusion(rows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Of ``label`` and ``said``: a row for each class with how often each class was said, precision, recall (0 if undefined), and the
    accuracy of all."""
    every = rows.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    counts = rows.groupBy("label").agg(*(F.count_if(F.col("said") == c).alias(f"said_{c}") for c in classes))
    table = every.join(counts, "label", "left").na.fill(0)
    sums = rows.agg(*(F.count_if(F.col("said") == c).alias(f"__{c}") for c in classes), F.avg((F.col("said") == F.col("label")).cast("double")).alias("accuracy"))
    pick = lambda prefix: F.coalesce(*(F.when(F.col("label") == c, F.col(f"{prefix}{c}")) for c in classes))
    hit, own = pick("said_"), sum((F.col(f"said_{c}") for c in classes), F.lit(0))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return table.crossJoin(F.broadcast(sums)).withColumns({"precision": zero(hit, pick("__")), "recall": zero(hit, own)}).drop(*(f"__{c}" for c in classes))  # one row
