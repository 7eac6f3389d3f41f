"""Passes: the compositions that a scheduler runs after a crawl, each as tables to come and a row of counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import prices, signals
from tidemark.operators.resolve import Product, resolve_listings
from tidemark.operators.serve import laid_over

#: Finished crawls after which an offer that none of them saw is retired.
RETIRE_AFTER = 3


def rollup_pass(observations: DataFrame, offers: DataFrame, runs: DataFrame, products: DataFrame, as_of: datetime, run_id: int | None = None, missed: int = RETIRE_AFTER) -> dict[str, DataFrame]:
    """Retires offers first, then recomputes rollups: all, or with ``run_id`` those of the offers that it observed or that were
    retired just now, and of their products; a retired offer's product counts even if no live offer of it was seen.

    offers (after retirement), offer_rollups, product_rollups. ``observations`` has run_id, ``offers`` last_seen, ``runs``
    started_at, finished and kind, ``products`` product_id.
    """
    after = prices.retire_unseen(offers, runs, missed)
    fresh = after.where("retired").join(offers.where("not retired").select("offer_id"), "offer_id", "left_semi")
    if run_id is None:
        offer_keys, product_keys = after.select(F.col("offer_id").alias("key")), products.select(F.col("product_id").alias("key"))
    else:
        seen = observations.where(F.col("run_id") == run_id).select("offer_id")
        offer_keys = seen.unionByName(fresh.select("offer_id")).distinct().withColumnRenamed("offer_id", "key")
        linked = after.where(prices.live()).join(offer_keys.withColumnRenamed("key", "offer_id"), "offer_id", "left_semi").select("product_id")
        product_keys = linked.unionByName(fresh.select("product_id")).where("product_id is not null").distinct().withColumnRenamed("product_id", "key")
    rows = observations.drop("run_id")
    # only the series of the keys in question are built
    own = rows.join(offer_keys.select(F.col("key").alias("offer_id")), "offer_id", "left_semi")
    kin = after.join(product_keys.withColumnRenamed("key", "product_id"), "product_id", "left_semi")
    theirs = rows.join(kin.select("offer_id"), "offer_id", "left_semi")
    return {"offers": after, "offer_rollups": prices.rollup_offers(own, offer_keys, as_of), "product_rollups": prices.rollup_products(theirs, kin, product_keys, as_of)}


def signal_pass(rollups: DataFrame, keys: DataFrame, rule: signals.Thresholds = signals.Thresholds(), windows: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Signals of the products of ``keys`` that have a rollup (product_id, signal, reason_codes, offer_id, as_of, decided_at null), and
    one row of counts: decided, buys, waits, neutrals, without_rollup, as_of (the newest)."""
    made = signals.decide(rollups.join(keys.select("key").distinct(), "key", "left_semi"), rule, windows)
    rows = made.select(F.col("key").alias("product_id"), "signal", "reason_codes", F.col("current_offer_id").alias("offer_id"), "as_of")
    asked = keys.select("key").distinct().join(rollups.select("key", "as_of"), "key", "left").join(rows.select(F.col("product_id").alias("key"), "signal"), "key", "left")
    n = lambda s: F.count_if(F.col("signal") == s)
    counts = asked.agg(F.count("signal").alias("decided"), n("buy").alias("buys"), n("wait").alias("waits"), n("neutral").alias("neutrals"), F.count_if(F.col("signal").isNull()).alias("without_rollup"), F.max("as_of").alias("as_of"))
    return rows, counts


def derived_specs(offers: DataFrame) -> DataFrame:
    """product_id and spec: of each field the most common value over the product's live offers, ties to the lesser text."""
    counted = offers.where(prices.live()).select("product_id", F.explode("spec").alias("k", "v")).groupBy("product_id", "k", "v").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b")
    each = counted.groupBy("product_id", "k").agg(best)
    return each.groupBy("product_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("b.v").alias("v"))))).alias("spec"))


def overlaid(products: DataFrame, derived: DataFrame, seeds: DataFrame) -> DataFrame:
    """``products`` (product_id, spec) after their specs are derived and the seeds' own values laid on top, with whether each changed."""
    none = F.create_map().cast("map<string,string>")
    rows = products.join(derived.withColumnRenamed("spec", "__d"), "product_id").join(seeds.select("product_id", F.col("spec").alias("__s")), "product_id", "left")
    spec = laid_over(F.coalesce("__s", none), F.coalesce("__d", none))
    flat = lambda m: F.array_sort(F.map_entries(F.coalesce(m, none)))
    return rows.select("product_id", spec.alias("spec"), (flat(spec) != flat(F.col("spec"))).alias("changed"))


def reset_links(offers: DataFrame) -> DataFrame:
    """Automatic links are pending again; human decisions stay."""
    auto = F.col("status") == "auto"
    return offers.withColumns({"status": F.when(auto, "pending").otherwise(F.col("status")), "product_id": F.when(~auto, F.col("product_id")), "score": F.when(~auto, F.col("score"))})


def resolution_pass(offers: DataFrame, products: list[Product], identity: tuple[str, ...] = (), non_product: tuple[str, ...] = (), rescore: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pending offers are linked, proposed or left: ``offers`` after it, and one row of counts (considered, auto_linked, for_review,
    unmatched, queue). ``offers``: offer_id, brand, title, spec, status, product_id, proposed_id, score. With ``rescore``
    automatic links are reopened first."""
    open_ = reset_links(offers) if rescore else offers
    pending = open_.where("status = 'pending'")
    made = resolve_listings(pending, products, identity, non_product).select("offer_id", F.col("product_id").alias("__p"), F.col("score").alias("__s"), "outcome")
    linked = F.col("outcome") == "auto"
    decided = F.col("outcome").isNotNull()
    after = open_.join(made, "offer_id", "left").withColumns(
        {
            "status": F.when(linked, "auto").otherwise(F.col("status")),
            "product_id": F.when(linked, F.col("__p")).otherwise(F.col("product_id")),
            "proposed_id": F.when(linked, None).when(decided, F.when(F.col("outcome") == "review", F.col("__p"))).otherwise(F.col("proposed_id")),
            "score": F.when(decided, F.col("__s")).otherwise(F.col("score")),
        }
    )
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = after.agg(F.count("outcome").alias("considered"), n("auto").alias("auto_linked"), n("review").alias("for_review"), n("none").alias("unmatched"), F.count_if((F.col("status") == "pending") & F.col("proposed_id").isNotNull()).alias("queue"))
    return after.drop("__p", "__s", "outcome"), counts


def review_queue(offers: DataFrame, limit: int = 50) -> DataFrame:
    """Pending offers with a proposal, best score first."""
    return offers.where("status = 'pending' and proposed_id is not null").orderBy(F.desc("score"), "offer_id").limit(limit)


def review(offers: DataFrame, decisions: DataFrame) -> DataFrame:
    """``offers`` after a person's ``decisions`` (offer_id, verdict accept or reject, product_id or null for the proposal).

    Only pending offers change, and none is accepted without a product.
    """
    d = decisions.select("offer_id", "verdict", F.col("product_id").alias("__p"))
    rows = offers.join(d, "offer_id", "left")
    target = F.coalesce("__p", "proposed_id")
    accept = F.coalesce((F.col("status") == "pending") & (F.col("verdict") == "accept") & target.isNotNull(), F.lit(False))
    reject = F.coalesce((F.col("status") == "pending") & (F.col("verdict") == "reject"), F.lit(False))
    return rows.withColumns({"product_id": F.when(accept, target).otherwise(F.col("product_id")), "status": F.when(accept, "reviewed").when(reject, "rejected").otherwise(F.col("status")), "proposed_id": F.when(~accept & ~reject, F.col("proposed_id"))}).drop("verdict", "__p")
