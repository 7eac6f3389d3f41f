"""Serving queries: faceted search over products and their best matching listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prices import live

#: A product without a signal comes before those that are a buy, as nulls come first where truth is ordered downwards.
ORDERS = {
    "deal": lambda: [F.desc_nulls_first("is_buy"), F.asc_nulls_last("percentile_365d"), F.asc("price_cents"), F.asc("product_id")],
    "price": lambda: [F.asc("price_cents"), F.asc("product_id")],
    "name": lambda: [F.asc("name"), F.asc("product_id")],
    "consensus": lambda: [F.desc_nulls_last("score"), F.desc_nulls_last("mention_count"), F.asc("product_id")],
}


def contains_spec(spec: Column, wanted: dict[str, str]) -> Column:
    """Whether a map holds all of ``wanted``."""
    return reduce(lambda a, b: a & b, [spec[k].eqNullSafe(F.lit(v)) for k, v in wanted.items()], F.lit(True))


def laid_over(top: Column, under: Column) -> Column:
    """The map ``under`` with the entries of the map ``top`` in place of its own, whatever the session does with repeated keys."""
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(top, k)), top)


def search(
    products: DataFrame, offers: DataFrame, rollups: DataFrame, offer_rollups: DataFrame, signals: DataFrame | None, consensus: DataFrame, *, sort: str = "deal", low: int = 0, high: int | None = None, in_stock_only: bool = True, spec: dict[str, str] | None = None, signal: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """A row for each product with a matching live listing: the best one (in stock, cheapest, least id), and the unpaged total.

    A listing's spec overlays its product's; price and spec filters apply to the listing; prices have no upper bound unless asked for.
    ``signals`` is None where the rollups carry their signal.
    """
    if sort not in ORDERS or not 1 <= limit <= 200 or offset < 0:
        raise ValueError("sort must be known, limit within 1..200, offset not negative")
    price = offer_rollups.select("offer_id", F.col("current_price_cents").alias("price_cents"), F.col("current_in_stock").alias("in_stock"))
    listed = offers.where(live()).select("offer_id", "product_id", F.col("spec").alias("offer_spec")).join(price.where((F.col("price_cents") >= low) & (F.lit(True) if high is None else F.col("price_cents") <= high)), "offer_id")
    if in_stock_only:
        listed = listed.where("in_stock")
    if spec:
        listed = listed.join(products.select("product_id", "spec"), "product_id").where(contains_spec(laid_over(F.col("offer_spec"), F.col("spec")), spec))
    best = F.struct((~F.col("in_stock")).alias("away"), "price_cents", "offer_id")
    top = listed.groupBy("product_id").agg(F.min(best).alias("b")).select("product_id", F.col("b.offer_id").alias("offer_id"), F.col("b.price_cents").alias("price_cents"), (~F.col("b.away")).alias("in_stock"))
    rows = products.drop("spec").join(rollups, "product_id")
    rows = (rows if signals is None else rows.join(signals, "product_id", "left")).join(consensus, "product_id", "left").join(top, "product_id")
    if signal:
        rows = rows.where(F.col("signal") == signal)
    total = rows.agg(F.count("*").alias("total"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("is_buy", F.col("signal") == "buy")  # one row
    return rows.orderBy(*ORDERS[sort]()).offset(offset).limit(limit)


def history(observations: DataFrame, offer_id: int) -> DataFrame:
    from tidemark.operators.prices import daily_history

    return daily_history(observations.where(F.col("offer_id") == offer_id))
