"""The deal rule: buy, wait or neutral for each rollup row, with ordered reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prices import is_sale


@dataclass(frozen=True)
class Thresholds:
    buy_percentile: float = 0.20
    wait_percentile: float = 0.50
    near_low: float = 1.05
    min_observations: int = 30
    min_sale_windows: int = 1

    def __post_init__(self):
        if not 0 <= self.buy_percentile < self.wait_percentile <= 1:
            raise ValueError("percentiles must be within [0, 1], buy below wait")
        if self.near_low < 1 or self.min_observations < 1 or self.min_sale_windows < 1:
            raise ValueError("near_low, min_observations and min_sale_windows must be at least 1")


def decide(rows: DataFrame, t: Thresholds = Thresholds(), windows: Column | None = None) -> DataFrame:
    """``rows`` (rollups) with signal and reason_codes. ``windows`` counts a row's sales where they are not an array."""
    c = F.col
    price, listed = c("current_price_cents"), c("list_price_cents")
    sale = is_sale(price, listed)
    low = price <= c("min_365d")
    near = ~low & (price.cast("double") <= c("min_365d").cast("double") * t.near_low)
    cheap, dear = c("percentile_365d") <= t.buy_percentile, c("percentile_365d") >= t.wait_percentile
    ever = c("sale_days_365d") > 0
    recur = ever & ((F.size("sale_windows") if windows is None else windows) >= t.min_sale_windows)
    buy = sale & (low | near | cheap)
    wait = ~buy & recur & (~sale | dear)
    gate = F.when(price.isNull(), "NO_PRICE").when(~F.coalesce("current_in_stock", F.lit(False)), "OUT_OF_STOCK").when(c("observations_365d") < t.min_observations, "THIN_HISTORY")
    said = F.array(
        F.when(sale, "ON_SALE").when(price >= listed, "AT_LIST").otherwise("MILD_DISCOUNT"),
        F.when(low, "YEAR_LOW").when(near, "NEAR_YEAR_LOW"),
        F.when(cheap, "LOW_PERCENTILE").when(dear, "HIGH_PERCENTILE"),
        F.when(buy, None).when(wait, "SALES_RECUR").when(~ever, "NO_SALE_HISTORY").when(recur, "MIDDLING_SALE").otherwise("SALES_RARE"),
        F.when(c("synthetic_365d") * 2 > c("observations_365d"), "MOSTLY_SYNTHETIC"),
    )
    return rows.withColumns(
        {
            "signal": F.when(gate.isNotNull(), "neutral").when(buy, "buy").when(wait, "wait").otherwise("neutral"),
            "reason_codes": F.when(gate.isNotNull(), F.array(gate)).otherwise(F.array_compact(said)),
        }
    )
