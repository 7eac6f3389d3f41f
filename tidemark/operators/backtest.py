"""Backtests on a dense grid of days: what a call would have been worth, without a look ahead.

A grid has (product_id, day_idx, price_cents, in_stock): one row for each product and day.
"""

from __future__ import annotations

from datetime import date
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.signals import Thresholds, decide


def _buyable() -> Column:
    return F.when(F.col("in_stock") & F.col("price_cents").isNotNull(), F.col("price_cents"))


def _days(first: int, last: int):
    return Window.partitionBy("product_id").orderBy("day_idx").rowsBetween(first, last)


def spine(daily: DataFrame, days: int) -> DataFrame:
    """``daily`` (product_id, day_idx, ...) with a row for every day from 0 to days - 1."""
    every = daily.select("product_id").distinct().withColumn("day_idx", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    return every.join(daily, ["product_id", "day_idx"], "left")


def trailing_median(grid: DataFrame, days: int = 365) -> DataFrame:
    """Median of the buyable prices of the last ``days`` days, this one included; null if there is none."""
    return grid.withColumn("median_cents", F.percentile(_buyable(), F.lit(0.5)).over(_days(1 - days, 0)))


def ahead(grid: DataFrame, horizon: int, tolerance: float) -> DataFrame:
    """The least price of the following days, and whether it is a drop. A day that can't be judged has no drop (null).

    scored: after the warm-up (a column of the grid), buyable, the horizon inside the data and something buyable in it.
    """
    price = _buyable()
    least = F.min(price).over(_days(1, horizon))
    last = F.max("day_idx").over(Window.partitionBy("product_id"))
    fits = price.isNotNull() & (F.col("day_idx") + horizon <= last) & least.isNotNull()
    drop = (least < price) & (price - least >= F.lit(tolerance) * price)
    return grid.withColumn("least_ahead_cents", least).withColumn("dropped", F.when(fits, drop))


def scored(grid: DataFrame, warmup: int) -> DataFrame:
    return grid.where((F.col("day_idx") >= warmup) & F.col("dropped").isNotNull())


def strategies(grid: DataFrame) -> DataFrame:
    """A row for each strategy: always buy, buy below the trailing median, else wait, and the deal rule where ``grid`` has its signal."""
    below = F.when(F.col("median_cents").isNull(), "neutral").when(F.col("price_cents") < F.col("median_cents"), "buy").otherwise("wait")
    said = {"always_buy": F.lit("buy"), "below_median": below} | ({"rule": F.coalesce("signal", F.lit("neutral"))} if "signal" in grid.columns else {})
    each = F.array(*(F.struct(F.lit(k).alias("strategy"), v.alias("call")) for k, v in said.items()))
    return grid.withColumn("s", F.explode(each)).select(*grid.columns, "s.*")


def tally(calls: DataFrame, by: list[str]) -> DataFrame:
    """Counts of days, drops, calls and hits, and their rates; a rate over nothing is null."""
    buy, wait = F.col("call") == "buy", F.col("call") == "wait"
    hit = (buy & ~F.col("dropped")) | (wait & F.col("dropped"))
    n = calls.groupBy(*by).agg(
        F.count("*").alias("days"),
        F.count_if("dropped").alias("drops"),
        F.count_if(buy).alias("buys"),
        F.count_if(wait).alias("waits"),
        F.count_if(~buy & ~wait).alias("neutrals"),
        F.count_if(hit).alias("hits"),
        F.count_if(buy & hit).alias("buy_hits"),
        F.count_if(wait & hit).alias("wait_hits"),
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), b.cast("double"))
    called = F.col("buys") + F.col("waits")
    return n.withColumns({"hit_rate": rate("hits", called), "coverage": F.try_divide(called.cast("double"), F.col("days").cast("double")), "buy_precision": rate("buy_hits", F.col("buys")), "wait_precision": rate("wait_hits", F.col("waits")), "base_rate": rate("drops", F.col("days"))})


def follow(calls: DataFrame, horizon: int, grace: int = 14) -> DataFrame:
    """The price that following the calls would have paid: at the first buyable day that isn't a wait, else after the horizon."""
    price = _buyable()
    order = Window.partitionBy("strategy", "product_id").orderBy("day_idx")
    soon = F.first(F.when(F.col("call") != "wait", price), ignorenulls=True).over(order.rowsBetween(0, horizon - 1))
    late = F.first(price, ignorenulls=True).over(order.rowsBetween(horizon, horizon + grace))
    return calls.withColumn("paid_cents", F.coalesce(soon, late))


def _quotient(a: Column, b: Column) -> Column:
    """a / b as doubles; over zero it is infinite, and zero over zero is no number, where Spark's own division is an error."""
    over_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def policy(followed: DataFrame, by: list[str]) -> DataFrame:
    """Mean of paid over today's price, and how often it was less, the same or more; unresolved days paid nothing.

    A day whose price is zero has no finite ratio, so neither has the mean of its group; the counts have it as any other day.
    """
    paid, now = F.col("paid_cents"), F.col("price_cents")
    return followed.groupBy(*by).agg(
        F.avg(_quotient(paid, now)).alias("mean_ratio"), F.count_if(paid < now).alias("paid_less"), F.count_if(paid == now).alias("paid_same"), F.count_if(paid > now).alias("paid_more"), F.count_if(paid.isNull()).alias("unresolved")
    )


def by_reason(calls: DataFrame) -> DataFrame:
    """Calls and hits of every reason code; ``calls`` has reason_codes, call and dropped."""
    hit = ((F.col("call") == "buy") & ~F.col("dropped")) | ((F.col("call") == "wait") & F.col("dropped"))
    each = calls.withColumn("hit", hit).withColumn("code", F.explode("reason_codes"))
    return each.groupBy("code").agg(*(F.count_if(F.col("call") == c).alias(f"{c}s") for c in ("buy", "wait", "neutral")), F.count_if("hit").alias("hits"))


#: What every report tabulates besides its headline.
HORIZONS, TOLERANCES = (7, 14, 30), (0.0, 0.02, 0.05)
BUY_SWEEP, WAIT_SWEEP, WINDOW_SWEEP = (0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40), (0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 1.0), (1, 3, 5, 7, 9, 13)
HORIZON, TOLERANCE, WARMUP = 30, 0.02, 90


def rule_days(asof: DataFrame, first: date, days: int, rule: Thresholds = Thresholds()) -> DataFrame:
    """A dense grid of all products and days with the rule's inputs (``asof``, as prices.asof_grid makes them), its signal and reasons,
    the day's price and the trailing median."""
    rows = decide(asof, rule, F.col("sale_windows_n")).withColumnRenamed("key", "product_id")
    rows = rows.withColumn("day_idx", F.datediff("day", F.lit(first))).drop("day")
    dense = spine(rows, days).withColumns({"price_cents": F.col("current_price_cents"), "in_stock": F.coalesce("current_in_stock", F.lit(False))})
    return trailing_median(dense)


def horizons(grid: DataFrame, of: tuple[int, ...], tolerances: tuple[float, ...]) -> DataFrame:
    """``grid`` once for each horizon and tolerance, judged as by ``ahead``: the windows share one shuffle."""
    price, last = _buyable(), F.max("day_idx").over(Window.partitionBy("product_id"))
    seen = grid.withColumns({f"__least_{h}": F.min(price).over(_days(1, h)) for h in of} | {"__last": last})
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(float(t)).alias("tolerance"), F.col(f"__least_{h}").alias("least_ahead_cents")) for h in of for t in tolerances))
    rows = seen.withColumn("__p", F.explode(each)).select(*grid.columns, "__last", "__p.*")
    now, least = _buyable(), F.col("least_ahead_cents")
    fits = now.isNotNull() & (F.col("day_idx") + F.col("horizon") <= F.col("__last")) & least.isNotNull()
    return rows.withColumn("dropped", F.when(fits, (least < now) & (now - least >= F.col("tolerance") * now))).drop("__last")


def swept(grid: DataFrame, rule: Thresholds = Thresholds()) -> DataFrame:
    """``grid`` once for each threshold of the three sweeps (sweep, threshold), with the rule's call under it."""
    points = [("buy", b, b, rule.wait_percentile, rule.min_sale_windows) for b in BUY_SWEEP if b < rule.wait_percentile]
    points += [("wait", w, rule.buy_percentile, w, rule.min_sale_windows) for w in WAIT_SWEEP if w > rule.buy_percentile]
    points += [("windows", float(n), rule.buy_percentile, rule.wait_percentile, n) for n in WINDOW_SWEEP]
    each = F.array(*(F.struct(F.lit(a).alias("sweep"), F.lit(float(t)).alias("threshold"), F.lit(float(b)).alias("__buy"), F.lit(float(w)).alias("__wait"), F.lit(n).alias("__n")) for a, t, b, w, n in points))
    rows = grid.drop("signal", "reason_codes").withColumn("__s", F.explode(each)).select(*(c for c in grid.columns if c not in ("signal", "reason_codes")), "__s.*")
    t = SimpleNamespace(buy_percentile=F.col("__buy"), wait_percentile=F.col("__wait"), near_low=rule.near_low, min_observations=rule.min_observations, min_sale_windows=F.col("__n"))
    return decide(rows, t, F.col("sale_windows_n")).withColumn("call", F.coalesce("signal", F.lit("neutral"))).drop("__buy", "__wait", "__n")


def report(grid: DataFrame, horizon: int = HORIZON, tolerance: float = TOLERANCE, warmup: int = WARMUP, rule: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """Every table of a backtest over ``rule_days``: headline, rule_days (the baselines where the rule spoke), by_horizon,
    by_tolerance, sweeps, reasons, policies and products. Only days that can be judged count."""
    judged = ahead(grid, horizon, tolerance)
    calls = scored(strategies(judged), warmup)
    spoke = F.coalesce("signal", F.lit("neutral")) != "neutral"
    times = lambda hs, ts: scored(strategies(horizons(grid, hs, ts)), warmup)
    points = calls.where("strategy = 'rule'").groupBy("product_id").agg(F.sum("synthetic_365d").alias("synthetic_points"), F.sum("observations_365d").alias("points"))
    return {
        "headline": tally(calls, ["strategy"]),
        "rule_days": tally(calls.where(spoke & (F.col("strategy") != "rule")), ["strategy"]),
        "by_horizon": tally(times(tuple(sorted({*HORIZONS, horizon})), (tolerance,)), ["horizon", "strategy"]),
        "by_tolerance": tally(times((horizon,), tuple(sorted({*TOLERANCES, tolerance}))), ["tolerance", "strategy"]),
        "sweeps": tally(scored(swept(judged, rule), warmup), ["sweep", "threshold"]),
        "reasons": by_reason(calls.where("strategy = 'rule' and signal is not null")),
        "policies": policy(scored(follow(strategies(judged), horizon), warmup), ["strategy"]),
        "products": tally(calls, ["product_id", "strategy"]).join(points, "product_id"),
    }
