from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row

from tidemark.operators import backtest, prices, signals

AS_OF = datetime(2030, 6, 1)
OFFER = [(400, 10000, True, False), (364, 10000, True, True), (200, 10000, True, True), (100, 9000, True, False), (99, 9000, True, False), (98, 10000, True, False), (70, 10000, True, False), (60, 10000, True, False), (25, 10000, True, False), (20, 8000, True, False), (19, 8000, True, False), (18, 8000, True, False), (5, 10000, True, False), (3, 10000, False, False), (0, 9500, True, False), (-1, 5000, True, False)]
SECOND = [(20, 7000, True, False), (5, 9400, True, False), (2, 9700, True, False), (0, 6000, False, False)]


def observed(spark, **offers):
    rows = [(int(o[1:]), AS_OF - timedelta(days=k), c, s, y) for o, points in offers.items() for k, c, s, y in points]
    return spark.createDataFrame(rows, "offer_id long, observed_at timestamp, price_cents int, in_stock boolean, synthetic boolean")


def linked(spark, *rows):
    return spark.createDataFrame(rows, "offer_id long, product_id long, status string, retired boolean")


def spans(row):
    return [((AS_OF - w.start_at).days, (AS_OF - w.end_at).days, w.min_price_cents, w.off_pct, w.days) for w in row.sale_windows]


def test_offer_rollup(spark):
    keys = spark.createDataFrame([(1,), (9,)], "key long")
    rows = {r.key: r for r in prices.rollup_offers(observed(spark, o1=OFFER), keys, AS_OF).collect()}
    r = rows[1]
    assert (r.current_price_cents, r.current_observed_at, r.current_in_stock, r.current_offer_id, r.list_price_cents) == (9500, AS_OF, True, None, 10000)
    assert [(r[f"min_{d}d"], r[f"median_{d}d"], r[f"max_{d}d"]) for d in (7, 30, 90, 365)] == [(9500, 10000, 10000), (8000, 9500, 10000), (8000, 10000, 10000), (8000, 10000, 10000)]
    assert (r.observations_365d, r.synthetic_365d) == (14, 2) and r.percentile_365d == pytest.approx(5 / 14)
    assert spans(r) == [(20, 18, 8000, 20, 3), (100, 99, 9000, 10, 2)] and r.sale_days_365d == 5
    assert (AS_OF - r.last_sale_ended_at).days == 18
    none = rows[9]
    assert none.current_price_cents is None and none.observations_365d == 0 and none.sale_windows == [] and none.volatility_365d is None


def test_product_rollup(spark):
    o = observed(spark, o1=OFFER, o2=SECOND, o3=[(20, 1000, True, False), (0, 1000, True, False)], o4=[(0, 100, True, False)])
    links = linked(spark, (1, 7, "auto", False), (2, 7, "reviewed", False), (3, 7, "auto", True), (4, 7, "pending", False))
    keys = spark.createDataFrame([(7,)], "key long")
    r = prices.rollup_products(o, links, keys, AS_OF).first()
    assert (r.current_price_cents, r.current_offer_id, r.list_price_cents) == (9500, 1, 10000)
    assert [(r[f"min_{d}d"], r[f"median_{d}d"], r[f"max_{d}d"]) for d in (7, 30, 90, 365)] == [(9400, 9500, 9700), (7000, 9400, 10000), (7000, 9500, 10000), (7000, 9600, 10000)]
    assert (r.observations_365d, r.synthetic_365d) == (14, 2) and r.percentile_365d == pytest.approx(6 / 14)
    assert spans(r) == [(20, 18, 7000, 30, 3), (100, 99, 9000, 10, 2)]
    then = prices.rollup_products(o, links.where("offer_id = 1"), keys, AS_OF - timedelta(days=21)).first()
    assert (then.current_price_cents, then.observations_365d, then.percentile_365d) == (10000, 8, 0.25)


def test_nothing_in_stock(spark):
    o = observed(spark, o1=[(10, 12000, True, False), (1, 11000, False, False)])
    r = prices.rollup_products(o, linked(spark, (1, 7, "auto", False)), spark.createDataFrame([(7,)], "key long"), AS_OF).first()
    assert (r.current_price_cents, r.current_in_stock, r.min_365d, r.median_365d, r.max_365d, r.observations_365d) == (11000, False, 12000, 12000, 12000, 1)


@pytest.mark.parametrize(
    ("price", "pct", "days", "signal", "reasons"),
    [
        (7000, 0.0, 10, "buy", "ON_SALE YEAR_LOW LOW_PERCENTILE"),
        (7350, 0.33, 60, "buy", "ON_SALE NEAR_YEAR_LOW"),
        (7351, 0.33, 60, "neutral", "ON_SALE MIDDLING_SALE"),
        (8500, 0.20, 40, "buy", "ON_SALE LOW_PERCENTILE"),
        (8500, 0.21, 40, "neutral", "ON_SALE MIDDLING_SALE"),
        (9000, 0.50, 200, "wait", "ON_SALE HIGH_PERCENTILE SALES_RECUR"),
        (9000, 0.49, 200, "neutral", "ON_SALE MIDDLING_SALE"),
        (10000, 0.15, 40, "wait", "AT_LIST LOW_PERCENTILE SALES_RECUR"),
        (10500, 0.90, 40, "wait", "AT_LIST HIGH_PERCENTILE SALES_RECUR"),
        (9100, 0.30, 40, "wait", "MILD_DISCOUNT SALES_RECUR"),
        (10000, 0.0, 0, "neutral", "AT_LIST LOW_PERCENTILE NO_SALE_HISTORY"),
        (None, None, 0, "neutral", "NO_PRICE"),
    ],
)
def test_deal_rule(spark, price, pct, days, signal, reasons):
    from pyspark.sql import functions as F

    row = Row(current_price_cents=price, current_in_stock=True, list_price_cents=10000, min_365d=7000, percentile_365d=pct, sale_days_365d=days, windows=int(days > 0), observations_365d=365, synthetic_365d=0)
    schema = "current_price_cents int, current_in_stock boolean, list_price_cents int, min_365d int, percentile_365d double, sale_days_365d int, windows int, observations_365d int, synthetic_365d int"
    got = signals.decide(spark.createDataFrame([row], schema), windows=F.col("windows")).first()
    assert (got.signal, " ".join(got.reason_codes)) == (signal, reasons)


def test_backtest(spark):
    dollars = [100, 100, 100, 100, 90, 90, 100, 100, 100, 80, 100, 100]
    rows = spark.createDataFrame([(1, i, 100 * p, True) for i, p in enumerate(dollars)], "product_id long, day_idx int, price_cents int, in_stock boolean")
    judged = backtest.ahead(backtest.trailing_median(rows), 3, 0.02)
    drops = {r.day_idx: r.dropped for r in judged.collect()}
    assert [drops[d] for d in (2, 6, 8, 4, 5, 9)] == [True, True, True, False, False, None]
    calls = backtest.strategies(judged)
    tallies = {r.strategy: r for r in backtest.tally(backtest.scored(calls, 2), ["strategy"]).collect()}
    assert tallies["always_buy"].days == 7 and tallies["always_buy"].drops == 5 and tallies["always_buy"].hit_rate == pytest.approx(2 / 7)
    assert tallies["below_median"].hit_rate == 1.0 and (tallies["below_median"].buys, tallies["below_median"].waits) == (2, 5)


def test_policy_over_days_that_cost_nothing(spark):
    """A price of zero is no error: the ratio is what doubles give, and the counts have the day."""
    rows = [("a", 5, 10), ("a", 20, 10), ("a", None, 10), ("b", 0, 0), ("b", 5, 10), ("c", 5, 0), ("c", 5, 10), ("d", None, 0), ("d", 5, 10)]
    followed = spark.createDataFrame(rows, "strategy string, paid_cents int, price_cents int")
    got = {r.strategy: r for r in backtest.policy(followed, ["strategy"]).collect()}
    assert got["a"].mean_ratio == 1.25 and math.isnan(got["b"].mean_ratio) and got["c"].mean_ratio == math.inf and got["d"].mean_ratio == 0.5
    assert [got["b"][k] for k in ("paid_less", "paid_same", "paid_more", "unresolved")] == [1, 1, 0, 0]
    assert [got["c"][k] for k in ("paid_less", "paid_same", "paid_more", "unresolved")] == [1, 0, 1, 0]


def test_month_pruning(spark, tmp_path):
    from tidemark.operators import sinks

    path = str(tmp_path / "obs")
    sinks.write_observations(observed(spark, o1=OFFER), path)
    rows = sinks.read_observations(spark, path, AS_OF - timedelta(days=30), AS_OF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(obs_month" in plan and "PushedFilters: [IsNotNull(observed_at)" in plan
    assert rows.count() == 7 and sinks.read_observations(spark, path).count() == len(OFFER)
