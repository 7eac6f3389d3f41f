"""Price history: series, rollups of a trailing year as of an instant, and what hangs on them.

Observations have (offer_id, observed_at, price_cents, in_stock, synthetic); offers have (offer_id, product_id, status,
retired). A key is an offer or a product. Windows are half-open: later than as_of minus its days, up to as_of.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (7, 30, 90, 365)


def live(status: str = "status", retired: str = "retired") -> Column:
    """An offer that counts: linked by machine or person, and not retired."""
    return F.col(status).isin("auto", "reviewed") & ~F.col(retired)


def is_sale(price: Column, list_price: Column) -> Column:
    """At most nine tenths of the list price, in whole numbers."""
    return price.cast("long") * 10 <= list_price.cast("long") * 9


def within(observed: Column, as_of: Column, days: int) -> Column:
    return (observed > as_of - F.expr(f"interval {days} days")) & (observed <= as_of)


def trailing_year(observations: DataFrame, as_of: datetime) -> DataFrame:
    """The bounds are literals, so that they reach the scan."""
    return observations.where(within(F.col("observed_at"), F.lit(as_of), 365))


def insert_absent(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each (offer, instant).

    One or two whole numbers as the order (the second of 32 bits) become one decimal, so that rows of fixed width are combined by hash before the one
    shuffle; ties in it may mix their rows' columns, so the order must be unique there. Any other order is a struct, for which Spark sorts.
    """
    keys = ["offer_id", "observed_at"]
    rest = [c for c in rows.columns if c not in keys]
    types = dict(rows.dtypes)
    narrow = ("tinyint", "smallint", "int")
    if len(order) <= 2 and types[order[0]] in (*narrow, "bigint") and types[order[-1]] in (*narrow, *["bigint"] * (len(order) == 1)):
        wide = [F.col(c).cast("decimal(38,0)") for c in order]
        place = wide[0] if len(order) == 1 else (wide[0] * F.lit(10**10).cast("decimal(11,0)") + wide[1]).cast("decimal(38,0)")
        rows = rows.withColumn("__place", place)
        return rows.groupBy(*keys).agg(*(F.min_by(c, "__place").alias(c) for c in rest)).select(*(c for c in rows.columns if c != "__place"))
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return rows.groupBy(*keys).agg(first).select(*keys, "first.*").select(*rows.columns)


def offer_series(observations: DataFrame) -> DataFrame:
    """An offer's points, out of stock or not."""
    return observations.select(F.col("offer_id").alias("key"), "observed_at", "price_cents", "in_stock", "synthetic")


def product_series(observations: DataFrame, offers: DataFrame) -> DataFrame:
    """The cheapest price in stock among a product's live offers, for each instant that has one."""
    linked = offers.where(live()).select("offer_id", F.col("product_id").alias("key"))
    points = observations.where("in_stock").join(linked, "offer_id")
    return points.groupBy("key", "observed_at").agg(F.min("price_cents").alias("price_cents"), F.lit(True).alias("in_stock"), F.bool_or("synthetic").alias("synthetic"))


def latest(observations: DataFrame) -> DataFrame:
    """Each offer's newest observation."""
    newest = F.max_by(F.struct("observed_at", "price_cents", "in_stock"), "observed_at").alias("n")
    return observations.groupBy("offer_id").agg(newest).select("offer_id", "n.*")


def current_offers(observations: DataFrame) -> DataFrame:
    return latest(observations).select(F.col("offer_id").alias("key"), "price_cents", "observed_at", "in_stock", F.lit(None).cast("long").alias("offer_id"))


def current_products(observations: DataFrame, offers: DataFrame) -> DataFrame:
    """The best of a product's offers' newest observations: in stock first, then the cheapest, the newest, the least offer."""
    linked = offers.where(live()).select("offer_id", F.col("product_id").alias("key"))
    each = latest(observations).join(linked, "offer_id")
    best = F.struct((~F.col("in_stock")).alias("away"), "price_cents", (-F.unix_micros(F.col("observed_at").cast("timestamp"))).alias("age"), "offer_id")
    row = F.min_by(F.struct("price_cents", "observed_at", "in_stock", "offer_id"), best).alias("b")
    return each.groupBy("key").agg(row).select("key", "b.*")


def list_price(series: DataFrame) -> DataFrame:
    """The most common price; of equally common ones the higher."""
    return series.groupBy("key").agg(F.expr("mode() within group (order by price_cents desc)").alias("list_price_cents"))


def sales(series: DataFrame, listed: DataFrame) -> DataFrame:
    """Runs of sale prices, ended only by a price that is none: key, start_at, end_at, min_price_cents, off_pct, days."""
    flagged = series.join(listed, "key").withColumn("sale", is_sale(F.col("price_cents"), F.col("list_price_cents")))
    order = Window.partitionBy("key").orderBy("observed_at")
    begins = F.col("sale") & ~F.lag("sale", 1, False).over(order)
    stepped = flagged.withColumn("begins", begins.cast("int"))
    numbered = stepped.withColumn("sale_no", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.where("sale").groupBy("key", "sale_no").agg(
        F.min("observed_at").alias("start_at"),
        F.max("observed_at").alias("end_at"),
        F.min("price_cents").alias("min_price_cents"),
        F.count_distinct(F.to_date("observed_at")).alias("days"),
        F.max("list_price_cents").alias("list_price_cents"),
    )
    off = F.round(100 * (1 - F.col("min_price_cents").cast("decimal(20,10)") / F.col("list_price_cents"))).cast("int")
    return runs.select("key", "start_at", "end_at", "min_price_cents", off.alias("off_pct"), "days")


def sale_totals(runs: DataFrame) -> DataFrame:
    """Sales of each key, newest first, their days together, and when the last ended."""
    window = F.struct("start_at", "end_at", "min_price_cents", "off_pct", "days")
    return runs.groupBy("key").agg(
        F.reverse(F.array_sort(F.collect_list(window))).alias("sale_windows"),
        F.sum("days").alias("sale_days_365d"),
        F.max("end_at").alias("last_sale_ended_at"),
    )


def measures(series: DataFrame, current: DataFrame, as_of: datetime) -> DataFrame:
    """Least, median and greatest price of each window; share of points below the current price; variation; counts."""
    now = current.select("key", F.col("price_cents").alias("now_cents"))
    rows = series.join(now, "key", "left")
    found = []
    for days in WINDOWS:
        inside = "" if days == 365 else f" filter (where observed_at > timestamp_micros({_micros(as_of)}) - interval {days} days)"
        found += [
            F.expr(f"min(price_cents){inside}").alias(f"min_{days}d"),
            F.rint(F.expr(f"percentile_cont(0.5) within group (order by price_cents){inside}")).cast("int").alias(f"median_{days}d"),
            F.expr(f"max(price_cents){inside}").alias(f"max_{days}d"),
        ]
    below = F.when(F.max("now_cents").isNotNull(), F.count_if(F.col("price_cents") < F.col("now_cents")) / F.count("*"))
    spread = F.stddev_samp("price_cents") / F.nullif(F.avg("price_cents"), F.lit(0.0))
    return rows.groupBy("key").agg(*found, below.alias("percentile_365d"), spread.alias("volatility_365d"), F.count("*").alias("observations_365d"), F.count_if("synthetic").alias("synthetic_365d"))


def _micros(t: datetime) -> int:
    d = t - datetime(1970, 1, 1)
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def rollup(keys: DataFrame, series: DataFrame, current: DataFrame, as_of: datetime) -> DataFrame:
    """One row for each key of ``keys``, with nulls, zeros and no sales where it has no history."""
    listed = list_price(series)
    now = current.select(
        "key", F.col("price_cents").alias("current_price_cents"), F.col("observed_at").alias("current_observed_at"), F.col("in_stock").alias("current_in_stock"), F.col("offer_id").alias("current_offer_id")
    )
    whole = keys.select("key").join(now, "key", "left").join(listed, "key", "left").join(measures(series, current, as_of), "key", "left").join(sale_totals(sales(series, listed)), "key", "left")
    return whole.withColumns(
        {
            "as_of": F.lit(as_of),
            "observations_365d": F.coalesce("observations_365d", F.lit(0)),
            "synthetic_365d": F.coalesce("synthetic_365d", F.lit(0)),
            "sale_days_365d": F.coalesce("sale_days_365d", F.lit(0)),
            "sale_windows": F.coalesce("sale_windows", F.array().cast("array<struct<start_at:timestamp,end_at:timestamp,min_price_cents:int,off_pct:int,days:bigint>>")),
        }
    )


def rollup_offers(observations: DataFrame, keys: DataFrame, as_of: datetime) -> DataFrame:
    year = trailing_year(observations, as_of)
    return rollup(keys, offer_series(year), current_offers(year), as_of)


def rollup_products(observations: DataFrame, offers: DataFrame, keys: DataFrame, as_of: datetime) -> DataFrame:
    """Links and retirement count as they are now, not as of ``as_of``."""
    year = trailing_year(observations, as_of)
    return rollup(keys, product_series(year, offers), current_products(year, offers), as_of)


def retire_unseen(offers: DataFrame, runs: DataFrame, missed: int) -> DataFrame:
    """``offers`` with retired set where the last sighting precedes the ``missed``-th newest finished crawl; with fewer crawls nothing retires."""
    finished = runs.where("finished and kind = 'crawl'").orderBy(F.desc("started_at")).limit(missed)
    # at most one row
    cut = finished.agg(F.count("*").alias("n"), F.min("started_at").alias("cutoff")).where(F.col("n") == missed).select("cutoff")
    return offers.join(F.broadcast(cut), F.lit(True), "left").withColumn("retired", F.col("retired") | F.coalesce(F.col("last_seen") < F.col("cutoff"), F.lit(False))).drop("cutoff")


def daily_history(observations: DataFrame) -> DataFrame:
    day = F.to_date("observed_at").alias("day")
    cheapest = F.min(F.when(F.col("in_stock"), F.col("price_cents"))).alias("min_price_cents")
    return observations.groupBy("offer_id", day).agg(cheapest, F.bool_or("synthetic").alias("synthetic"), F.count("*").alias("observations"))


GRID = "key long, day date, current_price_cents int, current_in_stock boolean, current_offer_id long, list_price_cents int, min_365d int, median_365d int, max_365d int, percentile_365d double, sale_days_365d long, sale_windows_n long, last_sale_ended_at timestamp, observations_365d long, synthetic_365d long"


def asof_grid(observations: DataFrame, offers: DataFrame, first: date, last: date, days: int = 30) -> DataFrame:
    """What the deal rule reads of each product's rollup, as of the last microsecond of each day of the span: columns as GRID.

    A point of day d is visible on days d to d + 364 exactly. The span is dealt in stretches of ``days`` days, and a point goes to
    the stretches that see it, fourteen at most, so neither a product's whole history nor a row for each point and day is ever
    together. Days on which nothing of the year before is seen have no row.
    """
    linked = offers.where(live()).select("offer_id", F.col("product_id").alias("key"))
    number = F.datediff(F.to_date("observed_at"), F.lit(first))
    size = (last - first).days + 1
    points = observations.select("offer_id", "price_cents", "in_stock", "synthetic", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"), number.alias("d"))
    points = points.where((F.col("d") < size) & (F.col("d") > -365)).join(linked, "offer_id")
    begin, end = F.floor(F.greatest("d", F.lit(0)) / days), F.floor(F.least(F.col("d") + 364, F.lit(size - 1)) / days)
    dealt = points.withColumn("stretch", F.explode(F.sequence(begin, end)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "offer_id"])
        at, d, offer, price, stock = (group[c].to_numpy() for c in ("at", "d", "offer_id", "price_cents", "in_stock"))
        low = int(group.stretch.iloc[0]) * days
        # the series: the cheapest price in stock of each instant
        shown = group[group.in_stock].groupby("at", sort=True).agg(d=("d", "first"), price=("price_cents", "min"), made=("synthetic", "any"))
        sd, sp, made, when = shown.d.to_numpy(), shown.price.to_numpy().astype(np.int64), shown.made.to_numpy(bool), shown.index.to_numpy()
        out = []
        for day in range(low, min(low + days, size)):
            a, b = np.searchsorted(d, [day - 364, day + 1])
            if a == b:
                continue
            _, back = np.unique(offer[a:b][::-1], return_index=True)
            newest = b - 1 - back
            best = newest[np.lexsort((offer[newest], -at[newest], price[newest], ~stock[newest].astype(bool)))[0]]
            row = [first + timedelta(days=day), int(price[best]), bool(stock[best]), int(offer[best])]
            x, y = np.searchsorted(sd, [day - 364, day + 1])
            year = sp[x:y]
            if x == y:
                out.append((*row, None, None, None, None, None, 0, 0, None, 0, 0))
                continue
            value, count = np.unique(year, return_counts=True)
            listed = int(value[len(value) - 1 - count[::-1].argmax()])
            sale = year * 10 <= listed * 9
            begins = sale & ~np.concatenate([[False], sale[:-1]])
            fresh = np.concatenate([[True], sd[x + 1 : y] != sd[x : y - 1]])
            ended = pd.Timestamp(int(when[x + np.flatnonzero(sale)[-1]]), unit="us") if sale.any() else None
            out.append((*row, listed, int(year.min()), int(np.rint(np.median(year))), int(year.max()), float((year < price[best]).mean()), int((sale & (begins | fresh)).sum()), int(begins.sum()), ended, y - x, int(made[x:y].sum())))
        made_ = pd.DataFrame(out, columns=[c.split()[0] for c in GRID.split(", ")[1:]], dtype=object)
        made_.insert(0, "key", int(group.key.iloc[0]))
        return made_

    # few bytes but much work a group: partitions are not to be put together by their size
    parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "stretch").groupBy("key", "stretch").applyInPandas(run, GRID)
