"""Synthetic price years for offers that have none: deterministic by seed and offer, labelled as synthetic."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seasons (first and last month-day), how many offers join one, and the rates and ranges of the year's events.
SEASONS = (((11, 24), (12, 1)), ((7, 8), (7, 14)))
JOIN, CHANGED_LIST, STOCK_OUT = 0.7, 0.25, 0.004


def year(offer_id: int, anchor: int, first: date, days: int, seed: int) -> pd.DataFrame:
    """day, price_cents, in_stock of one offer: sales of 3 to 14 days, seasons, stock-outs of 3 to 21 days, perhaps an earlier list price."""
    r = np.random.default_rng([seed & 0xFFFFFFFF, offer_id & 0xFFFFFFFFFFFF])
    anchor = max(100, anchor)
    base = np.full(days, anchor)
    if r.random() < CHANGED_LIST and days:
        earlier = round(anchor * r.uniform(0.85, 1.15) / 100) * 100
        base[: int(r.integers(0, max(1, int(days * 0.7))))] = max(100, earlier if anchor % 100 == 0 else earlier - 100 + anchor % 100)

    def spells(rate: float, low: int, high: int) -> list[tuple[int, int]]:
        out, at = [], 0
        while (at := at + int(r.geometric(rate)) - 1) < days:
            size = int(r.integers(low, high + 1))
            out.append((at, at + size))
            at += size
        return out

    off = np.zeros(days)
    for a, b in spells(r.integers(3, 10) / 365, 3, 14):
        off[a:b] = r.uniform(0.10, 0.30)
    dates = [first + timedelta(days=d) for d in range(days)]
    for begin, end in SEASONS:
        if r.random() < JOIN:
            inside = np.array([begin <= (d.month, d.day) <= end for d in dates], bool)
            off = np.where(inside, np.maximum(off, r.uniform(0.15, 0.25)), off)
    stock = np.ones(days, bool)
    for a, b in spells(STOCK_OUT, 3, 21):
        stock[a:b] = False
    price = np.where(off > 0, np.floor(base * (1 - off) / 100) * 100, base)
    return pd.DataFrame({"day": dates, "price_cents": np.maximum(100, price).astype(int), "in_stock": stock})


def backfill(anchors: DataFrame, first: date, days: int, seed: int) -> DataFrame:
    """offer_id, day, price_cents, in_stock for every (offer_id, anchor_cents); offers are independent of each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                yield year(int(r.offer_id), int(r.anchor_cents), first, days, seed).assign(offer_id=r.offer_id)[["offer_id", "day", "price_cents", "in_stock"]]

    return anchors.select("offer_id", "anchor_cents").mapInPandas(run, "offer_id long, day date, price_cents int, in_stock boolean")


def missing(observations: DataFrame) -> DataFrame:
    """Offers without a synthetic row, with their first observed price."""
    first = observations.where(~F.col("synthetic")).groupBy("offer_id").agg(F.min_by("price_cents", "observed_at").alias("anchor_cents"))
    return first.join(observations.where("synthetic").select("offer_id").distinct(), "offer_id", "left_anti")
