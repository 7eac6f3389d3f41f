from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backfill, community, sinks
from tidemark.functions.text import normalize_ascii
from tidemark.sources.specs import keyboard_spec, spec_of


def test_synthetic_year():
    first, days = date(2029, 1, 1), 365
    a, b = (backfill.year(7, 9999, first, days, 1) for _ in range(2))
    assert a.equals(b) and len(a) == days and a.price_cents.min() >= 100
    assert backfill.year(8, 9999, first, 0, 1).empty
    years = [backfill.year(i, 10000, first, days, 1) for i in range(60)]
    on_sale = sum((y.price_cents <= 9000).mean() for y in years) / 60
    assert 0.02 < on_sale < 0.5 and all(y.price_cents.iloc[-1] <= 10000 for y in years)


def test_keyboard_spec(spark):
    rows = spark.createDataFrame([("keychron q1 75 silent linear hot swap pbt 84 keys wired",), ("tkl wired wireless bluetooth 2 4ghz",), ("",)], "t string")
    got = [r[0] for r in rows.select(keyboard_spec(F.col("t"))).collect()]
    assert got[0] == {"layout_size": "75", "switch_type": "silent-linear", "hot_swap": "true", "connectivity": "wired", "keycap_material": "pbt", "key_count": "84"}
    assert got[1] == {"layout_size": "tkl", "connectivity": "tri-mode"} and got[2] == {}


def test_monitor_spec(spark):
    titles = [
        ('27" UltraWide QHD 144Hz Curved Monitor', ["Gaming", "USB-C", None]),
        ("Dual 4K Mini-LED flat, 1800R", ["Screen Size: 57", "refresh rate 240hz", "HDR 1000"]),
        ("9000 hz speaker", ["12", "8"]),
        (None, None),
    ]
    rows = spark.createDataFrame(titles, "t string, tags array<string>")
    got = [r[0] for r in rows.select(spec_of("monitors", F.col("t"), F.col("tags"), normalize_ascii)).collect()]
    assert got[0] == {"resolution": "ultrawide-1440p", "aspect_ratio": "21:9", "refresh_hz": "144", "size_in": "27.0", "curved": "true", "usb_c": "true"}
    assert got[1] == {"panel_type": "mini-led", "resolution": "dual-4k", "aspect_ratio": "32:9", "refresh_hz": "240", "size_in": "57.0", "hdr": "hdr1000"}
    assert got[2] == {"size_in": "12.0", "speakers": "true"} and got[3] == {}


@pytest.mark.parametrize(("category", "most"), [("keyboards", 2), ("monitors", 2)])
def test_a_spec_normalises_its_texts_once(spark, category, most):
    """The title and the tags, once each for a row: not again for every phrase that is looked for."""
    rows = spark.createDataFrame([("x", ["y"])], "t string, tags array<string>")
    df = rows.withColumn("spec", spec_of(category, F.col("t"), F.col("tags"), normalize_ascii)).select(*(F.col("spec")[k] for k in ("a", "b", "c")))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= most


def _mentions(spark, *rows):
    return spark.createDataFrame([(i, 1, c, w, s, "auto", datetime(2030, 1, d)) for i, c, w, s, d in rows], "mention_id long, product_id long, community string, weight double, sentiment string, status string, posted_at timestamp")


@pytest.mark.parametrize(
    ("rows", "score", "leaning", "quotes"),
    [
        ([(1, "a", 1.0, "positive", 1), (2, "a", 1.0, "neutral", 2), (3, "b", 1.0, "neutral", 3), (4, "b", 1.0, "negative", 4)], 0.0, "mixed", [1, 4]),
        ([(1, "a", 3.0, "positive", 1), (2, "a", 1.0, "negative", 2)], 0.5, "liked", [1, 2]),
        ([(1, "a", 1.0, "positive", 1), (2, "a", 1.0, "positive", 5), (3, "a", 1.0, "negative", 2), (4, "a", 1.0, "neutral", 9)], 0.25, "liked", [2, 3]),
        ([(4, "a", 1.0, "neutral", 9), (5, "a", 1.0, "neutral", 8), (6, "a", 1.0, "neutral", 7)], 0.0, "mixed", [4, 5]),
    ],
)
def test_consensus(spark, rows, score, leaning, quotes):
    products = spark.createDataFrame([(1,), (2,)], "product_id long")
    got = {r.product_id: r for r in community.consensus(products, _mentions(spark, *rows), datetime(2029, 12, 1)).collect()}
    assert (got[1].score, got[1].leaning, got[1].quote_mention_ids) == (score, leaning, quotes)
    assert got[2].score is None and got[2].leaning == "unheard" and got[2].mention_count == 0 and got[2].quote_mention_ids == []


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, sku string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k int, v string, sku string")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()} == {(1, "a", "x"), (2, "c", None), (3, "d", "z")}
    assert {tuple(r) for r in sinks.merge(old, new, ["k"], kept=[], fallback=["sku"]).collect()} == {(1, "a", "x"), (2, "c", "y"), (3, "d", "z")}
    assert {tuple(r) for r in sinks.merge(old, new, ["k"], kept=["v"]).collect()} == {(1, "a", "x"), (2, "b", None), (3, "d", "z")}
    assert {tuple(r) for r in sinks.insert_if_absent(old, new, ["k"]).collect()} == {(1, "a", "x"), (2, "b", "y"), (3, "d", "z")}


def test_backfill_query_makes_the_year_before_the_data(spark, monkeypatch):
    from datetime import date, datetime

    from tidemark.plans import more

    rows = [(1, datetime(2001, 3, 5, 9), 5000, False), (1, datetime(2001, 4, 1), 100, False), (2, datetime(2001, 3, 7), 7000, False), (2, datetime(2001, 3, 6), 10, True)]
    monkeypatch.setattr(more.model, "observations", lambda s, d: spark.createDataFrame(rows, "offer_id long, observed_at timestamp, price_cents int, synthetic boolean"))
    made = more.backfilled(spark, "").collect()
    assert {r.offer_id for r in made} == {1} and len({r.day for r in made}) == len(made) == 365
    assert min(r.day for r in made) == date(2000, 3, 5) and max(r.day for r in made) == date(2001, 3, 4)
