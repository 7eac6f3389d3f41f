from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import control, prices, serve, sinks
from tidemark.sources import config
from tidemark.streaming import observations as streaming

NOW = datetime(2030, 1, 1)


def test_config_tells_all_that_is_wrong(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("name: boards\nspec_schema:\n  layout: {type: string, enum: [a, b]}\n  keys: {type: integer}\nretailers:\n  - {name: x, enabled: false}\n  - {name: y}\nseed_products:\n  - {brand: k, model: q1, aliases: [q one], spec: {keys: 84}}\n")
    c = config.load(path)
    assert [r["name"] for r in c.enabled()] == ["y"] and config.seeds(spark, c).first().spec == {"keys": "84"}
    with pytest.raises(config.ConfigError) as e:
        config.check({"spec_schema": {"a": {"type": "odd"}}, "other": 1, "seed_products": [{"model": "m", "spec": {"z": 1}}, {"model": "m"}], "sentiment": {"positive": ["x"], "negative": ["x"]}}, "f")
    assert all(x in str(e.value) for x in ("unknown key other", "name is missing", "type must be", "spec field z", "stands twice", "both praise and complaint"))


def test_bodies_caches_and_months(spark, tmp_path):
    bodies = spark.createDataFrame([(1, "json", "a"), (1, "json", "a"), (2, "json", "a")], "run_id int, kind string, body string")
    assert sorted(r.name[:2] for r in sinks.stored_bodies(bodies).collect()) == ["1/", "2/"]
    cache = spark.createDataFrame([("a", "x", 200, NOW - timedelta(hours=25)), ("b", "y", 200, NOW)], "domain string, body string, status int, fetched_at timestamp")
    assert [r.domain for r in sinks.cached_robots(cache, NOW, 86_400).collect()] == ["b"]
    fresh = spark.createDataFrame([("a", "n\0ew", 200, NOW)], cache.schema)
    assert {r.domain: r.body for r in sinks.put_robots(cache, fresh).collect()} == {"a": "new", "b": "y"}
    rows = spark.createDataFrame([(1, NOW)], "offer_id long, observed_at timestamp")
    with pytest.raises(Exception, match="no partition for month 2030_01"):
        sinks.write_observations(rows, str(tmp_path / "o"), months={"2029_12"})


def test_queue(spark):
    limits = spark.createDataFrame([("a", NOW - timedelta(seconds=5)), ("b", NOW + timedelta(seconds=5))], "domain string, next_allowed_at timestamp")
    at = {r.domain: r.next_allowed_at for r in control.reserve(control.reserve(limits, "a", NOW, 5), "b", NOW, 5).collect()}
    assert at == {"a": NOW + timedelta(seconds=5), "b": NOW + timedelta(seconds=10)}
    tasks = spark.createDataFrame([(1, "leased", "me", NOW + timedelta(seconds=1)), (2, "leased", "me", NOW - timedelta(seconds=1)), (3, "queued", None, None)], "task_id int, state string, worker string, lease_until timestamp")
    until = {r.task_id: r.lease_until for r in control.heartbeat(tasks, "me", NOW, 60).collect()}
    assert until == {1: NOW + timedelta(seconds=60), 2: NOW - timedelta(seconds=1), 3: None}


def test_streams(spark, tmp_path):
    """Rollups kept by batches are those of all rows at once; a page that comes again changes nothing; state drops what is repeated."""
    schema = "offer_id long, observed_at timestamp, price_cents int, in_stock boolean, synthetic boolean"
    day = lambda k: NOW - timedelta(days=k)
    first = [(1, day(9), 100, True, False), (2, day(9), 50, True, False), (1, day(5), 80, True, False)]
    second = [(1, day(5), 10, True, False), (1, day(1), 100, True, False)]  # the first of them is a page fetched again
    folder, source = str(tmp_path / "t"), str(tmp_path / "in")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streaming.keep_rollups(stream, folder, str(tmp_path / "check"), lambda batch: NOW).awaitTermination()
    kept = {r.key: r for r in streaming.current_rollups(spark, folder).collect()}
    whole = spark.createDataFrame([*first, second[1]], schema)
    want = {r.key: r for r in prices.rollup_offers(whole, whole.select(F.col("offer_id").alias("key")).distinct(), NOW).collect()}
    assert {k: (r.current_price_cents, r.list_price_cents, r.min_365d, r.observations_365d) for k, r in kept.items()} == {k: (r.current_price_cents, r.list_price_cents, r.min_365d, r.observations_365d) for k, r in want.items()}
    stream = streaming.distinct_observations(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen").count() == 4
    assert streaming.recent(whole, "observed_at", 6, NOW).count() == 2


def test_laid_over_with_repeated_keys(spark):
    rows = spark.sql("select map('a', '1', 'b', '2') as under, map('b', '3', 'c', '4') as top union all select map(), map('x', '1') union all select map('x', '1'), map()")
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"
    assert [r[0] for r in rows.select(serve.laid_over(F.col("top"), F.col("under"))).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"x": "1"}, {"x": "1"}]
