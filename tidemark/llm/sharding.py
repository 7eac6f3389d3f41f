"""Sharding by jump consistent hashing: a key and the shard count decide the shard, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: The multiplier of the published generator and those of a 64-bit finaliser.
JUMP = np.uint64(2862933555777941757)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Parts of a shard that number their rows independently.
PARTS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. Keys that stay below a shard count keep their shard when shards are appended."""
    if shards < 1:
        raise ValueError("a shard count of 1 or more is needed")
    k = keys.astype(np.uint64)
    k = (k ^ (k >> np.uint64(30))) * MIX[0]
    k = (k ^ (k >> np.uint64(27))) * MIX[1]
    k ^= k >> np.uint64(31)
    at, nxt = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    live = np.arange(len(k))
    while len(live):
        at[live] = nxt[live]
        k[live] = k[live] * JUMP + np.uint64(1)
        r = ((k[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        nxt[live] = ((at[live] + 1) * (float(1 << 31) / r)).astype(np.int64)
        live = live[nxt[live] < shards]
    return at.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of ``jump``; a null key has shard 0. Only the key goes to Python."""

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), shards))

    return shard(F.coalesce(key.cast("long"), F.lit(0)))


def shard_rows(rows: DataFrame, key: str, shards: int, parts: int = PARTS) -> DataFrame:
    """``rows`` with shard, slot (gapless from 0 in its shard) and grown_shard (with one more shard).

    Rows are numbered inside each of ``parts`` hash parts of a shard; the parts' offsets are sums over at most
    shards x parts counts. Rows with the same key share a shard and get slots of their own; a null key counts as 0 for
    the shard. Columns of ``rows`` with the names of new ones are replaced; text should be dropped before.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot", "grown_shard")]
    light = rows.select(
        *names, jump_shard(F.col(key), shards).alias("shard"), jump_shard(F.col(key), shards + 1).alias("grown_shard")
    ).withColumn("__part", F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int"))
    light = written(light, "shards")
    counts = light.groupBy("shard", "__part").count()
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("shard", "__part").orderBy(*(F.col(c) for c in names))
    numbered = light.withColumn("__row", F.row_number().over(inside))
    # offsets: at most shards x parts rows
    joined = numbered.join(F.broadcast(offsets), ["shard", "__part"])
    return joined.select(*names, "shard", (F.col("__row") - 1 + F.col("__offset")).cast("long").alias("slot"), "grown_shard")


def op7(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents over shards 0 to 7 by their id. Null text: size 1 and the checksum of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shard_rows(rows, "doc_id", shards)
