"""What several corpus operators share: tables, shared scratch tables, Arrow text access and connected components."""

from __future__ import annotations

import functools
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; one text longer than this is handled alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a local one is made only in plain local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def forget(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that no live plan reads any more."""
    for df in tables:
        files, at = _folder(df.sparkSession, df._written)
        files.delete(at, True)


def held_out(doc_id: str = "doc_id"):
    """The fold rule of the labelled queries: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.concatenate([[0], np.cumsum(size)[:-1]]) // limit if len(size) else np.zeros(0, np.int64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@functools.cache
def categories() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 if it is a mark, else 0."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(p))[0], 0) for p in range(0x110000)], np.int8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column end to end, and where each begins (one more entry: the end). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data = column.buffers()[2]
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``utf8``, in code points."""
    data, starts = utf8(column)
    if not len(data):
        return np.zeros(0, np.uint32), starts
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, first[starts]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node that has a link.

    Alternating large-star and small-star rounds; each ends in a written table. A hub's edges meet only in a join of written
    tables, which adaptive execution splits, and in minima, which are combined before the shuffle; the small-star's groups are
    by the larger end, which is no hub any more. No row with nulls or a = b counts.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        forget(old, least)
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last = tuple(row)
