"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

Each table hashes a vector several times: three rounds of random signs and a fast Hadamard transform, then the nearest
vertex of the cross-polytope (the largest coordinate and its sign). A vector sits in the bucket of its nearest vertices and
also looks into the buckets of its next best choices. What shares a bucket is a candidate pair; the cosine of each is then
computed in double precision. A pair that meets several times counts once: in the first table, and there in the lesser
bucket.

The number of vertices that name a bucket grows with the logarithm of the rows, so that a vector meets about as many
unrelated ones at any size; the number of tables grows with the vertices, so that few near pairs are missed.

Only ids and bucket numbers are dealt to find who meets whom; vectors are fetched for those that meet somebody. Buckets
larger than a block are split into blocks, and each pair of blocks is a unit of its own; a unit emits counts and a tree of
its links, never the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.llm.common import components, forget, table, written
from tidemark.llm.ngram_join import block_pairs, grouped, tree

THRESHOLD = 0.98
#: Buckets of each table that a vector is looked up in, its own included.
PROBES = 4
#: Unrelated vectors that one meets in all tables together, about.
CHANCE = 0.5
#: Bits of a bucket's number: its vertices at most, and its table.
VERTEX_BITS, TABLE_BITS = 42, 6
#: Vectors of a block at most, and bytes of their components.
BLOCK, BLOCK_BYTES = 512, 4 << 20


def plan(rows: int, length: int) -> tuple[int, list[int]]:
    """Tables, and the bits of each vertex, for a label of ``rows`` vectors of ``length`` components.

    A vertex of b bits is the nearest of the 2^b signed axes of the first 2^(b - 1) coordinates after a rotation.
    """
    full = 1 + max(1, (length - 1).bit_length())
    bits: list[int] = []
    while True:
        tables = 2 * max(2, len(bits))
        need = min(VERTEX_BITS, ceil(log2(max(2.0, rows * 2.0 * PROBES * tables / CHANCE))))
        if sum(bits) >= need - 1 and len(bits) > 1:
            return tables, bits
        left = need - sum(bits)
        bits.append(max(1, min(full, left if bits else (left + 1) // 2 if left <= full else left)))


def _signs(table_: int, vertex: int, turn: int, size: int) -> np.ndarray:
    seed = np.random.default_rng([20, table_, vertex, turn])
    return seed.integers(0, 2, size) * 2.0 - 1.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def buckets(x: np.ndarray, tables: int, bits: list[int]) -> np.ndarray:
    """(rows, tables, PROBES) bucket numbers of unit vectors; the first is the bucket that the vector sits in."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    out = np.zeros((len(x), tables, PROBES), np.int64)
    rows = np.arange(len(x))
    # choices: each vertex's best or second best, cheapest sum of squared losses first
    choice = np.array([[c >> v & 1 for v in range(len(bits))] for c in range(1 << len(bits))])
    for t in range(tables):
        best, lost = [], []
        for v, b in enumerate(bits):
            y = x
            for turn in range(3):
                y = hadamard(y * _signs(t, v, turn, size))
            both = np.concatenate([y[:, : 1 << (b - 1)], -y[:, : 1 << (b - 1)]], 1)
            top = np.argpartition(-both, 1, axis=1)[:, :2]
            value = np.take_along_axis(both, top, 1)
            swap = (value[:, 1] > value[:, 0]) | ((value[:, 1] == value[:, 0]) & (top[:, 1] < top[:, 0]))
            top[swap], value[swap] = top[swap][:, ::-1], value[swap][:, ::-1]
            best.append(top)
            lost.append(value[:, 0] - value[:, 1])
        cost = sum(choice[:, v] * lost[v][:, None] ** 2 for v in range(len(bits)))
        order = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        for p in range(PROBES):
            name = np.zeros(len(x), np.int64)
            for v, b in enumerate(bits):
                name = (name << b) + best[v][rows, choice[order[:, p], v]]
            out[:, t, p] = (name << TABLE_BITS) + t
    return out


def _usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: indices, components and unit vectors in double precision of the vectors that can link."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(size[size > 0]).tolist():
        index = np.flatnonzero(size == d)
        values = column.take(pa.array(index)).flatten()
        ok = ~values.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(1)
        raw = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).reshape(-1, d)
        with np.errstate(all="ignore"):
            most = np.abs(raw).max(1).astype(np.float64)
        ok &= np.isfinite(most) & (most > 0)
        index, raw = index[ok], np.ascontiguousarray(raw[ok])
        if len(index):
            yield index, raw, _unit(raw)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _label_bits(label: str, length: int) -> int:
    """What parts the labels and lengths in a bucket's number; those that share it are told apart when pairs are checked."""
    code = hashlib.blake2b(f"{length}|{label}".encode(), digest_size=2).digest()
    return int.from_bytes(code, "little", signed=True) << (VERTEX_BITS + TABLE_BITS)


def hashed(vectors: DataFrame, rows: int) -> DataFrame:
    """vec_id, label, same (of label and unit vector), raw (components as binary) and codes (bucket numbers, PROBES for each
    table) of the vectors that can link. ``rows`` is the size of the largest label, or more."""
    names = ["vec_id", "label", "same", "raw", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                for index, raw, x in _usable(batch.column("embedding")):
                    part = batch.take(pa.array(index)).select(["vec_id", "label"])
                    labels, d = part.column("label").to_pylist(), x.shape[1]
                    code = buckets(x, *plan(rows, d)).reshape(len(x), -1) + np.array([_label_bits(v, d) for v in labels])[:, None]
                    same = [hashlib.blake2b(f"{len(v)}|{v}|".encode() + u.tobytes(), digest_size=16).digest() for u, v in zip(x, labels)]
                    ends = np.arange(len(x) + 1, dtype=np.int32) * code.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(same, pa.binary()), pa.array([r.tobytes() for r in raw], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(code.ravel()))], names
                    )

    return vectors.mapInArrow(run, "vec_id long, label string, same binary, raw binary, codes array<long>")


def _meet(codes: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: int) -> np.ndarray:
    """Whether pairs that meet in ``bucket`` meet there first: in no earlier table, and in this one in no lesser bucket."""
    at = bucket & ((1 << TABLE_BITS) - 1)
    first = np.ones(len(i), bool)
    for t in range(at):
        first &= ~((codes[i, t, :1] == codes[j, t]) | (codes[j, t, :1] == codes[i, t])).any(1)
    most = np.iinfo(np.int64).max
    of_i = np.where((codes[i, at, :1] == codes[j, at]).any(1), codes[i, at, 0], most)
    of_j = np.where((codes[j, at, :1] == codes[i, at]).any(1), codes[j, at, 0], most)
    return first & (np.minimum(of_i, of_j) == bucket)


def _link(kind: type):
    names = ["vec_id", "top", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket", "__bi", "__bj"]):
            if group.num_rows < 2:
                continue
            every = np.array([f"{len(r)}|{v}" for r, v in zip(group.column("raw").to_pylist(), group.column("label").to_pylist())])
            for name in np.unique(every):  # nearly always one
                part = group if (every == name).all() else group.filter(pa.array(every == name))
                if part.num_rows > 1 and (made := unit(part)) is not None:
                    yield pa.RecordBatch.from_arrays(made, names)

    def unit(group: pa.Table) -> list[pa.Array] | None:
        ids, own = group.column("vec_id").to_numpy(), group.column("__own").to_numpy()
        bucket, bi, bj = (group.column(c)[0].as_py() for c in ("bucket", "__bi", "__bj"))
        units = _unit(np.frombuffer(b"".join(group.column("raw").to_pylist()), kind).reshape(len(ids), -1))
        x, y = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        near = units[x] @ units[y].T >= THRESHOLD
        i, j = np.nonzero(np.triu(near, 1) if bi == bj else near)
        i, j = x[i], y[j]
        if len(i):
            codes = pc.list_flatten(group.column("codes")).to_numpy().reshape(len(ids), -1, PROBES)
            first = _meet(codes, i, j, bucket)
            i, j = i[first], j[first]
        if not len(i):
            return None
        copies = group.column("copies").to_numpy()
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        top = ids.copy()
        a, b = tree(ids, i, j)
        order = np.argsort(ids, kind="stable")
        top[order[np.searchsorted(ids, a, sorter=order)]] = b
        some = np.flatnonzero(links)
        return [pa.array(ids[some]), pa.array(top[some]), pa.array(links[some].astype(np.int64))]

    return run


def link(vectors: DataFrame) -> DataFrame:
    """Every vector's links: vec_id, n_links (other vectors with the same label and a cosine of 0.98 or more),
    component_id, kept, n_copies (vectors that are equal after scaling to length one, itself included).

    A null label, a null, empty or zero vector and one with null or non-finite components link with nothing; so do vectors
    of different lengths. Rows repeated with the same id count once; of different ones, one with the least label and, of
    those, the least hash of its vector. Rows without an id are left out.
    """
    single = isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    vector: Column = F.col("embedding") if single else F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector)
    usable = rows.where("label is not null and embedding is not null")
    sizes = usable.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    most = max(1, sizes[0] or 0, (sizes[1] or 0) >> 16)
    codes = written(hashed(usable, most).withColumn("rid", F.monotonically_increasing_id()), "codes")
    member = codes.groupBy("vec_id").agg(F.min(F.struct("label", "same", "rid")).alias("m")).select("vec_id", "m.same", "m.rid")
    member = written(member, "members")
    head = F.min(F.struct("vec_id", "rid")).alias("h")
    classes = written(member.groupBy("same").agg(head, F.count("*").alias("copies")).select("same", F.col("h.vec_id").alias("class_id"), "h.rid", "copies"), "classes")
    probe = codes.select("rid", "codes").join(classes.select("rid"), "rid").select("rid", F.posexplode("codes").alias("at", "bucket"))
    probe = written(probe.select("rid", "bucket", (F.col("at") % PROBES == 0).alias("sits")), "probes")
    bytes_ = codes.agg(F.max(F.octet_length("raw"))).first()[0] or 1
    units = block_pairs(probe, ["bucket"], "rid", max(16, min(BLOCK, BLOCK_BYTES // bytes_)), where=F.max("sits")).drop("sits")
    info = codes.select("rid", "label", "raw", "codes").join(classes.select("rid", F.col("class_id").alias("vec_id"), "copies"), "rid")
    tasks = units.join(info, "rid").drop("rid").repartition("bucket", "__bi", "__bj").sortWithinPartitions("bucket", "__bi", "__bj")
    found = written(tasks.mapInArrow(_link(np.float32 if single else np.float64), "vec_id long, top long, links long"), "links")
    forget(probe, codes)
    sums = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "class_id")
    whole = components(found.select("vec_id", "top"), "vec_id", "top").withColumnRenamed("node", "class_id")
    info = classes.select("same", "class_id", "copies").join(sums, "class_id", "left").join(whole, "class_id", "left")
    linked = member.join(info, "same").select("vec_id", "class_id", "copies", "links", "component")
    own = F.coalesce("component", "class_id", "vec_id")
    return rows.select("vec_id").distinct().join(linked, "vec_id", "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        own.alias("component_id"),
        (own == F.col("vec_id")).alias("kept"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
