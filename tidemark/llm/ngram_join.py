"""Similarity join of documents by the Jaccard similarity of their word n-grams, with Bayesian candidate pruning.

1. Texts with equal sets of n-grams form a class; one document stands for each.
2. Each text's n-grams are minhashed. Bands of the signature deal texts into buckets.
3. Inside a bucket, pairs compare their MinHash values a few at a time. After each step the posterior of the similarity
   (uniform prior, so a beta distribution) tells the chance that the pair reaches the threshold; below a tolerance it is
   dropped. What is left only has to tell which texts hang together: a bucket emits a tree, never its pairs.
4. Texts that hang together meet once, with their n-grams; pairs are pruned in the same way, the rest is verified exactly.

A bucket or a group larger than a block, in rows or in bytes of text, is split into blocks and each pair of blocks is a
task's unit of its own, so no task holds a whole large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, forget, slices, table, written

WORDS, THRESHOLD = 5, (4, 5)
#: Bands and rows of each; at the threshold a pair misses all bands with a chance of (1 - 0.8^4)^24, 3e-6.
BANDS, ROWS = 24, 4
#: MinHash values compared in a step, and the posterior chance below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Rows of a block at most, and bytes of its texts, about.
BLOCK, BLOCK_BYTES = 512, 4 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SIZE = BANDS * ROWS
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SALTS = _mix(np.arange(1, 2 * _SIZE + 1, dtype=np.uint64) * _MUL)
_A, _B = _SALTS[:_SIZE] | np.uint64(1), _SALTS[_SIZE:]


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            base = 0x5851F42D4C957F2D
            size = max(n + 1, 1 << 21)
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(size, base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(size, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' n-grams end to end, and where each text's begin (one more entry: the end).

    Words are what white space parts, in lower case. A text of fewer words has one n-gram, all of them; one of none has none.
    """
    data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])]).astype(np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    up, down = _POWERS.upto(len(raw))
    solid = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    word = _mix((total[end] - total[begin]) * down[begin])
    doc = np.searchsorted(starts, begin, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    made = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    out = np.concatenate([[0], np.cumsum(made)])
    gram = np.zeros(out[-1], np.uint64)
    at = np.arange(out[-1]) - np.repeat(out[:-1], made) + np.repeat(first[:-1], made)
    left = np.repeat(first[1:], made) - at
    for i in range(words):
        there = left > i
        gram[there] = gram[there] * np.uint64(0x2545F4914F6CDD1D) + word[at[there] + i]
    return _mix(gram), out


def minhash(gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signatures, a row of 32-bit values for each text; texts without n-grams have zeros."""
    out = np.zeros((len(starts) - 1, _SIZE), np.uint32)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        at = starts[some]
        for k in range(_SIZE):
            out[some, k] = np.minimum.reduceat(gram * _A[k] + _B[k], at) >> np.uint64(32)
    return out


def least_matches(steps: int = _SIZE // STEP) -> list[int]:
    """For each step, the fewest matches so far with which a pair may still reach the threshold."""
    t = THRESHOLD[0] / THRESHOLD[1]
    out = []
    for s in range(1, steps + 1):
        n = s * STEP
        tail, m = 0.0, -1
        while tail < TOLERANCE:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


_LEAST = least_matches()


def survivors(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks of signatures that incremental comparison doesn't drop; each pair once if ``same``."""
    hits = np.zeros((len(x), len(y)), np.int16)
    for k in range(STEP):
        hits += x[:, k, None] == y[None, :, k]
    ok = hits >= _LEAST[0]
    i, j = np.nonzero(np.triu(ok, 1) if same else ok)
    seen = hits[i, j].astype(np.int32)
    for s in range(1, len(_LEAST)):
        if not len(i):
            break
        seen += (x[i, s * STEP : (s + 1) * STEP] == y[j, s * STEP : (s + 1) * STEP]).sum(1)
        keep = seen >= _LEAST[s]
        i, j, seen = i[keep], j[keep], seen[keep]
    return i, j


def tree(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) for all ids that the links (i, j) touch: a star for each set that hangs together."""
    root = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    a, b = rank[i], rank[j]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    touched = np.unique(np.concatenate([a, b])) if len(a) else np.zeros(0, np.int64)
    touched = touched[root[touched] != touched]
    return ids[order[touched]], ids[order[root[touched]]]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys; rows come sorted by them. Holds a group and a batch."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if rest is not None:
            part = pa.concat_tables([rest, part])
        if not part.num_rows:
            continue
        change = np.zeros(part.num_rows - 1, bool)
        for k in keys:
            v = part.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield part.slice(a, b - a)
        rest = part.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def block_pairs(rows: DataFrame, keys: list[str], member: str, block: int = BLOCK, size: Column | None = None, where: Column | None = None) -> DataFrame:
    """``rows`` with __own, __bi and __bj: groups by ``keys`` of more than ``block`` rows, or of more than BLOCK_BYTES by ``size``,
    are split, each row goes to every pair of its block.

    Groups of one row are left out, and those for which the aggregate ``where`` is false. Only counts are joined to rows, in
    a join of written tables that adaptive execution can split.
    """
    names = rows.columns
    found = [F.count("*").alias("__n"), F.sum(F.lit(0) if size is None else size).alias("__bytes"), (F.lit(True) if where is None else where).alias("__ok")]
    blocks = F.ceil(F.greatest(F.col("__n") / block, F.col("__bytes") / BLOCK_BYTES)).cast("int").alias("__blocks")
    sizes = written(rows.groupBy(*keys).agg(*found).where("__n > 1 and __ok").select(*keys, blocks), "sizes")
    rows = rows.join(sizes, keys).withColumn("__own", F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return rows.select(*names, "__own", F.least("__own", "__other").alias("__bi"), F.greatest("__own", "__other").alias("__bj"))


def set_hash(grams: np.ndarray) -> bytes:
    """128 bits that decide a set of n-grams, whatever their order and number of times."""
    some = np.unique(grams)
    return np.array([_mix(some + _SALTS[0]).sum(), _mix(some * _A[1] + _SALTS[1]).sum()], np.uint64).tobytes() + len(some).to_bytes(4, "little")


def bands(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        key = _mix(key * _MUL + sig.reshape(-1, BANDS, ROWS)[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark (the text's MD5), same (the class of equal n-gram sets), sig (16 bits of each MinHash value as binary) and
    the bands' buckets; the last three are null if the text has no word."""
    names = ["doc_id", "mark", "same", "sig", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                gram, starts = shingles(part.column("text").to_pylist())
                sig, some = minhash(gram, starts), np.diff(starts) > 0
                same = [set_hash(gram[a:b]) if b > a else None for a, b in zip(starts, starts[1:])]
                short = [s.tobytes() if n else None for s, n in zip(sig.astype(np.uint16), some)]
                keys = [k if n else None for k, n in zip(bands(sig), some)]
                made = [pa.array(same, pa.binary()), pa.array(short, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *made], names)

    rows = docs.select("doc_id", _mark().alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark binary, same binary, sig binary, buckets array<long>")


def _mark() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _short(column: pa.ChunkedArray) -> np.ndarray:
    """Signatures of which 16 bits of each value are compared."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(column.length(), _SIZE)


def _hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, tops = [], []
    held = 0
    for group in grouped(batches, ["bucket", "__bi", "__bj"]):
        if group.num_rows < 2:
            continue
        ids, own, sig = group.column("doc_id").to_numpy(), group.column("__own").to_numpy(), _short(group.column("sig"))
        if len(ids) == 2:
            # most buckets
            seen = np.cumsum(sig[0] == sig[1])[STEP - 1 :: STEP]
            if own[0] == own[1] and (seen < _LEAST).any():
                continue
        bi, bj = group.column("__bi")[0].as_py(), group.column("__bj")[0].as_py()
        x, y = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        i, j = survivors(sig[x], sig[y], bi == bj)
        a, b = tree(ids, x[i], y[j])
        nodes.append(a)
        tops.append(b)
        held += len(a)
        if held > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(tops))], ["a", "b"])
            nodes, tops, held = [], [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(tops))], ["a", "b"])


def common(gram: np.ndarray, starts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of n-grams that texts x[k] and y[k] share. ``gram`` has no text's n-gram twice."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    _, number, times = np.unique(gram, return_inverse=True, return_counts=True)
    several = times[number] > 1
    owner, number = owner[several], number[several]
    _, number = np.unique(number, return_inverse=True)
    out = np.zeros(len(x), np.int64)
    texts, width = len(starts) - 1, int(number.max()) + 1 if len(number) else 0
    if len(x) <= 4:
        for k, (a, b) in enumerate(zip(x, y)):
            out[k] = len(np.intersect1d(number[owner == a], number[owner == b], assume_unique=True))
        return out
    piece = max(256, (1 << 22) // max(texts, 1))
    rank = np.argsort(number, kind="stable")
    number, owner = number[rank], owner[rank]
    whole = np.zeros((texts, texts), np.float32)
    for a in range(0, width, piece):
        lo, hi = np.searchsorted(number, [a, a + piece])
        there = np.zeros((texts, piece), np.float32)
        there[owner[lo:hi], number[lo:hi] - a] = 1
        whole += there @ there.T
    return whole[x, y].astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in grouped(batches, ["component", "__bi", "__bj"]):
        ids, own, sig = group.column("doc_id").to_numpy(), group.column("__own").to_numpy(), _short(group.column("sig"))
        copies = group.column("copies").to_numpy()
        bi, bj = group.column("__bi")[0].as_py(), group.column("__bj")[0].as_py()
        x, y = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        i, j = survivors(sig[x], sig[y], bi == bj)
        i, j = x[i], y[j]
        if not len(i):
            continue
        gram, starts = shingles(group.column("text").to_pylist())
        sets = [np.unique(gram[a:b]) for a, b in zip(starts, starts[1:])]
        size = np.array([len(s) for s in sets])
        shared = common(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), i, j)
        up, down = THRESHOLD
        ok = shared * down >= (size[i] + size[j] - shared) * up
        i, j = i[ok], j[ok]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        texts = np.bincount(np.concatenate([i, j]), minlength=len(ids))
        top = ids.copy()
        a, b = tree(ids, i, j)
        where = {n: k for k, n in enumerate(ids.tolist())}
        for n, t in zip(a.tolist(), b.tolist()):
            top[where[n]] = t
        some = np.flatnonzero(texts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(top[some]), pa.array(links[some].astype(np.int64)), pa.array(texts[some].astype(np.int64))], ["doc_id", "top", "links", "texts"])


def join(docs: DataFrame, with_mark: bool = False) -> DataFrame:
    """Every document's links. doc_id, class_id (least id with the same set of n-grams), n_copies (of that set), n_links (documents
    with a similarity of 0.8 or more, copies included), n_linked_texts (different sets of them), component_id, kept; with
    ``with_mark`` also mark, the MD5 of the text that counts for the id.

    Texts without a word (null, empty, white space) link with nothing, not even with copies: class_id is their own id. Rows
    repeated with the same id count once, of different texts the one with the least n-gram hash, then the least MD5; a text
    without a word counts only if the id has no other. Rows without an id are left out.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    sigs = written(signatures(docs).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    worded = sigs.where("sig is not null")
    rows = written(worded.groupBy("doc_id").agg(F.min(F.struct("same", "mark", "rid")).alias("r")).select("doc_id", "r.*"), "rows")
    head = F.min(F.struct("doc_id", "mark", "rid")).alias("h")
    classes = written(rows.groupBy("same").agg(head, F.count("*").alias("copies")).select("same", F.col("h.doc_id").alias("class_id"), F.col("h.mark").alias("is"), "h.rid", "copies"), "classes")
    members = worded.select("rid", "buckets").join(classes.select("rid", F.col("class_id").alias("doc_id")), "rid")
    members = written(members.select("doc_id", F.explode(F.array_distinct("buckets")).alias("bucket")), "buckets")
    heads = worded.select("rid", "sig").join(classes.select("rid", F.col("class_id").alias("doc_id"), "copies", "is"), "rid")
    heads = written(heads.drop("rid"), "heads")
    tasks = block_pairs(members, ["bucket"], "doc_id").join(heads.select("doc_id", "sig"), "doc_id")
    tasks = tasks.repartition("bucket", "__bi", "__bj").sortWithinPartitions("bucket", "__bi", "__bj")
    near = components(tasks.mapInArrow(_hang, "a long, b long"), "a", "b").withColumnRenamed("node", "doc_id")
    near = near.join(heads, "doc_id")
    near = docs.join(near, "doc_id").where(_mark() == F.col("is"))
    near = near.dropDuplicates(["doc_id"]).select("doc_id", "component", "copies", "sig", "text")
    near = written(near, "near")
    full = block_pairs(near, ["component"], "doc_id", size=F.octet_length("text"))
    full = full.repartition("component", "__bi", "__bj").sortWithinPartitions("component", "__bi", "__bj")
    found = written(full.mapInArrow(_verify, "doc_id long, top long, links long, texts long"), "links")
    forget(members, near, heads)
    sums = found.groupBy("doc_id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts")).withColumnRenamed("doc_id", "class_id")
    whole = components(found.select("doc_id", "top"), "doc_id", "top").withColumnRenamed("node", "class_id")
    info = classes.select("same", "class_id", "copies").join(sums, "class_id", "left").join(whole, "class_id", "left")
    every = rows.join(info, "same").select("doc_id", "mark", "class_id", "copies", "links", "texts", "component")
    blank = sigs.where("sig is null").groupBy("doc_id").agg(F.min("mark").alias("mark")).join(rows.select("doc_id"), "doc_id", "left_anti")
    blank = blank.select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), *(F.lit(None).cast("long").alias(c) for c in ("links", "texts", "component")))
    own = F.coalesce("component", "class_id")
    return every.unionByName(blank).select(
        "doc_id",
        "class_id",
        F.col("copies").alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts"),
        own.alias("component_id"),
        (own == F.col("doc_id")).alias("kept"),
        *["mark"] * with_mark,
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
