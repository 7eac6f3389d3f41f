"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Piece lengths fall into classes: class j holds lengths in (C / (j + 1), C / j], and a bin of class j takes exactly j
pieces, so workers fill their bins without knowing of each other. A piece of class 1 is a bin of its own and never moves.
What workers have left over, fewer than j pieces of class j each, is filled by groups of workers, then by groups of groups.
Documents may be cut: full sequences are taken off first, then pieces that fill their class exactly, so that the rest is
placed with a few tokens of waste.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, written

CAPACITY = 2048
#: Classes; the last takes all shorter pieces too.
CLASSES = 64
#: Tokens by which a document's last piece may fall short of its class.
SLACK = 16
#: Pieces that one worker packs on its own, about, and workers of a group.
WORKER_PIECES, GROUP = 100_000, 16
#: The id after each document's own.
END = 1
#: Words of a generation whose ids a Python worker remembers.
REMEMBERED = 200_000


#: A word of Latin letters, perhaps with punctuation after it: it is normalised and split in a known way.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")


class _Known(dict):
    """Ids of words; ``learn`` works out what is not there, and stores it as it sees fit."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        return self.learn(word)


class WordTokenizer:
    """Ids of texts by a public tokenizer file whose words, as white space parts them, do not affect each other.

    Words are tokenised once and remembered in two generations: what the last ones used stays. Plain words go to the
    tokenizer's model at once, in the form that its normalizer and splitter would give them; all others go through the whole
    tokenizer, and so does a text with a marker of special tokens or with a sign that only one of the two takes for white space.
    """

    #: The separators that Python parts words at and the tokenizer doesn't, and the beginning of a special token.
    UNLIKE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        # bytes as the byte-level splitter writes them
        self.bytes = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(hidden)})
        self.known, self.older = _Known(self._word), {}
        self.ends: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _end(self, signs: str) -> bytes:
        ids = self.ends.get(signs)
        if ids is None:
            if len(self.ends) > REMEMBERED // 10:
                self.ends.clear()
            ids = self.ends[signs] = self._piece(signs)
        return ids

    def _word(self, word: str) -> bytes:
        known = self.known
        ids = self.older.get(word)
        if ids is not None:
            known[word] = ids
            return ids
        if word.isascii() and word.isalpha():
            low, end = word.lower(), b""
        elif m := _PLAIN.match(word):
            low, end = m[1].lower(), m[2] and self._end(m[2]) or b""
        else:
            ids = known[word] = array("I", self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()
            return ids
        ids = known.get(low)
        if ids is not None:
            ids = known[word] = ids + end
            return ids
        # new letters are stored alone: most never come again, and what else is written with them is put together from them
        ids = known[low] = self.older.get(low) or self._piece(low)
        return ids + end

    def _text(self, text: str) -> bytes:
        if any(x in text for x in self.UNLIKE):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, _Known(self._word)
        return b"".join(map(self.known.__getitem__, text.split()))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self._text(t), "<u4") for t in texts]


@functools.lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, whose words outlive a task."""
    return WordTokenizer(path)


def cuts(length: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: int = SLACK) -> list[int]:
    """Lengths of a document's pieces: full ones, then ones that fill their class exactly until the rest nearly does."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        grade = min(classes, capacity // rest)
        if grade == classes or capacity // grade - rest <= slack:
            pieces.append(rest)
            break
        pieces.append(capacity // (grade + 1))
        rest -= pieces[-1]
    return pieces


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, and ids as little-endian 32-bit binary if asked for).

    ``docs`` has doc_id and text; a null text is empty and has the end id alone. Other columns are dropped.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer)
        end = np.array([END], "<u4")
        for batch in batches:
            for part in slices(batch):
                columns: list[list] = [[] for _ in names]
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts)):
                    ids = np.concatenate([ids, end])
                    at = 0
                    for size in cuts(len(ids), capacity):
                        raw = ids[at : at + size].tobytes()
                        for column, value in zip(columns, (doc, at, size, zlib.crc32(raw), len(ids), raw)):
                            column.append(value)
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _first_fit(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        room, bins, offsets = [], [], []
        for size in pieces.length:
            at = next((i for i, r in enumerate(room) if r >= size), len(room))
            if at == len(room):
                room.append(capacity)
            bins.append(at)
            offsets.append(capacity - room[at])
            room[at] -= size
        return pieces.assign(__bin=bins, offset=offsets)

    return run


def harmonic_pack(pieces: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, worker_pieces: int = WORKER_PIECES) -> DataFrame:
    """``pieces`` (with doc_id, start, length) plus sequence_id and offset.

    Workers fill whole bins of each class; what they have left over (fewer than j pieces of class j each) is dealt to a worker
    of the next level for every ``GROUP``, and so on; what the last one leaves (fewer than j pieces of class j in all) is packed
    by first fit, longest first. Pieces longer than the capacity are an error. Rows with equal keys are separate pieces.
    """
    names = pieces.columns
    size = F.col("length")
    grade = F.least(F.lit(classes), F.floor(F.lit(capacity) / size)).cast("int")
    checked = F.when(size.between(1, capacity), grade).otherwise(F.raise_error(F.lit("a piece's length is not in 1..capacity")).cast("int"))
    rows = written(pieces.withColumn("__class", checked).withColumn("__rid", F.monotonically_increasing_id()), "pieces")
    shared = rows.where("__class > 1")
    workers = [max(1, -(-shared.count() // worker_pieces))]
    while workers[-1] > 1:
        workers.append(-(-workers[-1] // GROUP))
    order = [F.col(c) for c in ("doc_id", "start", "__rid")]
    dealt = ["__worker", "__class"]

    def fill(level: DataFrame) -> DataFrame:
        inside = Window.partitionBy(*dealt)
        level = level.withColumn("__bin", F.floor((F.row_number().over(inside.orderBy(*order)) - 1) / F.col("__class")).cast("long"))
        return level.withColumn("__full", (F.col("__bin") + 1) * F.col("__class") <= F.count("*").over(inside))

    def placed(level: DataFrame) -> DataFrame:
        before = Window.partitionBy(*dealt, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return level.where("__full").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))

    # numbers never meet: a single piece's is odd; level, worker, class and bin decide any other
    many = sum(workers) + 1

    def number(worker: Column) -> Column:
        return (2 * ((F.col("__bin") * F.lit(many) + worker) * F.lit(classes + 1) + F.col("__class"))).cast("long")

    done = [rows.where("__class = 1").withColumns({"sequence_id": 2 * F.col("__rid") + 1, "offset": F.lit(0).cast("long")})]
    level, base = shared.withColumn("__worker", F.pmod(F.xxhash64("doc_id", "start", "__rid"), F.lit(workers[0])).cast("int")), 0
    for k, n in enumerate(workers):
        filled = fill(level)
        done.append(placed(filled).withColumn("sequence_id", number(F.col("__worker") + base)))
        left = filled.where("not __full").drop("__bin", "__full")
        if k + 1 < len(workers):
            level, base = written(left.withColumn("__worker", F.floor(F.col("__worker") / GROUP).cast("int")), "left"), base + n
    last = left.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last.schema)
    # fewer than j pieces of each class j: at most classes * (classes - 1) / 2 rows
    last = last.withColumn("__class", F.lit(0)).groupBy("__class").applyInPandas(_first_fit(capacity), f"{fields}, __class int, __bin long, offset long")
    done.append(last.withColumn("sequence_id", number(F.lit(many - 1))))
    return reduce(DataFrame.unionByName, [x.select(*names, "sequence_id", F.col("offset").cast("long").alias("offset")) for x in done])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    pieces = tokenized_pieces(table(spark, sf_dir, "documents"), tokenizer or default_tokenizer())
    packed = harmonic_pack(pieces)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
