"""Language identification by rank-order profiles: the out-of-place distance between a text's most frequent character
n-grams and each language's.

An n-gram is up to three letters, where a sign stands for the end of a word. Its number holds their code points as they are,
so every script counts alike. Texts and languages are ranked by the same rule: the more frequent first, then the lesser number.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import categories, code_points, held_out, slices, table, written

#: n-grams of a language profile, and of a text's; also the distance of an n-gram that a profile lacks.
PROFILE = 300
#: Labelled texts that a language's profile is learned from, at most.
SAMPLE = 1500
#: Languages up to which their counts, and the ids of their samples, are broadcast.
FEW = 200
UNKNOWN = "und"
#: Bits of a code point in an n-gram's number, and what stands for the end of a word: no letter has this number.
BITS, END = 21, 1


@functools.cache
def _folded() -> np.ndarray:
    """The lower-case form of each letter's code point, marks as they are, 0 for all others."""
    kind = categories()
    out = np.where(kind == 2, np.arange(0x110000), 0).astype(np.int32)
    for p in np.flatnonzero(kind == 1).tolist():
        low = chr(p).lower()
        out[p] = ord(low) if len(low) == 1 else p
    return out


def frequent(column: pa.Array, owner_of: np.ndarray | None = None, most: int | None = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of each owner's most frequent n-grams, ranked, and letters of each text. Texts own themselves unless
    ``owner_of`` numbers their owners."""
    n = len(column)
    points, starts = code_points(column)
    letter = _folded()[points]
    text = np.repeat(np.arange(n), np.diff(starts))
    letters = np.bincount(text[categories()[points] == 1], minlength=n)
    # one end of a word for each run of other characters, and at either end of a text
    edges = np.concatenate([starts[1:], starts[:-1]])
    letter, text = np.insert(letter, edges, 0), np.insert(text, edges, np.tile(np.arange(n), 2))
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] != 0) | (letter[:-1] != 0) | (text[1:] != text[:-1])
    letter, text = letter[keep], text[keep]
    owner = text if owner_of is None else owner_of[text]
    own = np.zeros(0x110000, np.int64)
    own[letter] = 1
    known = np.flatnonzero(own)
    own[known] = np.arange(len(known))
    size, code = len(known), own[letter]
    space = size + size**2 + size**3
    if n > 1 and space * (int(owner.max(initial=0)) + 1) >= 1 << 62:
        raise OverflowError
    base = owner * space
    two = np.flatnonzero((text[:-1] == text[1:]) & ((letter[:-1] > 0) | (letter[1:] > 0)))
    three = np.flatnonzero((text[:-2] == text[2:]) & (letter[1:-1] > 0)) if len(text) > 2 else np.zeros(0, np.int64)
    solid = np.flatnonzero(letter)
    found = np.concatenate(
        [
            base[solid] + code[solid],
            base[two] + size + code[two] * size + code[two + 1],
            base[three] + size + size**2 + (code[three] * size + code[three + 1]) * size + code[three + 2],
        ]
    )
    found.sort()
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(found)))
    owner, gram = np.divmod(found[first], space) if len(first) else (first, first)
    if most is not None and len(first):
        top, many = int(count.max()), len(first)
        if (int(owner[-1]) + 1) * (top + 1) * many >= 1 << 62:
            order = np.lexsort((-count, owner))
        else:
            order = np.sort((owner * (top + 1) + top - count) * many + np.arange(many)) % many
        owner, gram, count = owner[order], gram[order], count[order]
        rank = np.arange(many) - np.searchsorted(owner, owner)
        owner, gram, count = owner[rank < most], gram[rank < most], count[rank < most]
    shown = np.where(known == 0, END, known).astype(np.int64)
    one, both = gram < size, gram < size + size**2
    rest = np.where(one, gram, np.where(both, gram - size, gram - size - size**2))
    width = max(size, 1)
    c, b, a = (shown[rest // width**k % width] for k in range(3))
    number = np.where(one, c, np.where(both, b << BITS | c, a << 2 * BITS | b << BITS | c))
    return owner, number, count, letters


class Profiles:
    """The learned languages: the rank of every n-gram that any of them has."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.ranked, self.langs = ranked, sorted(ranked)
        self.known = np.array(sorted({g for grams in ranked.values() for g in grams}), np.int64)
        self.rank = np.full((len(self.langs), len(self.known) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.known, ranked[lang])] = np.arange(len(ranked[lang]))

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The nearest language of each text and d2 / (d1 + d2) of its two least distances; of equally near ones the first by name.

        No letter: ``und``, 0. One language only: the second distance is that of a text with no n-gram of it.
        """
        n = len(column)
        try:
            owner, gram, _, letters = frequent(column)
        except OverflowError:
            halves = [self.judge(column[: n // 2]), self.judge(column[n // 2 :])]
            return halves[0][0] + halves[1][0], np.concatenate([halves[0][1], halves[1][1]])
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        at = np.where(self.known[at] == gram, at, len(self.known))
        away = np.empty((n, len(self.langs)))
        for i in range(len(self.langs)):
            rank = self.rank[i][at]
            away[:, i] = np.bincount(owner, np.where(rank < 0, PROFILE, np.minimum(np.abs(rank - place), PROFILE)), n)
        best = away.argmin(1) if n else np.zeros(0, int)
        two = np.sort(away, 1)
        second = two[:, 1] if two.shape[1] > 1 else np.bincount(owner, minlength=n) * float(PROFILE)
        total = two[:, 0] + second
        score = np.where(total > 0, second / np.maximum(total, 1), 0.5)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, letters)], np.where(letters > 0, score, 0.0)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Profiles | None:
    """Profiles from at most ``sample`` texts of each language: those of the least hashed ids, and of one id those of the least
    hash. None if there is no text with a letter.

    Only the profiles, a fixed number of n-grams for each language, come to the driver.
    """
    docs = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = written(docs.select(F.col(key).alias("__key"), F.col(lang).alias("__lang")).distinct(), "ids")
    # a hash threshold leaves about twice the sample of each language, so that no language's rows meet before
    counts = ids.groupBy("__lang").count().select("__lang", (F.lit(2.0 * sample) / F.col("count")).alias("__share"))
    counts = written(counts, "counts")
    few = counts.count() <= FEW
    place: Column = F.pmod(F.xxhash64("__key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    ids = ids.withColumn("__place", place).join(F.broadcast(counts) if few else counts.hint("merge"), "__lang").where("__place < __share")
    first = Window.partitionBy("__lang").orderBy("__place", "__key")
    ids = written(ids.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= sample).select("__key", "__lang", "__place"), "sample")
    chosen = docs.join(F.broadcast(ids) if few else ids.hint("merge"), F.col(key).eqNullSafe(F.col("__key")) & (F.col(lang) == F.col("__lang")))
    chosen = chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text"), "__place")
    each = Window.partitionBy("lang").orderBy("__place", F.xxhash64("text"))
    chosen = written(chosen.withColumn("__n", F.row_number().over(each)).where(F.col("__n") <= sample).select("lang", "text"), "chosen")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, number = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                try:
                    found = [frequent(part.column("text"), number, None)[:3]]
                except OverflowError:
                    found = [(np.full(len(g), o), g, c) for k, o in enumerate(number) for _, g, c, _ in [frequent(part.column("text")[k : k + 1], None, None)]]
                for owner, gram, n in found:
                    yield pa.RecordBatch.from_arrays([pa.array(names[owner].tolist(), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    grams = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    found: dict[str, list[int]] = {}
    for r in ranked.where(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect():
        found.setdefault(r.lang, []).append(r.gram)
    return Profiles(found) if found else None


def identify(docs: DataFrame, profiles: Profiles | None, text: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, and without ``text`` unless asked for; a column of theirs with these names is replaced.

    Whole texts count, every row for itself. Null, empty and letterless texts (marks are no letters) are ``und`` with score 0,
    as all are without profiles.
    """
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    if profiles is None:
        return docs.select(*keep, *[text] * with_text, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    ranked = profiles.ranked
    passed = [*keep, *["__text"] * with_text]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*passed).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(ranked)
        for batch in batches:
            for part in slices(batch, "__text"):
                lang, score = own.judge(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*passed, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{schema}lang_pred string, score double").withColumnRenamed("__text", text)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    profiles = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", out, "text"), profiles)
