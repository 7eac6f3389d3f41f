"""Toxicity: a lexicon's trie intersected with Levenshtein automata finds terms and their misspellings; the words around
a hit tell quotation from abuse.

The lexicon is learned from labelled texts: every word that the evidence supports. Trie and automata are joined into a table
of states, made as words lead to them, that reads all words of many texts at the same time, a letter a step.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import categories, code_points, held_out, slices, table, written

#: Labelled texts that lexicon and weights are learned from, at most; those with the least hashed ids.
SAMPLE = 12_000
#: The least evidence for a term of the lexicon: toxic texts that hold it, its log odds, and its log-likelihood ratio.
LEAST_SEEN, LEAST_ODDS, LEAST_RATIO = 5, 2.0, 20.0
#: States that a worker remembers; it starts anew beyond.
STATES = 200_000
#: Characters around a hit in which quotation marks and reporting words count.
WINDOW = 80
#: Characters that stand for letters, and words that report or cite another's speech.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s"}
REPORTS = ("said", "says", "say", "wrote", "writes", "called", "calls", "quote", "quoted", "quotes", "term", "word", "phrase")
_OPEN = re.compile(r"[\"“„«‘][^\"“”„«»‘’\n]*$")
_CLOSE = re.compile(r"^[^\"“”„«»‘’\n]*[\"”“»’]")
_REPORT = re.compile(rf"\b(?:{'|'.join(REPORTS)})\b", re.IGNORECASE)


def reach(term: str) -> int:
    """Edits by which a term may be misspelled."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """States that read letters: subsets of (trie node, edits so far). ``found[state]`` is the term at a word's end, or -1.

    State 0 accepts nothing any more, 1 is the start. Steps are worked out when a word first takes them.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.alphabet = sorted({c for t in terms for c in t})
        self.child: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.most = [0]
        for i, term in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], reach(term))
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], reach(term))
            self.ends[node] = i
        self.longest = max(map(len, terms), default=0) + 2
        self._begin()

    def _begin(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.step = np.full((64, len(self.alphabet) + 1), -1, np.int32)
        self.found, self.edits = np.full(64, -1, np.int32), np.zeros(64, np.int8)
        self._state(frozenset())
        self._state(self._closed({0: 0}))

    def _state(self, state: frozenset) -> int:
        if state not in self.number:
            i = self.number[state] = len(self.states)
            self.states.append(state)
            if i == len(self.found):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
                self.found = np.concatenate([self.found, np.full_like(self.found, -1)])
                self.edits = np.concatenate([self.edits, np.zeros_like(self.edits)])
            hits = [(e, self.ends[node]) for node, e in state if node in self.ends and e <= reach(self.terms[self.ends[node]])]
            if hits:
                self.edits[i], self.found[i] = min(hits)
        return self.number[state]

    def _closed(self, part: dict[int, int]) -> frozenset:
        """With letters of the trie that the word leaves out."""
        todo = list(part.items())
        for node, e in todo:
            if e != part[node]:
                continue
            for nxt in self.child[node].values():
                if e + 1 <= self.most[nxt] and part.get(nxt, 99) > e + 1:
                    part[nxt] = e + 1
                    todo.append((nxt, e + 1))
        return frozenset(part.items())

    def _after(self, state: frozenset, c: str | None) -> frozenset:
        part: dict[int, int] = {}
        for node, e in state:
            for letter, nxt in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.most[nxt] and cost < part.get(nxt, 99):
                    part[nxt] = cost
            if e + 1 <= self.most[node] and e + 1 < part.get(node, 99):
                part[node] = e + 1
        return self._closed(part)

    def after(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states that letters (columns of the table) lead to."""
        to = self.step[states, letters]
        if (to < 0).any():
            width = self.step.shape[1]
            for k in np.unique(states[to < 0].astype(np.int64) * width + letters[to < 0]).tolist():
                state, letter = divmod(k, width)
                made = self._state(self._after(self.states[state], self.alphabet[letter - 1] if letter else None))
                self.step[state, letter] = made
            to = self.step[states, letters]
        return to

    def letters(self) -> np.ndarray:
        """The column of each code point; -1: not in a word."""
        of = np.where(categories() > 0, 0, -1).astype(np.int32)
        of[ord("*")] = 0
        for i, c in enumerate(self.alphabet):
            for form in {c, c.upper(), c.lower()}:
                if len(form) == 1:
                    of[ord(form)] = i + 1
        for sign, c in STANDS_FOR.items():
            of[ord(sign)] = self.alphabet.index(c) + 1 if c in self.alphabet else 0
        return of


def hits(automaton: Automaton, letters: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, term and edits of every word that the automaton accepts."""
    if len(automaton.states) > STATES:
        automaton._begin()
    code = letters[points]
    inside = np.concatenate([[False], code >= 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    short = end - begin <= automaton.longest
    begin, end = begin[short], end[short]
    state, live = np.ones(len(begin), np.int32), np.arange(len(begin))
    at = begin.copy()
    while len(live):
        state[live] = automaton.after(state[live], code[at[live]])
        at[live] += 1
        live = live[(state[live] > 0) & (at[live] < end[live])]
    ok = (automaton.found[state] >= 0) & (at == end)
    return begin[ok], end[ok], automaton.found[state[ok]], automaton.edits[state[ok]]


#: Weighted hits of a text: exact in abuse, exact in quotation, misspelled in abuse, misspelled in quotation.
KINDS = 4


def features(automaton: Automaton, weights: np.ndarray, letters: np.ndarray, column: pa.Array) -> np.ndarray:
    """A row for each text: the weighted hits of each kind, damped, and whether there is any of each."""
    points, starts = code_points(column)
    points, starts = np.insert(points, starts[1:], 10), starts + np.arange(len(starts))  # a line end after each text
    out = np.zeros((len(column), KINDS))
    begin, end, term, edits = hits(automaton, letters, points)
    for b, e, t, k, d in zip(begin, end, term, edits, np.searchsorted(starts, begin, "right") - 1):
        left = points[max(starts[d], b - WINDOW) : b].tobytes().decode("utf-32-le", "replace")
        right = points[e : min(starts[d + 1], e + WINDOW)].tobytes().decode("utf-32-le", "replace")
        cited = bool(_OPEN.search(left) and _CLOSE.search(right)) or bool(_REPORT.search(left[-WINDOW // 4 :]))
        out[d, 2 * (k > 0) + cited] += weights[t]
    return np.hstack([np.log1p(out), out > 0])


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, intercept first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@functools.lru_cache(maxsize=2)
def _automaton(terms: tuple[str, ...]) -> tuple[Automaton, np.ndarray]:
    """One for each Python worker, whose states outlive a task; and its columns of the code points."""
    automaton = Automaton(list(terms))
    return automaton, automaton.letters()


class Model:
    """Terms with their weights, and the regression's coefficients."""

    def __init__(self, terms: list[str], weights: list[float], coefficients: np.ndarray):
        self.terms, self.weights, self.coefficients = tuple(terms), np.array(weights), coefficients

    def features(self, column: pa.Array) -> np.ndarray:
        automaton, letters = _automaton(self.terms)
        return features(automaton, self.weights, letters, column)

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + self.features(column) @ self.coefficients[1:], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled documents; one labelled twice counts as toxic if any label says so, and each of the
    rows that share its id counts.

    None if a class is missing, as it is without labels or documents. Labels decide terms and weights; they are no input of a score.
    """
    ids = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` ids
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = written(rows.select("doc_id", "text", "toxic"), "labelled")
    total = rows.groupBy("toxic").count().collect()
    sums = {bool(r.toxic): r["count"] for r in total}
    if len(sums) < 2:
        return None
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")
    bad, good = F.sum(F.col("toxic").cast("double")), F.sum(1 - F.col("toxic").cast("double"))
    seen = rows.select("toxic", word).where("word <> ''").groupBy("word").agg(bad.alias("a"), good.alias("b")).where(f"a >= {LEAST_SEEN}")
    odds = F.ln((F.col("a") + 0.5) / (sums[True] - F.col("a") + 0.5)) - F.ln((F.col("b") + 0.5) / (sums[False] - F.col("b") + 0.5))
    whole = float(sums[True] + sums[False])
    ratio = 2 * sum(F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) * whole / ((F.col("a") + F.col("b")) * float(n)))).otherwise(0.0) for x, n in (("a", sums[True]), ("b", sums[False])))
    seen = seen.withColumn("odds", odds).withColumn("ratio", ratio)
    # words of a bounded sample, each in several of its texts
    top = seen.where(f"odds >= {LEAST_ODDS} and ratio >= {LEAST_RATIO}").orderBy("word").collect()
    terms, weights = [r.word for r in top], [float(r.odds) for r in top]
    model = Model(terms, weights, np.zeros(1 + 2 * KINDS))
    found = _mapped(rows.select("doc_id", "toxic", "text"), ["toxic"], model, "x array<double>", True).collect()
    x, y = np.array([r.x for r in found]), np.array([float(r.toxic) for r in found])
    model.coefficients = _fit(x, y)
    return model


def _mapped(docs: DataFrame, keep: list[str], model: Model, made: str, raw: bool) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if raw:
                    new = [pa.array(model.features(part.column("text")).tolist(), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], [*keep, "x"])
                else:
                    new = [pa.array(model.score(part.column("text")), pa.float64())]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], [*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, {made}")


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with score; a column of that name is replaced. Every row counts for itself, its whole text is read.

    Null and empty texts have no hit; without a model all are 0.
    """
    keep = [c for c in docs.columns if c not in (text, "score")]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    return _mapped(docs.select(*keep, F.col(text).alias("text")), keep, model, "score double", False)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    scored = score(docs.select("doc_id", out, "text"), learn(docs, labels))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
