"""Mixing to target weights with soft membership.

A classifier learned from labelled documents gives each document a posterior over domains. Document rates r >= 0 are then
fitted so that the expected tokens of each domain, A r with A of tokens x posteriors, match the targets t: least squares by
projected gradient. A step moves every document's rate against the gradient, along its posterior, and clips it at its bound.
Documents never move: a step needs one sum for each domain over all of them, and a rate is a function of its own row and of
the steps so far, a few numbers each. DataFrame functions only.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

_LOG = logging.getLogger(__name__)
#: Labelled documents that the classifier is learned from, at most; those with the least hashed ids.
SAMPLE = 12_000
#: The least evidence for a word that counts as a sign of a toxic text: documents, log odds, log-likelihood ratio.
LEAST_SEEN, LEAST_ODDS, LEAST_RATIO = 5, 2.0, 20.0
#: Steps of the projected gradient, the times that one may be halved, the residual at which it ends (of the least target), the
#: residuals of which a step must stay below the greatest, by what share of its length, and the steps after which the rates
#: are written.
STEPS, HALVINGS, CLOSE, LOOK_BACK, ENOUGH, WRITE = 60, 8, 1e-3, 4, 1e-4, 8
#: Domains: names, and each one's labels.
DOMAINS = {"good": "quality = 1 and toxic = 0", "poor": "quality = 0 and toxic = 0", "toxic": "toxic = 1"}
#: Shares of all expected tokens.
TARGETS = {"good": 0.95, "poor": 0.04, "toxic": 0.01}


def token_count(text: Column) -> Column:
    """Runs of what is no white space of any kind; one at least."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^\s\p{Z}\x85]+"))).cast("long")


def words(text: Column) -> Column:
    """Runs of letters of the lower-case text."""
    return F.split(F.lower(text), r"\P{L}+")


def traits(text: Column, tokens: Column, signs: list[str]) -> dict[str, Column]:
    """Cheap traits of a whole text, each a small class number: size, odd characters, upper case, long words, repeated lines, signs.

    A sign is a whole word of the lower-case text, and counts as often as it stands there.
    """
    size, count = F.greatest(F.char_length(text), F.lit(1)).cast("double"), tokens.cast("double")
    lines = F.split(text, "\n")
    found = {
        "size": F.least(F.lit(9), F.floor(F.log2(size) * 0.6)),
        "odd": F.least(F.lit(7), F.floor(40 * F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{Z}\s.,]")) / size)),
        "upper": F.least(F.lit(7), F.floor(16 * F.regexp_count(text, F.lit(r"\p{Lu}")) / size)),
        "word": F.least(F.lit(9), F.floor(size / count)),
        "lines": F.least(F.lit(7), F.floor(20 * (F.size(lines) - F.size(F.array_distinct(lines))) / count)),
    }
    if signs:
        found["signs"] = F.least(F.lit(3), F.size(F.filter(words(text), lambda w: w.isin(signs))))
    return {k: v.cast("int") for k, v in found.items()}


class Classifier:
    """Naive Bayes over the traits' classes: log odds tables, a few hundred numbers in all."""

    def __init__(self, domains: list[str], signs: list[str], prior: list[float], tables: dict[str, dict[int, list[float]]], default: dict[str, list[float]]):
        self.domains, self.signs, self.prior, self.tables, self.default = domains, signs, prior, tables, default

    def log_odds(self) -> list[Column]:
        """The logarithm of each domain's probability, up to a constant, from columns named like the traits."""
        logs = []
        for k in range(len(self.domains)):
            total: Column = F.lit(self.prior[k])
            for name, known in self.tables.items():
                at = F.lit(self.default[name][k])
                for value, row in sorted(known.items()):
                    at = F.when(F.col(f"__{name}") == value, row[k]).otherwise(at)
                total = total + at
            logs.append(total)
        return logs


def learn(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, sample: int = SAMPLE) -> Classifier:
    """A classifier from at most ``sample`` labelled documents. Of a document's labels the greatest toxic and least quality count.

    Without usable labels all documents get equal shares of every domain.
    """
    names = list(domains)
    ids = labels.where("doc_id is not null and quality is not null and toxic is not null")
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    domain = F.coalesce(*(F.when(F.expr(rule), F.lit(k)) for k, rule in enumerate(domains.values())))
    # at most ``sample`` ids
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = written(rows.select("doc_id", "text", "toxic", domain.alias("domain")).where("domain is not null"), "labelled")
    counts = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    size = [counts.get(k, 0) for k in range(len(names))]
    if not sum(size):
        return Classifier(names, [], [0.0] * len(names), {}, {})
    bad = rows.where("toxic = 1").count()
    good = sum(size) - bad
    signs: list[str] = []
    if bad and good:
        word = F.explode(F.array_distinct(words(F.col("text")))).alias("word")
        seen = rows.select("toxic", word).where("word <> ''").groupBy("word").agg(F.sum(F.col("toxic").cast("double")).alias("a"), F.sum(1 - F.col("toxic").cast("double")).alias("b"))
        odds = F.ln((F.col("a") + 0.5) / (bad - F.col("a") + 0.5)) - F.ln((F.col("b") + 0.5) / (good - F.col("b") + 0.5))
        expected = (F.col("a") + F.col("b")) / float(bad + good)
        ratio = 2 * sum(F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / (expected * float(n)))).otherwise(0.0) for x, n in (("a", bad), ("b", good)))
        top = seen.where(f"a >= {LEAST_SEEN}").withColumn("odds", odds).withColumn("ratio", ratio).where(f"odds >= {LEAST_ODDS} and ratio >= {LEAST_RATIO}")
        # words of a bounded sample, each in several of its texts
        signs = sorted(r.word for r in top.select("word").collect())
    found = traits(F.col("text"), token_count(F.col("text")), signs)
    long = rows.select("domain", F.explode(F.map_from_arrays(F.array(*map(F.lit, found)), F.array(*found.values()))).alias("trait", "value"))
    tables: dict[str, dict[int, list[float]]] = {name: {} for name in found}
    for r in long.groupBy("trait", "value", "domain").count().collect():
        tables[r.trait].setdefault(r.value, [0.0] * len(names))[r.domain] += r["count"]
    default = {name: [math.log(1 / (n + 10)) for n in size] for name in found}
    logs = {name: {v: [math.log((c + 1) / (n + 10)) for c, n in zip(row, size)] for v, row in known.items()} for name, known in tables.items()}
    prior = [math.log((n + 1) / (sum(size) + len(names))) for n in size]
    return Classifier(names, signs, prior, logs, default)


def memberships(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """``keep`` columns, tokens (words, one at least) and p0, p1, ... of each document. A null text counts as empty.

    Traits are columns of their own before they are looked up, so that a text is read once for each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = token_count(text).alias("tokens")
    if not model.tables:
        return docs.select(*keep, tokens, *(F.lit(1.0 / len(model.domains)).alias(f"p{k}") for k in range(len(model.domains))))
    rows = docs.select(*keep, text.alias("__text"), tokens)
    rows = rows.select(*keep, "tokens", *(v.alias(f"__{k}") for k, v in traits(F.col("__text"), F.col("tokens"), model.signs).items()))
    logs = model.log_odds()
    rows = rows.select(*keep, "tokens", *(x.alias(f"l{k}") for k, x in enumerate(logs)))
    top = F.greatest(*(F.col(f"l{k}") for k in range(len(logs)))) if len(logs) > 1 else F.col("l0")
    rows = rows.select(*keep, "tokens", *(F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in range(len(logs))))
    total = sum((F.col(f"e{k}") for k in range(len(logs))), F.lit(0.0))
    return rows.select(*keep, "tokens", *((F.col(f"e{k}") / total).alias(f"p{k}") for k in range(len(logs))))


def _along(p: list[str], step: np.ndarray) -> Column:
    return sum((F.col(c) * float(x) for c, x in zip(p, step)), F.lit(0.0))


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS, floor: Column | None = None) -> tuple[Column, list[float], list[float]]:
    """A column of rates over ``rows`` (tokens, p0, p1, ...), the domains' wanted tokens and those that the rates give.

    ``targets`` are shares; the budget keeps the first domain at its present size, so that its documents stay near a rate of
    one, where all begin. Minimised is half the sum of squares of (t - A r) / s over r >= ``floor`` (0), where s is the root of
    a domain's tokens x posterior^2, so that small domains weigh as much as large ones. In the metric of tokens, a document's
    step down the gradient is its posterior times (t - A r) / s^2, so documents of a kind move alike whatever their length.
    The first step has the length of one over the greatest curvature; later ones follow the change of the gradient by either
    spectral rule in turn, and one that leaves the residual above all of the last few is halved. The rates of the step with the
    least residual count: of targets that no rates can reach, those near the least squares.
    """
    k = len(targets)
    p = [f"p{i}" for i in range(k)]
    least = F.lit(0.0) if floor is None else floor
    narrow = rows.select("tokens", *p, least.cast("double").alias("least"), F.greatest(least, F.lit(1.0)).cast("double").alias("r"))
    gram = [F.sum(F.col("tokens") * F.col(a) * F.col(b)) for a in p for b in p]

    def sums(table_: DataFrame, *found: Column) -> np.ndarray:
        return np.array([float(x or 0.0) for x in table_.agg(*(f.alias(f"s{i}") for i, f in enumerate(found))).first()])

    def tokens(rate: Column) -> list[Column]:
        return [F.sum(rate * F.col("tokens") * F.col(c)) for c in p]

    first = sums(narrow, *tokens(F.col("r")), *gram)
    got, gram_ = first[:k], first[k:].reshape(k, k)
    if not got.sum():
        return F.lit(1.0), [0.0] * k, [0.0] * k
    share = np.array(targets) / sum(targets)
    want = share * (got[0] / share[0] if got[0] > 0 and share[0] > 0 else got.sum())
    weight = np.where(np.diag(gram_) > 0, 1 / np.maximum(np.diag(gram_), 1e-300), 0.0)
    curve = float(np.linalg.eigvalsh(np.sqrt(weight)[:, None] * gram_ * np.sqrt(weight)).max())
    length, loss = 1 / curve, lambda a: float(((want - a) ** 2 * weight).sum()) / 2
    past, moves, at, rate = [loss(got)], [], narrow, F.col("r")
    best, down = (past[0], 0, got), weight * (want - got)
    for step in range(steps):
        if np.abs(want - got).max() <= CLOSE * want.sum() * share[share > 0].min():
            break
        for _ in range(HALVINGS):
            moved = F.greatest(F.col("least"), rate + _along(p, length * down))
            *there, far = sums(at, *tokens(moved), F.sum(F.col("tokens") * (moved - rate) * (moved - rate)))
            there = np.array(there)
            if loss(there) <= max(past[-LOOK_BACK:]) - ENOUGH * far / length:
                break
            length /= 2
        else:
            break
        moves.append(length * down)
        change, turn = there - got, weight * (got - there)
        rate, got, down = moved, there, weight * (want - there)
        along, bend = float((change**2 * weight).sum()), float(turn @ gram_ @ turn)
        length = far / along if step % 2 and along > 0 else along / bend if bend > 0 else 1 / curve
        length = float(np.clip(length, 1 / curve, 1e4 / curve))
        past.append(loss(got))
        best = min(best, (past[-1], len(moves), got), key=lambda x: x[0])
        if len(moves) % WRITE == 0:
            at = written(at.select("tokens", *p, "least", rate.alias("r")), "rates")
            rate = F.col("r")
    out = F.greatest(least, F.lit(1.0))
    for move in moves[: best[1]]:
        out = F.greatest(least, out + _along(p, move))
    return out, want.tolist(), best[2].tolist()


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domains: dict[str, str] = DOMAINS, keep_first: bool = False, keep: list[str] = ("doc_id",)) -> DataFrame:
    """Rates of all documents: ``keep`` columns, tokens, p_<domain>, rate, and copies (rate rounded up or down by the id's hash).

    With ``keep_first``, documents more likely of the first domain than not have rates of one at least.
    Null and empty texts count one token. Every row keeps its own rate; rows with the same id are rounded by the same chance.
    """
    model = learn(docs, labels, domains)
    rows = written(memberships(docs, model, list(keep)), "memberships")
    rate, want, got = fit_rates(rows, [targets[d] for d in model.domains], floor=F.when(F.col("p0") >= 0.5, 1.0).otherwise(0.0) if keep_first else None)
    far = max((abs(a - b) / a for a, b in zip(want, got) if a), default=0.0) > 0.01
    for d, a, b in zip(model.domains, want, got):
        _LOG.log(logging.WARNING if far else logging.INFO, "domain %s: %.0f tokens wanted, %.0f reached", d, a, b)
    rated = rows.withColumn("rate", rate)
    return rated.select(*keep, "tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(model.domains)), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def copies(rate: Column, key: Column) -> Column:
    """The rate as a whole number of copies, right on average over keys."""
    chance = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + chance).cast("int")


def op5(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
