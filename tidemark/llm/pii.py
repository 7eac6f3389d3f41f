"""Personal data: fixed patterns give seed entities; their surroundings induce lexical patterns, which are scored against
the instances they catch, round by round, and the patterns that stay trustworthy find identifiers of other shapes.

The graph has instances (a kind and the digits, or the letters of an address) and patterns (words before, after, or on
both sides). A pattern is worth the share of its instances that are known, those that are merely unknown at a discount; an
instance is worth one minus the product of its patterns' doubts. Spark scores both in turn until nothing new is found.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, written

KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A match begins where its digits begin, so nothing is lost by looking only there, and long runs of digits are read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Shapes wider than the fixed patterns: what a trusted context may turn into an identifier of its kind.
WIDE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?\[?\.\]?\s?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[ ./_-]{1,2}[0-9]{3,6}){2,4})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.])(?:[0-9]{7,11}|(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ ./-]{1,2}[0-9]{2,4}){2,4})(?![0-9.])"),
}
#: An address with its signs spelled out: what stands for "@", what may precede it, what may follow.
_AT = re.compile(r"\s?[\[(]\s?(?:at|AT)\s?[\])]\s?|\s(?:at|AT)\s|@")
_HOST = re.compile(r"[A-Za-z0-9-]{2,}(?:(?:\.|\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?|\s(?:dot|DOT)\s)[A-Za-z]{2,})+")
#: A word, as it stands next to an entity, with the signs between.
_WORD = r"[^\W\d_]+"
_BEFORE = re.compile(rf"(?:({_WORD})[^\S\n]+)?({_WORD})([^\w\n]{{0,3}})\Z")
_AFTER = re.compile(rf"([^\w\n]{{0,3}})({_WORD})(?:[^\S\n]+({_WORD}))?")
#: Characters on either side that a pattern is read from.
REACH = 64
#: Rounds of scoring at most; distinct seeds that a pattern needs; the weight of an unknown instance against a pattern; the
#: pattern and instance scores that are trusted.
ROUNDS, SUPPORT, DISCOUNT, TRUST, ACCEPT = 4, 8, 0.5, 0.8, 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, ordered. Matches that fail their check are dropped, not retried."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            found.append((begin, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if any(c in text for c in "0123456789"):
        for m in IP.finditer(text):
            if all(int(x) <= 255 for x in m[0].split(".") if len(x.lstrip("0")) < 4) and all(len(x.lstrip("0")) < 4 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = digits_of(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_of(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def plausible(kind: int, text: str) -> bool:
    digits = digits_of(text)
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19
    if kind == 3:
        return 7 <= len(digits) <= 15
    return True


def rest_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the wide shapes that no base span touches. One stretch of digits may be a candidate of several kinds."""
    found = []
    for m in _AT.finditer(text):
        begin = m.start()
        while begin and text[begin - 1] in _LOCAL:
            begin -= 1
        if m.start() - begin > 1 and (host := _HOST.match(text, m.end())):
            found.append((begin, 0, host.end()))
    if any(c in text for c in "0123456789"):
        for kind, name in enumerate(KINDS[1:], 1):
            found += [(m.start(), kind, m.end()) for m in WIDE[name].finditer(text) if plausible(kind, m[0])]
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    free = lambda s, e: not (k := bisect_left(starts, e)) or ends[k - 1] <= s
    return sorted({x for x in found if free(x[0], x[2])})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: one and two words before, one and two after, and one on each side."""
    out = []
    if left := _BEFORE.search(text[max(0, start - REACH) : start].lower()):
        near = f"<{left[2]}{left[3].strip()}"
        out += [near, *([f"<{left[1]} {near[1:]}"] if left[1] else [])]
    if right := _AFTER.match(text[end : end + REACH].lower()):
        near = f">{right[1].strip()}{right[2]}"
        out += [near, *([f"{near} {right[3]}"] if right[3] else [])]
        if left:
            out.append(out[0] + near)
    return out


def form(kind: int, text: str) -> str:
    """What decides an instance of a kind: an address's letters in lower case, the digits of anything else."""
    return text.lower() if kind == 0 else digits_of(text)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, counts and digest of base spans, and every seed and candidate with its patterns. One pass over whole texts."""
    row = "struct<kind:int,start:int,end:int,seed:boolean,form:string,patterns:array<string>>"
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    names = ["__n0", "__n1", "__n2", "__n3", "__sha", "__found"]
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("form", pa.string()), ("patterns", pa.list_(pa.string()))])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(item)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                columns: list[list] = [[] for _ in names]
                for t in part.column("__text").to_pylist():
                    t = t or ""
                    base = base_spans(t)
                    each = [(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in rest_spans(t, base)]
                    found = [{"kind": k, "start": s, "end": e, "seed": seed, "form": form(k, t[s:e]), "patterns": contexts(t, s, e)} for s, k, e, seed in each]
                    for c, v in zip(columns, (*(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), found)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*keep, *names])

    schema = f"{fields}__n0 long, __n1 long, __n2 long, __n3 long, __sha string, __found array<{row}>"
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, discount: float = DISCOUNT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """The instances that trusted patterns vouch for: kind, form, voice.

    ``found`` has kind, form, seed and patterns. A pattern's score is the known worth of the distinct instances it catches
    over their number, where an instance that is no seed counts ``discount`` as long as nothing vouches for it; patterns that
    caught fewer than ``support`` seeds have none. Seeds are worth 1, an instance of unknown worth 0.
    """
    edges = found.select("kind", "form", "seed", F.explode_outer("patterns").alias("pattern"))
    edges = written(edges.groupBy("kind", "form", "pattern").agg(F.max("seed").alias("seed")), "patterns")
    own = edges.where("seed").select("kind", "form").distinct()
    open_ = written(edges.where("not seed and pattern is not null").join(own, ["kind", "form"], "left_anti"), "open")
    seeds = written(edges.where("seed and pattern is not null").groupBy("kind", "pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support), "seeds")
    voices, said = None, None
    for _ in range(rounds):
        worth = open_ if voices is None else open_.join(voices.where(F.col("voice") >= accept), ["kind", "form"], "left")
        voice = F.lit(0.0) if voices is None else F.coalesce("voice", F.lit(0.0))
        rest = worth.groupBy("kind", "pattern").agg(F.sum(voice).alias("known"), F.sum(F.greatest(voice, F.lit(discount))).alias("weight"))
        rest = written(rest, "rest")
        score = (F.col("seeds") + F.coalesce("known", F.lit(0.0))) / (F.col("seeds") + F.coalesce("weight", F.lit(0.0)))
        trusted = seeds.join(rest, ["kind", "pattern"], "left").select("kind", "pattern", score.alias("score")).where(F.col("score") >= trust)
        trusted = written(trusted, "trusted")
        doubt = F.exp(F.sum(F.ln(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        voices = written(open_.join(trusted, ["kind", "pattern"]).groupBy("kind", "form").agg((1 - doubt).alias("voice")), "voices")
        before, said = said, voices.where(F.col("voice") >= accept).count()
        if said == (before or 0):
            break
    return written(voices.where(F.col("voice") >= accept).unionByName(own.withColumn("voice", F.lit(1.0))), "known")


def extract(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, counts and digest of base spans, all spans as text, and the number of added ones, for every row.

    Null text: empty. Rows repeated with the same id keep a row each, with the spans of their own text. A candidate with the
    digits or letters of a seed elsewhere is known. Of accepted spans that overlap, the surest stays, then the longest, then the first.
    """
    keep = list(keep)
    seen = written(scan(docs, keep, text).withColumn("__rid", F.monotonically_increasing_id()), "spans")
    found = seen.select("__rid", F.explode("__found").alias("f")).select("__rid", "f.*")
    good = bootstrap(found)
    spot = F.struct((-F.col("voice")).alias("doubt"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "kind")
    added = found.where("not seed").join(good, ["kind", "form"]).groupBy("__rid").agg(F.array_sort(F.collect_set(spot)).alias("__more"))
    apart = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
    none = F.array().cast("array<struct<doubt:double,size:int,start:int,end:int,kind:int>>")
    kept = F.aggregate("__more", none, lambda out, x: F.when(apart(out, x), F.concat(out, F.array(x))).otherwise(out))
    plain = seen.where("not exists(__found, f -> not f.seed)").withColumn("__kept", none)
    open_ = seen.where("exists(__found, f -> not f.seed)").join(added, "__rid", "left").withColumn("__kept", F.coalesce(kept, none)).drop("__more")
    at = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    named = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])
    every = F.array_sort(F.concat(F.transform(F.filter("__found", lambda f: f["seed"]), at), F.transform("__kept", at)))
    counts = [F.col(f"__n{i}").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = F.array_join(F.transform(every, named), ",").alias("spans")
    return plain.unionByName(open_).select(*keep, *counts, F.col("__sha").alias("base_sha256"), spans, F.size("__kept").alias("n_added"))


def mask(text: str, spans: str) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are replaced once, by the first kind."""
    out, at = [], 0
    for kind, start, end in (s.split(":") for s in spans.split(",") if s):
        if int(end) <= at:
            continue
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = int(end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; a text without any stays as it is, null too."""
    names = docs.columns
    rows = extract(docs, text, names).select(*names, "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = [mask(t, s) if s else t for t, s in zip(part.column(text).to_pylist(), part.column("spans").to_pylist())]
                columns = [part.column(c) for c in names]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents"))
