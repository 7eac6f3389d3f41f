"""Text functions: normal form, tokens, where a name stands in a text, money, excerpts and ranks."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SENTENCE_END = r"(?<=[.!?])\s+|[\r\n]+"


class _Plain(dict):
    """What each character of a decomposed text becomes; worked out when it is first met."""

    def __missing__(self, point: int) -> str | None:
        c = chr(point)
        self[point] = out = None if unicodedata.category(c) == "Mn" else c.lower() if c.isalpha() or c.isdecimal() else " "
        return out


_PLAIN = _Plain()


def normalize(text: str | None) -> str:
    """Compatibility forms taken apart, marks dropped, lower case, anything but letters and digits one space."""
    if not text:
        return ""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKD", text)).translate(_PLAIN).split())


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    return text.map(normalize)


def normalize_ascii(text: Column) -> Column:
    """The same for texts without marks or compatibility forms, in the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))


def contains_name(text: Column, name: Column) -> Column:
    """Whether normalised ``name`` stands in normalised ``text`` as whole tokens; an empty one never does."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (F.length(text) > 0) & (F.length(name) > 0) & pad(text).contains(pad(name))


def tokens(norm: Column) -> Column:
    return F.when(F.length(F.trim(norm)) > 0, F.split(F.trim(norm), " ")).otherwise(F.array().cast("array<string>"))


def index_of_run(text: Column, run: Column) -> Column:
    """Where token array ``run`` first begins in ``text``; -1 if nowhere."""
    spots = F.sequence(F.lit(0), F.greatest(F.size(text) - F.size(run), F.lit(0)))
    found = F.filter(spots, lambda i: F.slice(text, i + 1, F.size(run)) == run)
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(-1))


def letters_and_digits(token: Column) -> Column:
    """A token's runs of digits and of other characters."""
    return F.regexp_extract_all(token, F.lit(r"(\p{Nd}+|\P{Nd}+)"), 1)


def has_digit(token: Column) -> Column:
    return token.rlike(r"\p{Nd}")


def to_cents(text: Column) -> Column:
    """Decimal text to cents, half up; negative or unreadable: null."""
    value = F.trim(text).try_cast("decimal(20,6)")
    return F.when(value >= 0, F.round(value * 100, 0).cast("long"))


def cents_in(text: Column) -> Column:
    """The first number that looks like money, thousands commas dropped."""
    return to_cents(F.replace(F.regexp_extract(text, r"(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)", 1), F.lit(","), F.lit("")))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END, -1)


def parse_domain(url: Column) -> Column:
    """The last two labels of a URL's host, in lower case: the registrable domain where public suffixes have one label."""
    host = F.lower(F.call_function("try_parse_url", url, F.lit("HOST")))
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host))


_TOKEN = re.compile(r"[^\W_]+")
#: Words that announce a rank, and what may stand between a rank and what follows.
_ANNOUNCE = frozenset({"no", "number", "rank", "ranked"})
_LIST_SIGN, _PAUSE = re.compile(r"[.):\-–—]"), re.compile(r"\s*[:.)\-–—]?\s*\Z")


def rank(text: str | None, name: list[str]) -> int | None:
    """The place that a list or a "#3", "no. 3", "number 3", "ranked 3" gives to a name, with two words between at most.

    A number is a rank if a sign or word announces it, or if it opens a line and a list sign follows. Tokens are compared by
    their place: the name must follow the rank after no more than two others, without a line's end between them.
    """
    if not text or not name:
        return None
    found = [(m[0].lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [w for w, _, _ in found]
    starts = {i for i in range(len(words) - len(name) + 1) if words[i] == name[0] and words[i : i + len(name)] == name}
    for i, (word, begin, end) in enumerate(found):
        if not (word.isdecimal() and len(word) <= 2) or starts.isdisjoint(range(i + 1, i + 4)):
            continue
        gap = text[found[i - 1][2] if i else 0 : begin]
        before = words[i - 1] if i else ""
        announced = gap.endswith("#") or before in _ANNOUNCE and gap.strip(" .") == "" and (gap[:1].isspace() or before == "no")
        lead = text[max(text.rfind("\n", 0, begin), text.rfind("\r", 0, begin)) + 1 : begin].strip()
        listed = lead in ("", "#") and _LIST_SIGN.match(text, end)
        if not announced and not listed:
            continue
        if _PAUSE.match(text[end + bool(listed) : found[i + 1][1]]):
            for s in sorted(starts.intersection(range(i + 1, i + 4))):
                if not re.search(r"[\r\n]", "".join(text[found[k][2] : found[k + 1][1]] for k in range(i + 1, s))):
                    return int(word)
    return None


def ranks(text: Column, name: Column) -> Column:
    """Column form of ``rank`` for a normalised name."""

    @F.pandas_udf("int")
    def found(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([rank(t, (n or "").split()) for t, n in zip(texts, names)], dtype="Int32")

    return found(text, name)


def run_index(text: list[str], run: list[str]) -> int:
    """Where ``run`` first stands in ``text``; -1 if nowhere."""
    at, first, size = -1, run[0] if run else None, len(run)
    while first is not None:
        try:
            at = text.index(first, at + 1)
        except ValueError:
            break
        if text[at : at + size] == run:
            return at
    return -1


@dataclass(frozen=True)
class Located:
    """How well and where a name stands in a text; ``words`` are the tokens that belong to the name."""

    base: float
    start: int
    end: int
    words: frozenset[str]
    reason: str


#: What a whole name, all of its tokens apart, a share of them, and the lack of a numbered one are worth.
WHOLE, SCATTERED, PARTIAL, NO_DESIGNATOR = 1.0, 0.8, 0.6, 0.3


def spellings(name: list[str]) -> list[tuple[str, list[str]]]:
    """The ways to write a name, best first: as it is, in one word, or in its letters and digits."""
    other = ("joined", ["".join(name)]) if len(name) > 1 else ("apart", re.findall(r"\d+|\D+", name[0]) if name else [])
    return [("whole", name), *([other] if other[1] != name else [])]


def locate(text: list[str], name: list[str], partial: bool) -> Located | None:
    """The first spelling that stands in the text; with ``partial`` else the share of its tokens that do, numbered ones twice."""
    if not text or not name:
        return None
    for how, run in spellings(name):
        if run and (at := run_index(text, run)) >= 0:
            return Located(WHOLE, at, at + len(run) - 1, frozenset([*name, *run]), how)
    if not partial:
        return None
    first = {t: i for i, t in reversed(list(enumerate(text)))}
    worth = {t: 2 if any(c.isdecimal() for c in t) else 1 for t in name}
    there = [t for t in name if t in first]
    if not there:
        return None
    spots = [first[t] for t in there]
    if len(there) == len(name):
        return Located(SCATTERED, min(spots), max(spots), frozenset(name), "scattered")
    share = sum(worth[t] for t in there) / sum(worth[t] for t in name)
    lost = [t for t in name if t not in first]
    value = PARTIAL * share * (NO_DESIGNATOR if max(worth[t] for t in lost) > 1 else 1)
    return Located(value, min(spots), max(spots), frozenset(name), f"without {' '.join(lost)}, {share:.2f}")


def touching(text: list[str], at: Located, vocabulary: set[str]) -> list[str]:
    """Tokens of ``vocabulary`` next to the span, or inside it without being the name's."""
    near = text[max(0, at.start - 1) : at.start] + text[at.end + 1 : at.end + 2]
    near += [t for t in text[at.start : at.end + 1] if t not in at.words]
    return [t for t in dict.fromkeys(near) if t in vocabulary]


class Sentences:
    """A text's sentences with their tokens, normalised once for all that is asked about it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.parts = re.split(SENTENCE_END, self.text) if text is not None else []
        self.tokens = [normalize(p).split() for p in self.parts]

    def naming(self, name: list[str]) -> tuple[int, int]:
        """The first sentence that holds the name, and where in it; -1 if none does."""
        for i, own in enumerate(self.tokens):
            if (at := run_index(own, name)) >= 0:
                return i, at
        return -1, -1

    def excerpt(self, name: list[str], most: int) -> str:
        """The sentence that names it, then the next and the one before while they fit; a cut ends in an ellipsis."""
        at, _ = self.naming(name)
        shown, size = [at], len(self.parts[at].strip()) if at >= 0 else 0
        for beside in (at + 1, at - 1) if at >= 0 else ():
            if 0 <= beside < len(self.parts) and size + 1 + len(self.parts[beside]) <= most:
                size += 1 + len(self.parts[beside].strip())
                shown.append(beside)
        whole = " ".join(self.parts[i].strip() for i in sorted(shown)) if at >= 0 else self.text.strip()
        if len(whole) <= most:
            return whole
        head = whole[:most]
        space = head.rfind(" ")
        return head[: space if space > most // 2 else most - 1].rstrip() + "…"


def excerpt(text: str | None, name: list[str], most: int) -> str:
    return Sentences(text).excerpt(name, most)
