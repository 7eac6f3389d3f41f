"""HTML to text as a reader would see it.

A forgiving tree builder applies implied tags and moves what stands astray in a table before it; visibility rules drop what is
not shown; a renderer then lays out the rest: blocks on lines of their own, blank lines around paragraphs and headings, list
markers with indentation, preformatted text as it stands, and tables with aligned cells. All visible text is emitted; no part
of a page is judged to be boilerplate. Builder and renderer keep stacks of their own and read a page once, so neither deep
nesting nor unfinished markup costs more than its length.

Rules of visibility: the browser's own style (no scripts, styles, templates, closed dialogs, fallback of embedded media),
the ``hidden`` attribute, and ``display`` and ``visibility`` of inline styles. Text that a reader unfolds in place (details,
options of a select) counts as visible. Style sheets are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

#: Element classes of the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
IN_HEAD = frozenset("base basefont bgsound head link meta title script style noscript template noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist rp annotation annotation-xml desc defs metadata".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table textarea ul xmp".split()
)
SPACED = frozenset("blockquote dir dl figure h1 h2 h3 h4 h5 h6 hr listing menu ol p plaintext pre table ul xmp".split())
LISTS = frozenset("ul ol menu dir".split())
PRE = frozenset("pre listing xmp plaintext textarea".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"html", "body", "legend", "optgroup", "option", "textarea"}
GROUPS = frozenset({"tbody", "thead", "tfoot"})
CELLS = frozenset({"td", "th", "caption"})
#: Parts of a table, and for each what the new part must stand in.
PARTS = {"tr": GROUPS | {"table"}, "td": frozenset({"tr"}), "th": frozenset({"tr"}), **dict.fromkeys([*GROUPS, "caption", "colgroup"], frozenset({"table"})), "col": frozenset({"colgroup", "table"})}
#: Open elements that only their own content may end: tags inside them don't reach what is outside.
WALL = CELLS | {"html", "table"}
#: A start tag of the first kind ends an open element of the second, unless one of the third stands between.
SIBLINGS = {
    "li": (frozenset({"li"}), LISTS),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select", "datalist"})),
    "rt": (frozenset({"rt", "rp"}), frozenset({"ruby"})),
    "rp": (frozenset({"rt", "rp"}), frozenset({"ruby"})),
}
#: Attributes that decide what is shown, and kinds of input whose value is not text to be read.
SEEN = frozenset("alt colspan hidden label open placeholder reversed rowspan start style type value".split())
SILENT = frozenset("hidden checkbox radio password file image range color".split())
#: Tables within tables that are laid out as such, those further in are blocks; lists within lists that are indented further.
DEEPEST, FARTHEST = 8, 32
#: Characters after which a line of a cell is broken at a space, where a table has several columns.
WRAP = 100
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)>")
_NAME = re.compile(r"[^\s/>]+")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_BLANK = re.compile(r"\s*")
_PLAIN_VALUE = re.compile(r"[^\s>]*")
_SHOWN = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})")


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def number(self, name: str, default: int, low: int, high: int) -> int:
        m = _NUMBER.match(self.attrs.get(name, ""))
        return min(high, max(low, int(m[1]))) if m else default


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that count, from after a tag's name, and where the tag ends; -1: nowhere."""
    out: dict[str, str] = {}
    size = len(source)
    while (at := _BETWEEN.match(source, at).end()) < size:
        if source[at] == ">":
            return out, at + 1
        m = _ATTRIBUTE.match(source, at)
        name, at, value = m[0].lower(), _BLANK.match(source, m.end()).end(), ""
        if at < size and source[at] == "=":
            at = _BLANK.match(source, at + 1).end()
            quote = source[at : at + 1]
            if quote in ("'", '"'):
                end = source.find(quote, at + 1)
                if end < 0:
                    break
                value, at = source[at + 1 : end], end + 1
            else:
                m = _PLAIN_VALUE.match(source, at)
                value, at = m[0], m.end()
        if name in SEEN and name not in out:
            out[name] = html.unescape(value)
    return out, -1


class _Builder:
    """The tree under construction, the elements that are open, and how many of each kind, in all and since the last wall."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.all: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]
        self.body = False

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.all[node.tag] += 1
        self.scopes[-1][node.tag] += 1
        if node.tag in WALL:
            self.scopes.append(Counter())

    def pop(self) -> None:
        tag = self.open.pop().tag
        if tag in WALL:
            self.scopes.pop()
        self.all[tag] -= 1
        self.scopes[-1][tag] -= 1

    def pop_to(self, i: int) -> None:
        """Closes all but the elements up to the ``i``-th."""
        while len(self.open) - 1 > i:
            self.pop()

    def up(self, wanted: frozenset, stop: frozenset) -> int:
        """The index of the innermost open element of ``wanted``, unless one of ``stop`` stands further in; else -1."""
        known = self.all if not WALL <= stop else self.scopes[-1]
        if not any(known[tag] for tag in wanted):
            return -1
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in wanted:
                return i
            if self.open[i].tag in stop:
                break
        return -1

    def add(self, child: Node | str) -> None:
        """Into the innermost element; what may not stand between a table's parts goes before the table."""
        at = self.open[-1]
        if at.tag in PARTS and at.tag not in CELLS or at.tag == "table":
            loose = child.strip() != "" if isinstance(child, str) else child.tag not in PARTS and child.tag not in HIDDEN
            if loose:
                i = self.up(frozenset({"table"}), frozenset())
                if i > 0:
                    self.open[i - 1].children.insert(-1, child)
                    return
        at.children.append(child)

    def text(self, words: str) -> None:
        if self.open[-1].tag == "head" and words.strip():
            self.pop()
        self.add(words)

    def start(self, tag: str, attrs: dict[str, str]) -> Node | None:
        """The new element; None if the tag makes none."""
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.pop()
        if tag == "html" or tag == "head" and (self.body or len(self.open) > 1) or tag == "body" and self.body:
            return None
        if tag not in IN_HEAD:
            self.body = True
        if tag in PARTS:
            i = self.up(frozenset({"table"}), frozenset())
            if i < 0:
                return None
            while len(self.open) - 1 > i and self.open[-1].tag not in PARTS[tag]:
                if tag in ("td", "th") and self.open[-1].tag in GROUPS:
                    break
                self.pop()
            if tag in ("td", "th") and self.open[-1].tag != "tr":
                row = Node("tr")
                self.add(row)
                self.push(row)
        elif tag in SIBLINGS:
            over, stop = SIBLINGS[tag]
            if (i := self.up(over, stop | WALL)) > 0:
                self.pop_to(i - 1)
        if tag in ENDS_P and (i := self.up(frozenset({"p"}), WALL | {"button"})) > 0:
            self.pop_to(i - 1)
        if tag == "form" and self.open[-1].tag in PARTS and self.open[-1].tag not in CELLS:
            return None
        node = Node(tag, attrs)
        self.add(node)
        return node

    def end(self, tag: str) -> None:
        """Closes the innermost element of that name; an end tag of a part of a table closes what is open in it."""
        if tag in ("html", "body"):
            return
        stop = frozenset() if tag == "table" else frozenset({"table"}) if tag in PARTS else WALL
        if (i := self.up(frozenset({tag}), stop)) > 0:
            self.pop_to(i - 1)


def parse(source: str) -> Node:
    """The tree of a page. Nothing is an error: open elements end with the page, stray end tags count as nothing, a tag or
    comment without an end takes the rest of the page."""
    builder, at, size = _Builder(), 0, len(source)
    while at < size:
        begin = source.find("<", at)
        follow = source[begin + 1 : begin + 2] if begin >= 0 else ""
        while begin >= 0 and not (follow in "!?/" and follow or follow.isascii() and follow.isalpha()):
            begin = source.find("<", begin + 1)  # a sign, not a tag
            follow = source[begin + 1 : begin + 2] if begin >= 0 else ""
        if begin < 0:
            begin = size
        if begin > at:
            builder.text(source[at:begin])
        if begin == size:
            break
        if m := _TAG.match(source, begin):
            closing, tag, attrs, at = m[1], m[2].lower(), {}, m.end()
        elif source.startswith("<!--", begin):
            end = begin + 4 if source.startswith((">", "->"), begin + 4) else source.find("--", begin + 4)
            while end >= 0 and not source.startswith(("-->", "--!>"), end) and end != begin + 4:
                end = source.find("--", end + 1)
            end = source.find(">", end) if end >= 0 else -1
            at = end + 1 if end >= 0 else size
            continue
        elif follow in "!?" or not (m := _NAME.match(source, begin + 1 + (follow == "/"))) or not (m[0][0].isascii() and m[0][0].isalpha()):
            end = source.find(">", begin)
            at = end + 1 if end >= 0 else size
            continue
        else:
            closing, tag = follow == "/", m[0].lower()
            attrs, at = _attributes(source, m.end())
            if at < 0:
                break
        if closing:
            builder.end(tag)
            continue
        node = builder.start(tag, attrs)
        if tag in RAW or tag == "plaintext":
            # ends only at its own end tag
            m = None if tag == "plaintext" else _raw_end(tag).search(source, at)
            if node:
                node.children.append(source[at : m.start() if m else size])
            at = source.find(">", m.end()) + 1 if m else size
            at = at or size
        elif node and tag not in VOID:
            builder.push(node)
    return builder.root


def _style(node: Node) -> dict[str, str]:
    return dict(_SHOWN.findall(node.attrs["style"].lower())) if "style" in node.attrs else {}


class _Row(str):
    """A line of a table, which nothing breaks any more."""


class _Page:
    """Lines under construction: text flows into the last one until a block ends it."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = self.space = False
        self.indent = self.marker = ""
        self.indents: list[str] = []

    def deeper(self) -> None:
        self.indents.append(self.indent)
        if len(self.indents) <= FARTHEST:
            self.indent += "  "

    def back(self) -> None:
        self.indent = self.indents.pop()

    def flow(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if words[0] == " " or self.space:
            words = (" " if self.now else "") + words.lstrip(" ")
        self.space = words[-1] == " "
        self.put(words.rstrip(" "))

    def put(self, text: str) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.now.append(self.marker or self.indent)
            self.marker = ""
        self.now.append(text)

    def end(self, gap: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False
        self.gap = self.gap or gap

    def row(self, line: str) -> None:
        self.put(line)
        self.end()
        self.lines[-1] = _Row(self.lines[-1])

    def turn(self) -> None:
        """Ends the line, an empty one too."""
        if not self.now:
            self.put("")
        self.end()

    def raw(self, text: str) -> None:
        first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.put(first)
        for line in more:
            self.turn()
            if line:
                self.put(line)

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        lead = next((i for i, line in enumerate(self.lines) if line), 0)
        return self.lines[lead:]


class _Grid:
    """A table's cells as they come: (row, column, rows, columns, lines)."""

    def __init__(self):
        self.cells: list[list] = []
        self.row = -1
        self.column = 0
        self.busy: dict[int, int] = {}

    def next_row(self) -> None:
        self.row, self.column = self.row + 1, 0
        self.busy = {c: left - 1 for c, left in self.busy.items() if left > 1}

    def cell(self, rows: int, columns: int, lines: list[str]) -> None:
        while self.column in self.busy:
            self.column += 1
        self.cells.append([self.row, self.column, rows, columns, lines])
        if rows > 1:
            self.busy.update(dict.fromkeys(range(self.column, self.column + columns), rows))
        self.column += columns

    def lines(self) -> list[str]:
        """Every column as wide as its widest cell, all starting in line; a cell of several lines or rows goes on below."""
        cells = [c for c in self.cells if c[4]]
        if not cells:
            return []
        starts = sorted({c[1] for c in cells})
        place = {c: i for i, c in enumerate(starts)}
        if len(starts) == 1:
            return [line for c in cells for line in c[4]]
        for c in cells:
            c[4] = [part for line in c[4] for part in _broken(line)]
        # columns where no cell begins have no width of their own
        ends = [max(place[c[1]] + 1, bisect_left(starts, c[1] + c[3])) for c in cells]
        width = [0] * len(starts)
        for c, b in sorted(zip(cells, ends), key=lambda x: x[1] - place[x[0][1]]):
            a = place[c[1]]
            need = max((len(line) for line in c[4] if len(line) <= WRAP or isinstance(line, _Row)), default=0)
            width[b - 1] += max(0, need - sum(width[a:b]) - 3 * (b - a - 1))
        left = list(accumulate((w + 3 for w in width), initial=0))
        last = max(c[0] for c in cells)
        height = [0] * (last + 1)
        for c in cells:
            c[2] = min(c[2], last + 1 - c[0])
        for c in sorted(cells, key=lambda c: c[0] + c[2]):
            at = c[0] + c[2] - 1
            height[at] = max(height[at], len(c[4]) - sum(height[c[0] : at]))
        top = list(accumulate(height, initial=0))
        rows: list[list[tuple[int, int, str]]] = [[] for _ in range(top[-1])]
        for c, b in zip(cells, ends):
            for i, line in enumerate(c[4]):
                rows[top[c[0]] + i].append((place[c[1]], b, line))
        out = []
        for row in rows:
            line, reached = "", 0
            for a, b, text in sorted(row):
                for column in range(reached, a + 1):
                    # the end of what stands before, and every empty column after it
                    line = line.ljust(left[column] - 3) + " | " if column else line
                line, reached = line + text, b
            out.append(line.rstrip())
        return out


def _broken(line: str) -> list[str]:
    """A line in parts of WRAP characters at most, broken at spaces; a longer word stays whole."""
    out = []
    while len(line) > WRAP and not isinstance(line, _Row):
        at = line.rfind(" ", 1, WRAP + 1)
        at = at if at > 0 and line[:at].strip() else line.find(" ", WRAP)
        if at < 0:
            break
        out.append(line[:at])
        line = line[at + 1 :]
    return [*out, line]


def _marker(kind: str, n: int) -> str:
    if kind in ("a", "A") and n > 0:
        letters = ""
        while n:
            n, rest = divmod(n - 1, 26)
            letters = chr(97 + rest) + letters
        return letters if kind == "a" else letters.upper()
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("m", "cm", "d", "cd", "c", "xc", "l", "xl", "x", "ix", "v", "iv", "i")):
            out += sign * (n // value)
            n %= value
        return out if kind == "i" else out.upper()
    return str(n)


class _Renderer:
    def __init__(self):
        self.page = _Page()
        self.outer: list[tuple] = []  # pages and lists that a cell interrupts
        self.grids: list[_Grid | None] = []  # None: too far in
        self.lists: list[list] = []  # marker kind ("" for bullets), next number, step
        self.pre = 0
        self.shown = [True]
        self.todo: list[tuple[str, Node | str]] = []

    def run(self, root: Node) -> list[str]:
        self.todo.append(("open", root))
        while self.todo:
            what, x = self.todo.pop()
            if what == "text":
                self.text(x)
            elif what == "open":
                self.open(x)
            else:
                self.close(x)
        return self.page.done()

    def text(self, x: str) -> None:
        if self.shown[-1]:
            x = html.unescape(x) if "&" in x else x
            if self.pre:
                self.page.raw(x)
            else:
                self.page.flow(x)

    def open(self, x: Node) -> None:
        tag, page = x.tag, self.page
        if tag in HIDDEN or "hidden" in x.attrs or tag == "dialog" and "open" not in x.attrs:
            return
        style = _style(x)
        if style.get("display") == "none":
            return
        how = style.get("visibility")
        self.shown.append(self.shown[-1] if how is None else how not in ("hidden", "collapse"))
        children = x.children
        if tag == "br":
            page.turn()
        elif tag == "img":
            self.text_of(x, "alt")
        elif tag == "input":
            self.input(x)
        elif tag == "optgroup":
            page.end()
            self.text_of(x, "label")
            page.end()
        elif tag == "hr":
            page.end(True)
        elif tag == "table":
            page.end(True)
            self.grids.append(_Grid() if len(self.grids) < DEEPEST else None)
        elif tag == "tr" or tag in CELLS:
            if not (grid := self.grids[-1]):
                page.end()
            elif tag == "tr":
                grid.next_row()
            else:
                self.outer.append((page, self.lists, self.pre))
                self.page, self.lists, self.pre = _Page(), [], 0
        elif tag in BLOCK:
            page.end(tag in SPACED and not (tag in LISTS and self.lists))
            if tag in LISTS:
                self.open_list(x)
            elif tag == "li":
                self.item(x)
            elif tag == "dd":
                page.deeper()
            elif tag in PRE:
                self.pre += 1
                if children and isinstance(children[0], str) and children[0].startswith(("\n", "\r\n")):
                    children = [children[0].lstrip("\r")[1:], *children[1:]]
        self.todo.append(("close", x))
        self.todo.extend(("text" if isinstance(c, str) else "open", c) for c in reversed(children))

    def close(self, x: Node) -> None:
        tag = x.tag
        self.shown.pop()
        if tag == "table":
            grid = self.grids.pop()
            for line in grid.lines() if grid else ():
                self.page.row(line)
            self.page.end(True)
        elif tag == "tr" or tag in CELLS:
            if not (grid := self.grids[-1]):
                self.page.end()
            elif tag != "tr":
                lines = self.page.done()
                self.page, self.lists, self.pre = self.outer.pop()
                if tag == "caption":
                    for line in lines:
                        self.page.put(line)
                        self.page.end()
                else:
                    grid.cell(x.number("rowspan", 1, 0, 65534) or 65534, x.number("colspan", 1, 1, 1000), lines)
        elif tag in BLOCK:
            if tag == "hr":
                return
            self.page.end(tag in SPACED and not (tag in LISTS and len(self.lists) > 1))
            if tag in LISTS and self.lists:
                self.lists.pop()
                self.page.back()
            elif tag == "li":
                self.page.marker = ""
            elif tag == "dd":
                self.page.back()
            elif tag in PRE:
                self.pre -= 1

    def text_of(self, x: Node, name: str) -> None:
        if self.shown[-1] and x.attrs.get(name):
            self.page.flow(x.attrs[name])

    def input(self, x: Node) -> None:
        if x.attrs.get("type", "").strip().lower() not in SILENT:
            self.text_of(x, "value" if x.attrs.get("value") else "placeholder")

    def open_list(self, x: Node) -> None:
        back = "reversed" in x.attrs
        first = x.number("start", sum(isinstance(c, Node) and c.tag == "li" for c in x.children) if back else 1, -(10**9), 10**9)
        self.lists.append([x.attrs.get("type", "1") if x.tag == "ol" else "", first, -1 if back else 1])
        self.page.deeper()

    def item(self, x: Node) -> None:
        lead = self.page.indents[-1] if self.lists else self.page.indent
        if self.lists and (own := self.lists[-1])[0]:
            own[1] = x.number("value", own[1], -(10**9), 10**9)
            self.page.marker = f"{lead}{_marker(own[0], own[1])}. "
            own[1] += own[2]
        else:
            self.page.marker = f"{lead}- "


def extract_text(source: str | None) -> str:
    """All visible text of a page. Null and empty pages give an empty text."""
    return "\n".join(_Renderer().run(parse(source))).replace("\xa0", " ") if source else ""


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with ``source`` replaced by text; a column of theirs called text is dropped. Every row stays."""
    keep = [c for c in pages.columns if c not in (source, "text")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__source"):
                texts = [extract_text(s) for s in part.column("__source").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return pages.select(*keep, F.col(source).alias("__source")).mapInArrow(run, f"{fields}text string")


def op8(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
