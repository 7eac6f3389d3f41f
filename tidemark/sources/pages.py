"""HTML pages: links and product cards, by a small event parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.text import normalize


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[list] = []
        self.href: str | None = None
        self.title: list[str] = []
        self.inside = ""

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href = dict(attrs).get("href")
            if self.href:
                self.found.append([self.href, ""])
        if tag == "h1":
            self.inside = tag

    def handle_endtag(self, tag):
        if tag == "a":
            self.href = None
        if tag == self.inside:
            self.inside = ""

    def handle_data(self, data):
        if self.href:
            self.found[-1][1] += data
        if self.inside:
            self.title.append(data)


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href (absolute), label, title of every link of every page. Pages without links give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                parser = _Links()
                parser.feed(r.html or "")
                title = normalize("".join(parser.title))
                out += [(r.page_id, i, urljoin(r.url or "", href), label.strip(), title) for i, (href, label) in enumerate(parser.found)]
            yield pd.DataFrame(out, columns=["page_id", "pos", "href", "label", "title"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, pos long, href string, label string, title string")
