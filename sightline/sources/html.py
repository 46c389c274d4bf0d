"""Parsing pages: one Arrow pass over HTML gives the parts that rules and site analyses need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOM_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("rel", T.ArrayType(T.StructType([T.StructField("rel", T.StringType()), T.StructField("href", T.StringType()), T.StructField("hreflang", T.StringType())]))),
    T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType()), T.StructField("rel", T.StringType()), T.StructField("target", T.StringType())]))),
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("alt", T.StringType())]))),
    T.StructField("resources", T.ArrayType(T.StringType())), T.StructField("jsonld", T.ArrayType(T.StringType())), T.StructField("scripts", T.StringType()),
    T.StructField("paragraphs", T.ArrayType(T.StringType())), T.StructField("lists", T.IntegerType()), T.StructField("itemscopes", T.IntegerType()), T.StructField("iframes", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("html_length", T.IntegerType()),
])
_RAW = {"script", "style"}


class _Page(HTMLParser):
    """Collects the parts in document order; script and style are raw text, and unclosed elements end with their container."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict = {k: [] for k in ("rel", "headings", "links", "images", "resources", "jsonld", "paragraphs")}
        self.out |= {"title": None, "lang": None, "meta": {}, "lists": 0, "itemscopes": 0, "iframes": 0}
        self.text: list[str] = []
        self.scripts: list[str] = []
        self.open: list[tuple[str, dict, list[str]]] = []
        self.raw: str | None = None
        self.raw_kind = ""
        self.raw_text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        self.out["itemscopes"] += "itemscope" in a
        if tag in _RAW:
            self.raw, self.raw_kind, self.raw_text = tag, a.get("type", "").lower(), []
            if a.get("src"):
                self.out["resources"].append(a["src"])
        elif tag == "html":
            self.out["lang"] = a.get("lang") or self.out["lang"]
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or a.get("http-equiv") or "").strip().lower()
            if name and "content" in a:
                self.out["meta"].setdefault(name, a["content"].strip())
        elif tag == "link":
            self.out["rel"].append((a.get("rel", "").lower(), a.get("href", ""), a.get("hreflang") or None))
            if "stylesheet" in a.get("rel", "").lower():
                self.out["resources"].append(a.get("href", ""))
        elif tag == "img":
            self.out["images"].append((a.get("src", ""), a.get("alt")))
            self.out["resources"].append(a.get("src", ""))
            for _, _, parts in self.open:
                parts.append(" " + a.get("alt", ""))
        elif tag in ("iframe", "video", "audio", "source", "embed"):
            self.out["iframes"] += tag == "iframe"
            self.out["resources"].append(a.get("src", ""))
        elif tag in ("ul", "ol"):
            self.out["lists"] += 1
        if tag in ("a", "p", "title") or re.fullmatch("h[1-6]", tag):
            if tag == "p" or tag[0] == "h":
                self._close({"p"})
            self.open.append((tag, a, []))
        if tag in ("p", "div", "li", "br", "td", "tr", "section", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.text.append(" ")

    def _close(self, tags: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                tag, a, parts = self.open.pop(k)
                text = " ".join("".join(parts).split())
                if tag == "a":
                    self.out["links"].append((a.get("href"), text or a.get("aria-label") or a.get("title") or "", a.get("rel", "").lower(), a.get("target", "")))
                elif tag == "p":
                    self.out["paragraphs"].append(text)
                elif tag == "title":
                    self.out["title"] = text if self.out["title"] is None else self.out["title"]
                else:
                    self.out["headings"].append((int(tag[1]), text))
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == self.raw:
            body = "".join(self.raw_text)
            if tag == "script":
                (self.out["jsonld"] if "ld+json" in self.raw_kind else self.scripts).append(body)
            self.raw = None
        elif tag in ("a", "p", "title") or re.fullmatch("h[1-6]", tag):
            self._close({tag})
        elif tag in ("div", "body", "section", "article", "li", "td"):
            self._close({"p"})

    def handle_data(self, data: str) -> None:
        if self.raw:
            self.raw_text.append(data)
            return
        if not any(t == "title" for t, _, _ in self.open):
            self.text.append(data)
        for _, _, parts in self.open:
            parts.append(data)


def parse_page(html: str) -> dict:
    """The parts of one page, as DOM_SCHEMA."""
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except (ValueError, AssertionError):
        pass  # what was read so far stands
    while page.open:
        page._close({page.open[-1][0]})
    return page.out | {"scripts": "\n".join(page.scripts), "text": " ".join("".join(page.text).split()), "html_length": len(html)}


@F.pandas_udf(DOM_SCHEMA)
def dom(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The parts of each page; null HTML gives a struct of nulls."""
    names = DOM_SCHEMA.names
    for batch in batches:
        yield pd.DataFrame([_row(h, names) for h in batch], columns=names)


def _row(html: str | None, names: list[str]) -> dict:
    if not isinstance(html, str):
        return dict.fromkeys(names)
    page = parse_page(html)
    shapes = {f.name: [g.name for g in f.dataType.elementType.fields] for f in DOM_SCHEMA.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}
    return {n: [dict(zip(shapes[n], x)) for x in page[n]] if n in shapes else page[n] for n in names}
