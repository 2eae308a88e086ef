"""Listing pages: rows and fields by a declared layout, as one Arrow function per batch of pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbrera.functions.text import VOID


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)

    def walk(self):
        for p in self.parts:
            if isinstance(p, Node):
                yield p
                yield from p.walk()

    def text(self) -> str:
        return " ".join("".join(p if isinstance(p, str) else f" {p.text()} " for p in self.parts).split())

    def find(self, path: str) -> Node | None:
        """The first node of a path such as ``views-field-title a``: steps are class parts (with a dot), or tags, any depth apart."""
        return next(self.find_all(path), None)

    def find_all(self, path: str):
        step, _, rest = path.partition(" ")
        for n in self.walk():
            if (step[1:] in n.attrs.get("class", "")) if step[0] == "." else n.tag == step:
                if rest:
                    yield from n.find_all(rest)
                else:
                    yield n


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), None)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def tree(html: str) -> Node:
    t = Tree()
    t.feed(html)
    t.close()
    return t.root


# Where the pages of known sites keep their rows and fields. A field is a path and what of the node is taken: text, or an attribute.
LAYOUTS: dict[str, dict] = {
    "cnmc": {"row": ".views-row", "title": (".views-field-title a", "text"), "url": (".views-field-title a", "href"), "published": ("time", "datetime"), "category": (".views-field-field-tags", "text"), "summary": (".text-secondary", "text")},
    "tribunal": {"row": ".views-row", "title": (".readmore-group a", "text"), "url": (".readmore-group a", "href"), "published": ("time", "datetime"), "category": (".margin-compact a", "text"), "summary": (".link-summary a", "href")},
    "dma": {"row": ".ecl-content-item", "title": (".ecl-content-block__title", "text"), "url": (".ecl-content-block__title a", "href"), "published": ("time", "datetime"), "category": (".ecl-content-block__primary-meta-item", "text"), "summary": (".ecl-content-block__description", "text")},
    "law_firm": {"row": "article", "title": ("h2 a", "text"), "url": ("h2 a", "href"), "published": ("time", "datetime"), "category": (".category", "text"), "summary": ("p", "text")},
}
FIELDS = ["title", "url", "published", "category", "summary"]
ITEMS = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in FIELDS]))


def items(html: str | None, base: str, layout: dict) -> list[dict]:
    """The page's rows that have a title and an address; addresses are made absolute."""
    out = []
    for row in tree(html or "").find_all(layout["row"]):
        got = {}
        for f in FIELDS:
            path, take = layout[f]
            n = row.find(path)
            value = None if n is None else n.text() if take == "text" else n.attrs.get(take, "").strip()
            got[f] = (urljoin(base, value) if take == "href" else value) if value else None
        if got["title"] and got["url"]:
            out.append(got)
    return out


def listing(site: str):
    """A column function (html, page address) -> array of items, for a site of LAYOUTS."""
    layout = LAYOUTS[site]

    @F.pandas_udf(ITEMS)
    def parse(html: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([items(h, b or "", layout) for h, b in zip(html, base, strict=True)])

    return parse


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def definitions(html: pd.Series) -> pd.Series:
    """The terms and definitions of a page's first list of them."""

    def one(h: str | None) -> dict[str, str]:
        dl = tree(h or "").find("dl")
        return {} if dl is None else dict(zip((n.text() for n in dl.find_all("dt")), (n.text() for n in dl.find_all("dd")), strict=False))

    return html.map(one, na_action=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def links(html: pd.Series) -> pd.Series:
    """All addresses of a page's links, in order."""
    return html.map(lambda h: [n.attrs["href"] for n in tree(h or "").find_all("a") if n.attrs.get("href")], na_action=None)
