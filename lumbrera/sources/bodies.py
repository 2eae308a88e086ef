"""Article pages of known sites: body, excerpt and the dates that stand on them, as Arrow functions per batch of pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbrera.sources.listings import Node, tree

MUTE = ("script", "style", "template")
BODY = T.StructType([T.StructField(f, T.StringType()) for f in ("content", "excerpt", "name")])

# What a cleaned page of the German office leaves out, by tag, class and words.
OFFICE_TAGS = ("nav", "footer", "script", "style", "header", "aside")
OFFICE_CLASSES = re.compile(r"c-meta|c-topline|c-teaser-newsbox|breadcrumb|cookie|social|sharing|navlang", re.I)
OFFICE_WORDS = ("cookie", "javascript", "barriere melden", "datenschutz", "impressum", "kaiser-friedrich-str")
# Tags that a cleaned act of the French authority leaves out.
ACT_TAGS = ("script", "style", "nav", "header", "footer", "form", "button")
# Blocks of a court document, what its excerpt never begins with, and bracketed words that name no case.
COURT_MUTE = ("script", "style", "link", "meta", "nav", "header", "footer")
COURT_BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "li", "blockquote")
COURT_OPENINGS = ("provisional text", "édition provisoire", "delivered on", "présentées le")
NO_CASE_NAMES = ("1", "i", "ii", "provisional text", "texte provisoire", "curia")


def strings(n: Node, mute: tuple[str, ...] = MUTE) -> Iterator[str]:
    """The node's pieces of text, in order."""
    for p in n.parts:
        if isinstance(p, str):
            yield p
        elif p.tag not in mute:
            yield from strings(p, mute)


def joined(n: Node, by: str) -> str:
    return by.join(s for s in map(str.strip, strings(n)) if s)


def classes(n: Node) -> list[str]:
    return n.attrs.get("class", "").split()


def first(root: Node, test) -> Node | None:
    return next((n for n in root.walk() if test(n)), None)


def tagged(root: Node, *tags: str) -> Node | None:
    return first(root, lambda n: n.tag in tags)


def with_excerpt(body: Node | None) -> tuple[str | None, str | None, None]:
    """The body's text, and its first paragraph up to 400 characters, else the first 300 of the text."""
    if body is None:
        return None, None, None
    content = joined(body, "\n\n") or None
    p = tagged(body, "p")
    return content, joined(p, "")[:400] if p else content[:300] if content else None, None


def press_body(html: str):
    root = tree(html)
    return with_excerpt(first(root, lambda n: "page-nw-article-body" in classes(n)) or first(root, lambda n: "field--name-body" in n.attrs.get("class", "")))


def judgment_summary(html: str):
    """What follows a heading that says summary, else the block above the related links, else the main part."""
    root = tree(html)
    above = lambda n: "above-related" in classes(n)
    body = None
    for parent in [root, *root.walk()]:
        kids = [p for p in parent.parts if isinstance(p, Node)]
        at = next((k for k, n in enumerate(kids) if n.tag in ("h2", "h3", "h4") and "summary" in "".join(strings(n)).lower()), None)
        if at is not None:
            body = kids[at + 1] if at + 1 < len(kids) else first(parent, above)
            break
    return with_excerpt(body or first(root, above) or tagged(root, "main") or tagged(root, "article"))


def office_release(html: str):
    """Paragraphs, headings and items of more than 25 characters without boilerplate."""
    root = tree(html)
    box = first(root, lambda n: n.tag == "div" and bool(re.search("article|content", n.attrs.get("class", ""), re.I))) or tagged(root, "main") or root

    def wanted(n: Node) -> Iterator[Node]:
        for p in n.parts:
            if isinstance(p, Node) and p.tag not in OFFICE_TAGS and not OFFICE_CLASSES.search(p.attrs.get("class", "")):
                yield p
                yield from wanted(p)

    def kept(n: Node) -> Node:
        """The node without what is left out inside it."""
        parts = [p if isinstance(p, str) else kept(p) for p in n.parts if isinstance(p, str) or (p.tag not in OFFICE_TAGS and not OFFICE_CLASSES.search(p.attrs.get("class", "")))]
        return Node(n.tag, n.attrs, parts)

    texts = [joined(kept(n), " ") for n in wanted(box) if n.tag in ("p", "h2", "h3", "li")]
    return "\n\n".join(t for t in texts if len(t) > 25 and not any(w in t.lower() for w in OFFICE_WORDS)), None, None


def act_text(html: str):
    """Paragraphs as runs of lines that are not empty."""
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "\n".join(strings(tree(html), ACT_TAGS)).split("\n"))
    paragraphs: list[list[str]] = [[]]
    for line in lines:
        if line:
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    return "\n\n".join(" ".join(p) for p in paragraphs if p), None, None


def court_document(html: str):
    """Innermost blocks, an excerpt from the paragraphs, and the case's usual name in brackets."""
    if not html.strip():
        return None, None, None
    root = tree(re.sub(r"<br\s*/?>", "\n", html))
    name = None
    found = re.search(r"\[([A-Za-z\s'-]{2,35})\]", "".join(strings(root, COURT_MUTE))[:1500])
    if found and found[1].strip().lower() not in NO_CASE_NAMES and not found[1].strip().lower().startswith("demande"):
        name = found[1].strip()
    body = tagged(root, "body") or root
    lines, paragraphs = [], []
    for n in body.walk():
        if n.tag in COURT_BLOCKS and tagged(n, *COURT_BLOCKS) is None:
            line = re.sub(r"[ \t\xa0]+", " ", "".join(strings(n, COURT_MUTE))).strip()
            if line:
                lines.append(line)
                if n.tag == "p" and len(line) > 35 and not line.lower().startswith(COURT_OPENINGS):
                    paragraphs.append(line)
    text = "\n\n".join(lines) if lines else re.sub(r"\n\s*\n+", "\n\n", "".join(strings(body, COURT_MUTE))).strip()
    chosen = next((p for p in paragraphs[:5] if p.startswith("(") and len(p) > 50), paragraphs[0] if paragraphs else None)
    if not text:
        return None, None, name
    return text, chosen and chosen[:400].strip() + ("..." if len(chosen) > 400 else ""), name


SITES = {"cnmc": press_body, "tribunal": judgment_summary, "office": office_release, "act": act_text, "court": court_document}


def article(site: str):
    """A column function html -> struct(content, excerpt, name) for a site of SITES; null html counts as empty."""
    read = SITES[site]

    @F.pandas_udf(BODY)
    def parse(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(h or "") for h in html], columns=BODY.names, dtype=object)

    return parse


# Where pages of the French authority hold dates.
ACT_FIELDS = ["field--name-field-date-decision", "field--name-field-date-notice", "field--name-field-date-dcc", "field--name-field-date-de-decision"]
PUBLISHED_FIELDS = ["field--name-field-date-de-publication", "field--name-field-date", "field-date-publication", "date-display-single", "views-field-created"]
NOTICE_FIELDS = ["field--name-field-date-de-publication", "field--name-field-date-decision", "field--name-field-date-notice", "field--name-field-date", "field-date-publication", "date-display-single", "views-field-created"]
METAS = [("property", "article:published_time"), ("property", "og:published_time"), ("name", "article:published_time"), ("name", "publication_date"), ("name", "dc.date"), ("name", "DC.date"), ("name", "dc.date.issued"), ("name", "date")]
LINKED = ("datePublished", "dateCreated", "dateModified")

STRINGS = T.ArrayType(T.StringType())
MARKS = T.StructType(
    [T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("heading_time", T.StringType()), T.StructField("heading", T.StringType())]
    + [T.StructField(f, STRINGS) for f in ("metas", "linked", "times")]
)


def written(n: Node) -> str:
    return n.attrs.get("datetime") or "".join(strings(n))


def linked_dates(script: str) -> list[str]:
    try:
        data = json.loads(script)
    except ValueError:
        return []
    return [str(data[k]) for k in LINKED if data.get(k)] if isinstance(data, dict) else []


def marks(html: str) -> tuple:
    root = tree(html)
    fields = {}
    for c in {*ACT_FIELDS, *PUBLISHED_FIELDS, *NOTICE_FIELDS}:
        n = first(root, lambda n, c=c: c in classes(n))
        if n is not None:
            fields[c] = written(tagged(n, "time") or n)
    h1 = tagged(root, "h1")
    title = h1 or tagged(root, "title")
    at = h1 and tagged(h1, "time")
    metas = []
    for attr, name in METAS:
        n = first(root, lambda n, attr=attr, name=name: n.tag == "meta" and n.attrs.get(attr) == name)
        if n is not None and n.attrs.get("content"):
            metas.append(n.attrs["content"])
    linked = [d for n in root.walk() if n.tag == "script" and n.attrs.get("type") == "application/ld+json" for d in linked_dates("".join(p for p in n.parts if isinstance(p, str)))]
    times = [x for n in root.walk() if n.tag == "time" for x in (n.attrs.get("datetime"), "".join(strings(n))) if x]
    return fields, at and written(at), joined(title, " ") if title else "", metas, linked, times


@F.pandas_udf(MARKS)
def date_marks(html: pd.Series) -> pd.DataFrame:
    """What a page says of its dates, unparsed, for ``functions.dates.act_date`` and ``notice_date``."""
    return pd.DataFrame([marks(h or "") for h in html], columns=MARKS.names, dtype=object)


# Where pages of the French authority name an act.
ACT_PAGE = T.StructType([T.StructField(f, T.StringType()) for f in ("address", "title", "number", "numbered", "sectors", "phase", "simplified", "outcome", "parties")])


def of_class(root: Node, *names: str) -> Node | None:
    return first(root, lambda n: any(c in classes(n) for c in names))


def field_value(root: Node, name: str) -> str | None:
    """A field's item, else the field without its label."""
    field = of_class(root, name)
    if field is None:
        return None
    item = of_class(field, "field__item", "field-item")
    if item is None or not joined(item, ""):
        item = Node(field.tag, field.attrs, [p for p in field.parts if isinstance(p, str) or "field__label" not in classes(p)])
    return joined(item, "")


def act_page(html: str) -> tuple:
    root = tree(html)
    low = html.lower()
    link = first(root, lambda n: n.tag == "link" and "canonical" in n.attrs.get("rel", "").split())
    h1, title = tagged(root, "h1"), tagged(root, "title")
    named = " ".join("".join(strings(h1)).split()) if h1 else ""
    if not named and title:
        named = re.sub(r"\s*\|\s*Autorité.*$", "", "".join(strings(title))).strip()
    number, numbered = of_class(root, "field--name-field-id", "field-id"), of_class(root, "field--name-field-numero-de-decision", "field-numero-de-decision")
    sectors = [joined(a, "") for n in root.walk() if "field--name-field-sector" in classes(n) for a in n.walk() if a.tag == "a"]
    phase = field_value(root, "field--name-field-phase-decision")
    if phase is None:
        phase = next((p for p in ("Phase 2", "Phase 1") if p.lower() in low), None)
    else:
        bare = re.sub(r"^d[eé]cision\s+de\s+phase\s*:?\s*", "", phase, flags=re.I).strip()
        phase = next((p for p in ("Phase 2", "Phase 1") if p.lower() in bare.lower()), bare or None)
    simplified = "yes" if "décision simplifiée" in low or "decision simplifiee" in low else None
    return (
        link.attrs.get("href") if link else None, named, joined(number, "") if number else "", joined(numbered, "") if numbered else None, " / ".join(sectors), phase,
        simplified, field_value(root, "field--name-field-provisions"), field_value(root, "field--name-field-parties"),
    )


@F.pandas_udf(ACT_PAGE)
def act_marks(html: pd.Series) -> pd.DataFrame:
    """What a page of the authority says of its act, for ``operators.discovery.act_pages``."""
    return pd.DataFrame([act_page(h or "") for h in html], columns=ACT_PAGE.names, dtype=object)
