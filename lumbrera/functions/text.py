"""Text functions: quote normalisation, segmentation, HTML to text, slugs and file names."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic characters and their plain forms; spaces about punctuation and hyphens; the marker before an initial that stands alone.
PLAIN = str.maketrans({" ": " ", "“": '"', "”": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "`": "'", "–": "-", "—": "-"})
ELLIPSIS = re.compile(r"(\.{3,}|…)\s*$")
MIN_ELLIPSIS, MAX_QUOTE = 40, 500
LINE_HYPHEN = re.compile(r"(\w+)-\s*[\r\n]+\s*(\w+)")
SPACING = [(re.compile(r"\s+([,.:;!?\)\]])"), r"\1"), (re.compile(r"([\(\[])\s+"), r"\1"), (re.compile(r"(\w)\s*-\s*(\w)"), r"\1-\2")]
INITIALS = [re.compile(marker + r"([B-HJ-Z])\s+([a-z]{2,}\b)") for marker in (r"(\b\d+\.\s+)", r"(\([A-Za-z0-9]+\)\s+)")]


def for_matching(text: str, join_lines: bool = True) -> str:
    """NFKC and plain punctuation, single spaces, none inside brackets or before punctuation; words hyphenated over lines are joined."""
    out = unicodedata.normalize("NFKC", text)
    if join_lines:
        out = LINE_HYPHEN.sub(r"\1\2", out)
    out = " ".join(out.translate(PLAIN).split())
    for pattern, to in SPACING:
        out = pattern.sub(to, out)
    return out


def rejoin_initials(text: str) -> str:
    """``14. B arriers`` is ``14. Barriers``; the words A and I are left."""
    for pattern in INITIALS:
        text = pattern.sub(r"\1\2\3", text)
    return text


def readings(source: str) -> list[str]:
    """Up to four normal forms of a source text."""
    both = [for_matching(source, j) for j in (True, False)]
    return list(dict.fromkeys(x for b in both for x in (b, rejoin_initials(b)) if x))


def bare_quote(quote: str) -> str:
    q = quote.strip()
    if len(q) > 1 and q[0] == q[-1] and q[0] in "\"'`*":
        q = q[1:-1].strip()
    return q


def check_quote(quote: str | None, source: str | None, allowed: bool) -> str:
    """``ok``, or why the quote is not grounded."""
    q = bare_quote(quote or "")
    if not q:
        return "empty"
    if len(q) > MAX_QUOTE:
        return "too_long"
    if not allowed:
        return "field_not_provided"
    if (m := ELLIPSIS.search(q)) and len(q[: m.start()].strip()) >= MIN_ELLIPSIS:
        q = q[: m.start()].strip()
    q = for_matching(q)
    if not q:
        return "empty"
    low = q.lower()
    return "ok" if any(q in r or low in r.lower() for r in readings(source or "")) else "not_found"


@F.pandas_udf(T.StringType())
def quote_verdict(quote: pd.Series, source: pd.Series, allowed: pd.Series) -> pd.Series:
    return pd.Series([check_quote(*row) for row in zip(quote, source, allowed, strict=True)])


TARGET, LEAST, MOST = 140, 50, 220
#: After a paragraph: where a block may end, best first; the cut comes so many characters after the match begins, and so many are skipped.
CUTS = [(re.compile(r"\n"), 0, 1), (re.compile(r"[.?!]\s"), 1, 0), (re.compile(r"[:;]\s"), 1, 0), (re.compile(r",\s"), 1, 0), (re.compile(r"\s"), 0, 0)]


def segments(text: str) -> list[tuple[int, int]]:
    """Contiguous spans of some TARGET characters, ends trimmed, that leave out nothing but white space between them."""
    out: list[tuple[int, int]] = []
    at, n = 0, len(text)

    def put(a: int, b: int) -> None:
        trimmed = a + len(text[a:b].rstrip())
        if trimmed > a:
            out.append((a, trimmed))

    while True:
        at += len(text[at:]) - len(text[at:].lstrip()) if text[at : at + 1].isspace() else 0
        if at >= n:
            return out
        if n - at <= MOST:
            para = text.find("\n\n", at)
            if para - at < LEAST or n - para - 2 < LEAST:
                put(at, n)
                return out
            put(at, para)
            at = para + 2
            continue
        begin, end = at + LEAST, at + MOST
        para = text.find("\n\n", begin, end)
        cut, skip = (para, 2) if para >= 0 else best_cut(text, at, begin, end)
        put(at, cut)
        at = cut + skip


def best_cut(text: str, at: int, begin: int, end: int) -> tuple[int, int]:
    """Of the best kind of break in the window, the one nearest to TARGET."""
    window = text[begin:end]
    for pattern, after, skip in CUTS:
        found = [begin + m.start() + after for m in pattern.finditer(window)]
        if found:
            return min(found, key=lambda p: abs(p - at - TARGET)), skip
    return end, 0


BLOCKS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(BLOCKS)
def blocks(text: pd.Series, letter: pd.Series) -> pd.Series:
    """Numbered segments of each text: T for titles, C for contents, E for excerpts."""
    return pd.Series([[{"id": f"{x}{k:04d}", "start": a, "end": b, "text": t[a:b]} for k, (a, b) in enumerate(segments(t or ""), 1)] for t, x in zip(text, letter, strict=True)])


# Elements that hold no article text, those that end a line, and boilerplate names.
SILENT = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "svg", "button"}
BREAKS = {"p", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "tr", "article", "section", "blockquote"}
BOILERPLATE = re.compile(r"(?i)\b(ad|ads|advert|cookie|share|social|related|newsletter|breadcrumb|sidebar|comments?)\b")
VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "source", "col", "area", "base", "embed", "track", "param"}


class TextOf(HTMLParser):
    """Text of <article>, else <main>, else the body, without silent and boilerplate elements."""

    def __init__(self, only: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.only, self.depth, self.inside, self.parts = only, 0, 0, []
        self.muted: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BREAKS:
            self.parts.append("\n")
        if tag in VOID:
            return
        if tag == self.only:
            self.inside += 1
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        if self.muted:
            if tag == self.muted[0]:
                self.muted.append(tag)
        elif tag in SILENT or (names and BOILERPLATE.search(names)):
            self.muted = [tag]

    def handle_endtag(self, tag: str) -> None:
        if self.muted and tag == self.muted[0]:
            self.muted.pop()
        if tag == self.only:
            self.inside = max(0, self.inside - 1)
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.muted and (self.only is None or self.inside):
            self.parts.append(data)


def html_text(html: str | None) -> str:
    html = html or ""
    only = next((t for t in ("article", "main", "body") if f"<{t}" in html.lower()), None)
    p = TextOf(only)
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(html_text, na_action=None)


def ascii_form(text: str | None) -> str:
    return unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def topic_code(name: pd.Series) -> pd.Series:
    """ASCII words joined by underscores; ``topic`` if none is left."""
    return name.map(lambda x: re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "", ascii_form(x)).strip().lower()) or "topic", na_action=None)


@F.pandas_udf(T.StringType())
def file_slug(title: pd.Series) -> pd.Series:
    """At most 50 characters of ASCII words joined by hyphens."""
    return title.map(lambda x: re.sub(r"[^a-z0-9]+", "-", ascii_form(x).lower()).strip("-")[:50].rstrip("-") or "document", na_action=None)


def squeeze(c: Column) -> Column:
    """Line ends, no-break and zero-width spaces made plain; at most one empty line in a row."""
    for pattern, to in (("\\r\\n?", "\n"), ("\\u00a0", " "), ("\\u200b", ""), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def next_version(v: Column) -> Column:
    """v1.2 -> v1.3, v3 -> v4, anything else gets .1."""
    minor, major = F.regexp_extract(v, "^(.*v[0-9]+\\.)([0-9]+)$", 2), F.regexp_extract(v, "^(.*v)([0-9]+)$", 2)
    up = lambda digits: (digits.try_cast("int") + 1).cast("string")
    return F.when(minor != "", F.concat(F.regexp_extract(v, "^(.*v[0-9]+\\.)([0-9]+)$", 1), up(minor))).when(major != "", F.concat(F.regexp_extract(v, "^(.*v)([0-9]+)$", 1), up(major))).otherwise(F.concat(v, F.lit(".1")))


def document_title(manual: Column, embedded: Column, name: Column, fallback: str = "Untitled document") -> Column:
    """The title given by hand, else the file's own if it is one, else its cleaned name."""
    tidy = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    meta = tidy(F.coalesce(F.try_url_decode(F.replace(embedded, F.lit("+"), F.lit("%2B"))), embedded))
    meta = F.when((F.length(meta) >= 3) & ~F.lower(meta).rlike("^(untitled|sin título)"), meta)
    base = F.regexp_extract(F.regexp_replace(F.trim(name), "[?#].*$", ""), "([^/\\\\]*)$", 1)
    base = F.trim(F.coalesce(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), base))
    base = F.trim(F.regexp_replace(base, "(?i)\\.(pdf|txt|md|html|htm|doc|docx)$", ""))
    count = lambda ch: F.length(base) - F.length(F.replace(base, F.lit(ch), F.lit("")))
    base = F.when(count("_") > count(" "), F.replace(base, F.lit("_"), F.lit(" "))).otherwise(base)
    base = tidy(F.regexp_replace(base, "(?i)^([a-f0-9]{16,}|[0-9]{5,})[\\s_\\-]+", ""))
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (tidy(manual), meta, base)), F.lit(fallback))


# Dashes and quotes that legal texts use for the plain ones.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"
LEGAL_PLAIN = str.maketrans(DASHES + SINGLE_QUOTES + DOUBLE_QUOTES, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
# Names of content types in reports.
TYPE_LABELS = {
    "judicial_decision": "Resolución Judicial", "article": "Artículo Doctrinal / Noticia", "manual_upload": "Aportación Manual",
    "social_post": "Publicación Profesional", "rss_feed": "Boletín Informativo", "official_gazette": "Publicación Oficial",
}


@F.pandas_udf(T.StringType())
def legal_text(text: pd.Series) -> pd.Series:
    """NFKC, with plain dashes and quotes; null is empty."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x or "").translate(LEGAL_PLAIN))


def query_text(c: Column) -> Column:
    """White space of any script as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, "[\\s\\p{Z}]+", " "))


def type_label(kind: Column) -> Column:
    """The report's name of a content type, else the type itself with a capital; null of an empty one."""
    pairs = [F.lit(x) for kv in TYPE_LABELS.items() for x in kv]
    own = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, F.lit(2), F.length(kind))))
    return F.when(kind != "", F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(kind)), own))
