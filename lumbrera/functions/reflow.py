"""Text of PDF pages: split words, drop caps and soft line ends mended, paragraphs put together over the ends of pages; and text files of unknown encoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short words that stand alone; what begins a list item, a heading or a numbered paragraph; endings that belong to the word before; spaces
# about punctuation, possessives, brackets and hyphens.
STANDALONE = {"a", "an", "in", "on", "at", "to", "by", "for", "of", "or", "and", "the", "is", "it", "as", "if", "be", "he", "we", "el", "la", "en", "de", "un", "y", "o", "del", "al"}
ALONE_LETTERS = {"a", "i", "y", "o"}
STRUCTURE = re.compile(r"^(?:\d+[\.\)]|\([a-z\divxlcdm]+\)|[A-Z]\.|•|\-|\*|[A-Z\s]{4,}:|[A-Z\s]{5,}$)")
ATTACHED = re.compile(r"^(?:[,.:;?!]|['’](?:s|re|ve|ll|d|m|t)\b)")
PAGE_NUMBER, FRAGMENT, SHORT_LINE = re.compile(r"^\d{1,4}$"), re.compile(r"^[A-Za-z]{1,4}$"), 40
INLINE = [
    (re.compile(r"[ \t]+([,.:;?!])"), r"\1"), (re.compile(r"[ \t]+(['’]s\b)"), r"\1"), (re.compile(r"\(\s+"), "("), (re.compile(r"\s+\)"), ")"),
    (re.compile(r"(\b[A-Za-z0-9]+)\s+-\s*([A-Za-z0-9]+\b)"), r"\1-\2"), (re.compile(r"(\b[A-Za-z0-9]+)-\s+([A-Za-z0-9]+\b)"), r"\1-\2"), (re.compile(r"[ \t]+"), " "),
]
#: Characters of a text that is of use, and those that are kept of a longer one.
LEAST, MOST = 50, 120_000
ENDS = tuple(".:;?!")


def inline(text: str) -> str:
    for pattern, to in INLINE:
        text = pattern.sub(to, text)
    return text.strip()


def joined(line: str, following: str) -> str | None:
    """The two lines as one without a blank, if the second goes on with the first's last word; else None."""
    if ATTACHED.match(following):
        return line + following
    if FRAGMENT.match(line) and line.lower() not in STANDALONE:
        if "a" <= following[0] <= "z":
            return line + following
        if line.isupper() and "A" <= following[0] <= "Z":
            return line + following
    elif len(line) == 1 and line.isalpha() and line.lower() not in ALONE_LETTERS and re.match(r"[a-z]{2}", following):
        return line + following
    if len(line) > 1 and line[-1] == "-" and line[-2].isalpha() and "a" <= following[0] <= "z":
        return line[:-1] + following
    return None


def mended(lines: list[str]) -> Iterator[str]:
    """Lines with those that are parts of one word put together, each with the one after it at most; empty lines stay."""
    at = 0
    while at < len(lines):
        both = joined(lines[at], lines[at + 1]) if at + 1 < len(lines) and lines[at] and lines[at + 1] else None
        yield lines[at] if both is None else both
        at += 1 if both is None else 2


class Reflow:
    """Lines in, paragraphs out. The one that is open stays open until something ends it."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.done: list[str] = []

    def close(self) -> None:
        if self.open and (text := inline(" ".join(self.open))):
            self.done.append(text)
        self.open = []

    def line(self, line: str) -> None:
        if not line:
            self.close()
        elif PAGE_NUMBER.match(line):
            self.close()
            self.done.append(line)
        else:
            titled = bool(self.open) and len(self.open[-1]) < SHORT_LINE and self.open[-1][-1] in ".:"
            if STRUCTURE.match(line) or titled:
                self.close()
            self.open.append(line)


def page_lines(text: str | None) -> list[str]:
    lines = [x.strip() for x in (text or "").splitlines()]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def page_paragraphs(text: str | None) -> list[str]:
    """The paragraphs of one page."""
    flow = Reflow()
    for line in mended(page_lines(text)):
        flow.line(line)
    flow.close()
    return flow.done


def goes_on(before: str, after: str) -> bool:
    """Does a page begin in the middle of the last paragraph of the one before? Not after a full stop, nor before an item, a heading or a capital."""
    return before[-1] not in ENDS and not PAGE_NUMBER.match(before) and not STRUCTURE.match(after) and (after[0].islower() or before[-1] in "-,")


def document_paragraphs(pages: list[str | None]) -> list[tuple[int, str]]:
    """(page it begins on, paragraph) over all pages, in order. Numbers at the ends of pages stand aside; a word or sentence that a page's end cuts is put together."""
    out: list[tuple[int, str]] = []
    for number, page in enumerate(pages):
        for k, text in enumerate(page_paragraphs(page)):
            last = next((n for n in range(len(out) - 1, -1, -1) if not PAGE_NUMBER.match(out[n][1])), None)
            if k == 0 and last is not None and out[last][0] < number and not PAGE_NUMBER.match(text) and goes_on(out[last][1], text):
                page_at, before = out[last]
                hyphen = before[-1] == "-" and len(before) > 1 and before[-2].isalpha() and text[0].islower()
                out[last] = page_at, inline(before[:-1] + text if hyphen else f"{before} {text}")
            else:
                out.append((number, text))
    return out


PARAGRAPHS = T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(PARAGRAPHS)
def reflowed(pages: pd.Series) -> pd.Series:
    """Paragraphs of documents given as arrays of pages, which are read one after another; null and empty ones have none."""
    return pages.map(lambda p: [{"page": n, "text": t} for n, t in document_paragraphs([] if p is None else list(p))])


def documents(pages: DataFrame) -> DataFrame:
    """(doc, paragraph, page, text) of ``pages`` (doc, page, text): each document's pages are gathered in order (a document is one row's worth of text)."""
    own = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    found = own.select("doc", "p", F.posexplode(reflowed(F.transform("p", lambda x: x["text"]))).alias("paragraph", "r"))
    return found.select("doc", "paragraph", F.col("p")[F.col("r.page")]["page"].alias("page"), F.col("r.text").alias("text"))


def decoded(body: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Latin-1, in which every byte is a character."""
    return F.when(F.is_valid_utf8(body), F.decode(body, "UTF-8")).otherwise(F.decode(body, "ISO-8859-1"))


def plain_text(body: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text of a file, without white space at its ends; null if it has fewer than ``least`` characters; one of over ``most`` is cut at the last blank before
    that, if there is one, and ends in three dots."""
    text = F.regexp_replace(decoded(body), r"(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$".replace("\\\\", "\\"), "")
    head = F.substring(text, 1, most)
    words = F.regexp_replace(head, "(?s) [^ ]*$", "")
    return F.when(F.length(text) < least, None).when(F.length(text) > most, F.concat(words, F.lit("..."))).otherwise(text)


def text_files(spark: SparkSession, path: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(path, text, enough) of the files under a path, whole files being read as bytes. Files without a byte have no row."""
    files = spark.read.format("binaryFile").load(path)
    text = plain_text(F.col("content"), least, most)
    return files.select("path", text.alias("text")).withColumn("enough", F.col("text").isNotNull())
