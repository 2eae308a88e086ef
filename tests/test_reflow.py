"""Pages of PDF text and text files."""

import random

import pytest
from pyspark.sql import functions as F

from lumbrera.functions import reflow

HEALED = "Ne\nutral citation [2026] CAT 77\nBef\nore:\nSI\nR PETER ROTH\nBETW\nEEN:\nTH\nE ASSOCIATION OF CONSUMER SUPPORT\ns\nummary judgment and/or strike out\ndi\nsproportionate cost\ndis-\ntribution agreement\n"
LEGAL = "1. This is the first numbered paragraph of the ruling. It has a soft wrap\nhere that continues the sentence.\n\n2. This is the second paragraph.\n(a) First sub-clause with condition.\n(b) Second sub-clause with condition.\n(i) Sub-sub-clause in roman numeral.\n\nORDER:\n\nThe Tribunal orders as follows."
LINKS = "assess \nXXXLutz\n's proposed\nacquisition of \nPorta\n, under the \nEU Merger Regulation\n."


def test_split_words_are_put_together():
    text = "\n\n".join(reflow.page_paragraphs(HEALED))
    for part in ("Neutral citation [2026] CAT 77", "Before:", "SIR PETER ROTH", "BETWEEN:", "THE ASSOCIATION OF CONSUMER SUPPORT", "summary judgment and/or strike out", "disproportionate cost", "distribution agreement"):
        assert part in text


def test_structure_stays():
    assert reflow.page_paragraphs(LEGAL) == [
        "1. This is the first numbered paragraph of the ruling. It has a soft wrap here that continues the sentence.", "2. This is the second paragraph.", "(a) First sub-clause with condition.", "(b) Second sub-clause with condition.",
        "(i) Sub-sub-clause in roman numeral.", "ORDER:", "The Tribunal orders as follows.",
    ]
    assert reflow.page_paragraphs(LINKS) == ["assess XXXLutz's proposed acquisition of Porta, under the EU Merger Regulation."]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), (None, []), (" \n \n", []), ("one\n\n\ntwo", ["one", "two"]), ("text\n24\nmore", ["text", "24", "more"]), ("Title:\nbody goes\non", ["Title:", "body goes on"]), ("of\nthe law", ["of the law"]), ("x\nray", ["xray"]), ("a\nray", ["a ray"]),
        ("B\nEEN SO", ["BEEN SO"]), ("word-\nWord", ["word-Word"]), ("opt -out sub- paragraph ( x ) , y 's", ["opt-out sub-paragraph (x), y's"]), ("• item\n- other\n* third", ["• item", "- other", "* third"]), ("A. first\nB. second", ["A. first", "B. second"]), ("don\n't", ["don't"]),
    ],
)
def test_pages(page, want):
    assert reflow.page_paragraphs(page) == want


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        (["The court held that the", "agreement was void.\n\nNext."], [(0, "The court held that the agreement was void."), (1, "Next.")]),
        (["a distri-", "bution agreement of some length"], [(0, "a distribution agreement of some length")]),
        (["The court held that the\n12", "13\nagreement was void"], [(0, "The court held that the"), (0, "12"), (1, "13"), (1, "agreement was void")]),
        (["The court held that the\n12", "agreement was void"], [(0, "The court held that the agreement was void"), (0, "12")]),
        (["It ended.", "then more"], [(0, "It ended."), (1, "then more")]), (["It goes on", "Then a capital"], [(0, "It goes on"), (1, "Then a capital")]), (["It goes on", "(a) item"], [(0, "It goes on"), (1, "(a) item")]),
        (["of Porta,", "Lutz and others", None, "and more"], [(0, "of Porta, Lutz and others and more")]), (["one", "", "two"], [(0, "one two")]), ([], []), ([None], []),
    ],
)
def test_paragraphs_over_page_ends(pages, want):
    assert reflow.document_paragraphs(pages) == want


def test_documents(spark):
    rows = [(1, 2, "agreement was void."), (1, 1, "The court held that the"), (2, 5, None), (3, 1, "x" * 200_000 + "\nend")]
    out = reflow.documents(spark.createDataFrame(rows, "doc int, page int, text string")).orderBy("doc", "paragraph").collect()
    assert [(r["doc"], r["paragraph"], r["page"], r["text"]) for r in out] == [(1, 0, 1, "The court held that the agreement was void."), (3, 0, 1, "x" * 200_000 + " end")]


def by_hand(body: bytes, least: int, most: int) -> str | None:
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError:
        text = body.decode("latin-1")
    text = text.strip()
    if len(text) < least:
        return None
    return text if len(text) <= most else text[:most].rsplit(" ", 1)[0] + "..."


def test_text_files(spark, tmp_path):
    r = random.Random(7)
    words = ["mercado", "ñandú", "ﬁn", "日本", "a", "\n", "\t", "😀"]
    bodies = [" ".join(r.choice(words) for _ in range(r.randrange(0, 60))).encode() for _ in range(60)]
    bodies += ["résumé of the market ".encode("latin-1") * 3, b"\xff\xfe\x00", b"", b"   ", b"x" * 500, "é".encode() * 40 + b"\xc3", b"\xed\xa0\x80 surrogate bytes are no text", "   odd blanks   ".encode(), b"ends in a blank " * 7]
    for k, b in enumerate(bodies):
        (tmp_path / f"{k:03d}.txt").write_bytes(b)
    for least, most in ((10, 90), (0, 10**6), (50, 120_000)):
        got = {x["path"][-7:-4]: (x["text"], x["enough"]) for x in reflow.text_files(spark, str(tmp_path), least, most).collect()}
        want = {f"{k:03d}": by_hand(b, least, most) for k, b in enumerate(bodies) if b}
        assert {k: v[0] for k, v in got.items()} == want and all(e == (t is not None) for t, e in got.values())
