"""Article pages, their dates, and discovery, on inline rows."""

import datetime as dt

from pyspark.sql import functions as F

from lumbrera.functions import dates, text
from lumbrera.operators import discovery
from lumbrera.sources import bodies


def test_bodies_without_a_body():
    assert bodies.press_body("<p>x</p>") == (None, None, None)
    assert bodies.judgment_summary("") == (None, None, None)
    assert bodies.act_text("") == ("", None, None)
    assert bodies.court_document("  ") == (None, None, None)
    assert bodies.office_release("") == ("", None, None)


def test_judgment_summary_falls_back():
    assert bodies.judgment_summary("<div><div class='above-related'>A</div><h2>Summary</h2></div>")[0] == "A"
    assert bodies.judgment_summary("<article><p>B</p> c</article>")[:2] == ("B\n\nc", "B")
    assert bodies.judgment_summary("<h1>summary</h1><main>M</main>")[:2] == ("M", "M")


def test_court_documents():
    long = "(1) " + "the applicant asks for annulment " * 15
    content, excerpt, name = bodies.court_document(f"<p>[I] x</p><p>Delivered on the first day of a month in spring</p><p>a paragraph of more than thirty-five letters</p><div><p>{long}<br>end</p></div>")
    assert name is None and excerpt.startswith("(1) the applicant") and excerpt.endswith("...") and len(excerpt) <= 403 and content.count("\n\n") == 3
    assert bodies.court_document("plain\n\n\n\ntext") == ("plain\n\ntext", None, None)


def test_bodies_of_null_pages(spark):
    df = spark.createDataFrame([(None,), ("<main>x</main>",)], "html string")
    assert [r[0] for r in df.select(bodies.article("tribunal")("html")["content"]).collect()] == [None, "x"]
    got = df.select(bodies.date_marks("html").alias("m")).select(dates.act_date(F.col("m"), F.lit("u"), F.lit(None).cast("string"), bodies.ACT_FIELDS, bodies.PUBLISHED_FIELDS)).collect()
    assert [r[0] for r in got] == [None, None]


def test_act_times(spark):
    rows = ["2026-09-09", "2026-09-09T10:00:00+02:00", "le 09 septembre 2026", "1er août 2024", "25 Fevrier 2026", "31 février 2026", "on 2024-01-02 at", "x", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(F.date_format(dates.act_time(F.col("x")), "yyyy-MM-dd HH")).collect()]
    assert got == ["2026-09-09 00", "2026-09-09 08", "2026-09-09 12", "2024-08-01 12", "2026-02-25 12", None, "2024-01-02 12", None, None]


def test_labels(spark):
    df = spark.createDataFrame([("ARTICLE", "a–b‘c„"), ("odd kind", None), ("", ""), (None, "x")], "k string, t string")
    assert [tuple(r) for r in df.select(text.type_label(F.col("k")), text.legal_text("t")).collect()] == [("Artículo Doctrinal / Noticia", "a-b'c\""), ("Odd kind", ""), (None, ""), (None, "x")]


def test_channels(spark):
    day = lambda d: dt.datetime(2024, 6, d)
    feed = spark.createDataFrame([("a", 0, day(29)), ("b", 1, None), ("b", 2, day(30)), ("old", 3, day(1))], "url string, pos int, published_at timestamp")
    site = spark.createDataFrame([("a", 0, day(20)), ("c", 1, day(25))], "url string, pos int, published_at timestamp")
    run = lambda days, limit=None: [(r["url"], r["channel"]) for r in discovery.from_channels(feed, site, days, F.lit(day(30)), limit).collect()]
    assert run(20) == [("c", "site_map"), ("a", "site_map"), ("b", "feed")]
    assert run(5) == [("a", "feed"), ("b", "feed")] and run(None, 1) == [("a", "feed")] and len(run(None)) == 3


def test_page_end_and_links(spark):
    items = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 2, 2), (1, 3, 9), (2, 0, None)], "q int, pos int, at int")
    assert sorted((r["q"], r["pos"]) for r in discovery.until_old(items, "q", "pos", "at", F.lit(3)).collect()) == [(1, 0), (1, 1), (2, 0)]
    a = spark.createDataFrame([(1, "news.a.org", "t"), (2, "a.org", "t"), (3, "", "t"), (4, "b.org", "t")], "entry long, domain string, title string")
    f = spark.createDataFrame([(20, "a.org", "t"), (10, "x.news.a.org", "t"), (5, "fake-a.org", "t"), (6, "", "t")], "entry long, domain string, title string")
    assert sorted(map(tuple, discovery.reciprocal_links(a, f).collect())) == [(1, "found_as", 10), (2, "found_as", 10), (10, "published_as", 2)]
