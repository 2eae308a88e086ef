"""Functions and operators on inline rows."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumbrera.functions import dates, identity, text
from lumbrera.operators import dedup, planning, rules, selection, sinks, taxonomy
from lumbrera.sources import feeds
from lumbrera.streaming import events


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_urls():
    cases = {
        "HTTPS://Example.COM/A/b/?utm_x=1&b=2&a=1&a=0&ref=z#top": "https://example.com/A/b?a=1&a=0&b=2",
        "http://x.org/": "http://x.org/", "http://x.org": "http://x.org", " http://x.org/p//?q=a%20b&k= ": "http://x.org/p?k=&q=a+b", None: "", "  ": "",
    }
    assert {k: identity.canonical_url(k) for k in cases} == cases


def test_domains(spark):
    cases = ["https://www.cnmc.es/prensa", "http://WWW.FT.COM:8080/world", "Macfarlanes", "//a.b/c", "ga-p.com", "http://user:pw@host.org/", None]
    assert values(spark, identity.publisher_domain(F.col("x")), cases) == ["cnmc.es", "ft.com", "", "a.b", "ga-p.com", "", ""]
    pairs = [("news.example.com", "example.com"), ("ec.europa.eu", "fake-ec.europa.eu"), ("example.com", "example.com.evil.test"), ("", "")]
    assert values(spark, identity.same_site(F.col("a"), F.col("b")), pairs, "a string, b string") == [True, False, False, False]


def test_titles_and_fingerprints(spark):
    assert identity.plain_title("  ﬁne — “Quoted”, title_1! ") == "fine quoted title_1"
    got = values(spark, identity.fingerprint(F.col("d"), F.col("t"), F.col("p")), [("a.b", "Big News!", ""), ("a.b", "big  news", "Z"), ("", "big news", "Paper"), ("", "big news", "")], "d string, t string, p string")
    assert got[0] == got[1] and len(set(got)) == 3


def test_quotes():
    source = "The agree-\nment was  “signed” ( today ). 14. B arriers remain."
    for quote in ("agreement was", 'was "signed" (today)', "`THE AGREEMENT`", "14. Barriers", "The agree-ment"):
        assert text.check_quote(quote, source, True) == "ok", quote
    assert text.check_quote("", source, True) == "empty" and text.check_quote("x" * 501, source, True) == "too_long"
    assert text.check_quote("signed", source, False) == "field_not_provided" and text.check_quote("not there", source, True) == "not_found"
    long = "A sentence of more than forty characters stands here."
    assert text.check_quote(long[:45] + "...", long, True) == "ok" and text.check_quote(long[:30] + "...", long, True) == "not_found"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word ", "longerword ", "end. ", "; ", ", ", "\n", "\n\n", "x" * 90, "é", "  "]), max_size=80).map("".join))
def test_segments_cover_the_text(t):
    spans = text.segments(t)
    assert all(a < b and b - a <= text.MOST and t[a:b] == t[a:b].strip() for a, b in spans)
    assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join(t.split())
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_html():
    html = '<html><body><nav>menu</nav><main><h1>Head</h1><p>One <b>two</b>.<br>Three &amp; four</p><div class="share">no</div><script>x</script></main><footer>f</footer></body></html>'
    assert text.html_text(html) == "Head\nOne two.\nThree & four" and text.html_text(None) == ""


def test_versions(spark):
    assert values(spark, text.next_version(F.col("x")), ["m-v1.9", "m-v3", "draft"]) == ["m-v1.10", "m-v4", "draft.1"]
    assert values(spark, selection.version_number(F.col("x")), ["v2.1", "v10", "none"]) == [2, 10, 0]


def test_dates(spark):
    got = values(spark, dates.parse_any(F.col("x")).cast("string"), ["Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05T10:00:00Z", "05/03/2024", "13/12/2024", "12/31/2024", "soon"])
    assert got == ["2024-03-05 10:00:00", "2024-03-05 10:00:00", "2024-03-05 00:00:00", "2024-12-13 00:00:00", "2024-12-31 00:00:00", None]
    html = ['<script>{"datePublished": "2024-01-02"}</script><time datetime="2023-01-01">', '<time datetime="2023-01-01">', "none"]
    assert values(spark, dates.page_date(F.col("x"))["label"], html) == ["json_ld", "time", None]
    assert values(spark, dates.french_date(F.col("x")), ["le 1er mars 2024", "rien"]) == [dt.date(2024, 3, 1), None]
    assert values(spark, dates.url_month(F.col("x")), ["http://x/news/2024/03/item", "http://x/2024/13/"]) == [dt.date(2024, 3, 1), None]


def test_schedule_over_clock_changes(spark):
    at = [(dt.datetime(2024, 3, 30, 12),), (dt.datetime(2024, 7, 1, 3),)]
    got = spark.createDataFrame(at, "x timestamp").select(dates.next_run(F.col("x"), 6, "Europe/Madrid").cast("string").alias("r"), dates.next_run(F.col("x"), 6, "UTC", "MON").cast("string").alias("w")).collect()
    assert [r["r"] for r in got] == ["2024-03-31 04:00:00", "2024-07-01 04:00:00"] and [r["w"] for r in got] == ["2024-04-01 06:00:00", "2024-07-01 06:00:00"]


def test_rules(spark):
    notes = ["Final report published", "Responses to provisional findings", "Final report, responses", "Administrative timetable: final report", "Non-confidential decision", "", "Lunch"]
    assert values(spark, rules.event_note(F.col("x")), notes) == ["SUBSTANTIVE", "ADMINISTRATIVE", "SUBSTANTIVE", "ADMINISTRATIVE", "SUBSTANTIVE", "NON_SUBSTANTIVE", "NON_SUBSTANTIVE"]
    rows = [("CURIA", "x"), ("curia", ""), ("Catalan News", "Ruling of the Tribunal."), ("CAT", "Ruling on disclosure"), ("OECD", "y" * 250), ("Blog", "z" * 1500), (None, None), ("LinkedIn", "w" * 60)]
    assert values(spark, rules.sufficiency(F.col("s"), F.col("c")), rows, "s string, c string") == ["full", "insufficient", "insufficient", "partial", "partial", "full", "insufficient", "full"]


TREE = [("general", None, 10), ("merger", "general", 20), ("remedies", "merger", 25), ("antitrust", "general", 30), ("private", None, 10), ("damages", "private", 15)]


def test_taxonomy(spark):
    t = spark.createDataFrame(TREE, "topic string, parent string, priority int")
    assert {r["topic"] for r in taxonomy.expand(t, "general").collect()} == {"general", "merger", "remedies", "antitrust"} and [r["topic"] for r in taxonomy.expand(t, "odd").collect()] == ["odd"]
    loop = spark.createDataFrame([("a", "b", 1), ("b", "a", 2)], t.schema)
    assert taxonomy.closure(loop).select("topic", "ancestor").distinct().count() == 4
    chosen = spark.createDataFrame([(1, "general", True, 0.9), (1, "remedies", False, 0.5), (1, "merger", False, 0.8), (1, "damages", False, 0.99), (2, "private", True, None), (2, "nowhere", False, 1.0)], "analysis int, topic string, is_primary boolean, confidence double")
    got = {(r["analysis"], r["topic"]): r["is_primary"] for r in taxonomy.canonical(chosen, t).collect()}
    assert got == {(1, "remedies"): True, (1, "damages"): False, (2, "private"): True}
    assert {r["topic"]: r["children"] for r in taxonomy.nested(t).collect()} == {"general": ["merger", "antitrust"], "private": ["damages"]}


def test_selection(spark):
    e = spark.createDataFrame([(1, "h"), (2, "h2")], "entry_id int, content_hash string")
    d = dt.date(2024, 1, 1)
    a = spark.createDataFrame([(1, "v9", "completed", "h", 50, d), (1, "v10", "completed", "h", 60, d), (1, "v11", "completed", "old", 70, d), (1, "v12", "failed", "h", None, d), (2, "v1", "completed", "stale", 9, d)], "entry_id int, version string, status string, entry_hash string, score int, created_on date")
    assert [(r["entry_id"], r["version"]) for r in selection.current_analyses(e, a).collect()] == [(1, "v10")]


def test_ladders(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", None)], "id int, k string, j string")
    got = {r["id"]: r["reason"] for r in dedup.ladder(df, "id", [F.col("id")], [("k", F.col("k")), ("j", F.col("j"))]).collect()}
    assert got == {1: "new", 2: "k", 3: "j", 4: "new"}
    plan = dedup.any_key_matches(df, df, "id", [("k", F.col("k"), F.col("k")), ("j", F.col("j"), F.col("j"))])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_plans(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(50)], "k int, v int")
    got = {r["k"]: r["before"] for r in planning.running_total(df, ["k"], "v").collect()}
    assert got == {k: sum(j % 5 for j in range(k)) for k in range(50)}
    lists = [spark.createDataFrame([(k, f"{x}{k}") for k in range(n)], "pos int, name string") for x, n in (("t", 6), ("e", 3))]
    assert [r["name"] for r in planning.interleave(*lists).orderBy("place").collect()] == ["t0", "t1", "t2", "t3", "e0", "t4", "t5", "e1", "e2"]


def test_feeds(spark):
    xml = ["<rss><channel><item><title>A - Paper</title><link>http://a</link><dc:creator>Ann</dc:creator></item><item><title>no link</title></item></channel></rss>", "<broken"]
    rows = feeds.rss_items(spark.createDataFrame([(k, x) for k, x in enumerate(xml)], "feed int, xml string")).collect()
    assert [(r["feed"], r["item"]["title"], r["item"]["creator"]) for r in rows] == [(0, "A - Paper", "Ann")]
    assert spark.createDataFrame([({"b": [1, 3], "a": [0, 2]},)], "ix map<string,array<int>>").select(feeds.abstract(F.col("ix"))).first()[0] == "a b a b"
    assert spark.createDataFrame([("A - Paper", "Paper")], "title string, publisher string").select(feeds.without_publisher(F.col("title"), F.col("publisher"))).first()[0] == "A"


def test_streams(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1 + k % 3, k % 24), k % 5, "click" if k % 2 else "error", 1.0) for k in range(60)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.windowed_counts(events.read(spark, f"{tmp_path}/in", schema))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.windowed_counts(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    for run in range(2):
        events.load_new(events.read(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", "event_id", f"{tmp_path}/check{run}")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_listings():
    from lumbrera.sources import listings

    html = '<ul><li class="views-row a"><time datetime="2024-01-02"></time><div class="readmore-group"><a href="/case/1">1234/5 Big Case</a></div><p class="margin-compact"><a href="/x.pdf">Judgment</a></p></li><li class="views-row">none</ul>'
    got = listings.items(html, "https://site.org/list", listings.LAYOUTS["tribunal"])
    assert got == [{"title": "1234/5 Big Case", "url": "https://site.org/case/1", "published": "2024-01-02", "category": "Judgment", "summary": None}]
    assert listings.items(None, "", listings.LAYOUTS["dma"]) == []


def test_catalogue_dates_and_limits(spark):
    from lumbrera.sources import api

    item = '{"DOI":"%s","title":["T"],"published":{"date-parts":[[%s]]},"author":[{"given":"A","family":"B"},{"name":"C"}]}'
    body = '{"message":{"items":[' + ",".join(item % x for x in (("future", "2030"), ("new", "2024,5"), ("mid", "2024,4,2"), ("old", "2001"))) + "]}}"
    got = api.catalogue_works(spark.createDataFrame([(1, body), (2, "no json")], "answer int, body string"), F.lit("2024-06-01").cast("date"), 365, 1).collect()
    assert [(r["external_id"], str(r["published_on"]), r["author"]) for r in got] == [("new", "2024-05-01", "A B, C")]


def test_people(spark):
    from lumbrera.operators import agencies

    rows = [("Thomas Funke", "Dr. Thomas G. Funke"), ("Pınar Öz", "pinar oz, LL.M."), ("Ann Lee", "Ann Bee"), ("Ann", "Ann Lee"), (None, "x")]
    got = values(spark, F.coalesce(agencies.same_person(F.col("a"), F.col("b")), F.lit(False)), rows, "a string, b string")
    assert got == [True, True, False, False, False]


def test_slug_dates(spark):
    rows = [("/2025_03_04_x", ""), ("/17_08_2026_x", ""), ("/08_17_26_x", ""), ("/09_10_2026_x", "vom 10.09.2026"), ("/09_10_2026_x", ""), ("/x", "17.08.2026"), ("/2025_13_40_x", ""), ("/x", "")]
    got = values(spark, dates.slug_date(F.col("u"), F.col("t")).cast("string"), rows, "u string, t string")
    assert got == ["2025-03-04 08:00:00", "2026-08-17 08:00:00", "2026-08-17 08:00:00", "2026-09-10 08:00:00", "2026-09-10 08:00:00", "2026-08-17 08:00:00", None, None]


def test_document_titles(spark):
    rows = [(" By  hand ", "m", "f"), (None, "Meta%20title", "f"), (None, "untitled", "http://x/17497725_Big_case%20name.pdf?x"), (None, None, None), ("", "ab", "C:\\dir\\note.md")]
    assert values(spark, text.document_title(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string") == ["By hand", "Meta title", "Big case name", "Untitled document", "note"]


def test_taxonomy_edits(spark):
    t = spark.createDataFrame([(a, b, True) for a, b, _ in TREE], "topic string, parent string, active boolean")
    off = taxonomy.archive(t, "merger")
    assert {r["topic"] for r in off.where("NOT active").collect()} == {"merger", "remedies"}
    assert {r["topic"] for r in taxonomy.reactivate(off, "remedies").where("NOT active").collect()} == {"merger", "remedies"}
    assert {r["topic"] for r in taxonomy.reactivate(off, "merger").where("NOT active").collect()} == {"remedies"}
    m = spark.createDataFrame([("a", "active"), ("b", "draft"), ("c", "archived")], "code string, status string")
    assert dict(map(tuple, taxonomy.activate(m, "b").collect())) == {"a": "archived", "b": "active", "c": "archived"}


def test_jobs_and_provenance(spark):
    from lumbrera.operators import news

    e = spark.createDataFrame([(1, "Z", "person", "https://l.com/Z/"), (2, "A", "institution", "http://l.com/a"), (3, "B", "person", "https://L.com/z"), (4, "N", "person", "none")], "id int, name string, kind string, url string")
    assert [(r["id"], r["priority"]) for r in news.social_jobs(e, 5).collect()] == [(2, 90), (1, 70)]
    rows = [("Ann", "1", "https://es.linkedin.com/in/ann/?x"), ("Unknown", "1", "u"), ("Ann", None, "u"), ("Ann", "1", "https://linkedin.com/in/bob")]
    got = values(spark, news.provenance(F.col("a"), F.col("e"), F.col("p"), F.array(F.lit("https://www.linkedin.com/in/ann"))), rows, "a string, e string, p string")
    assert got == ["ok", "missing_or_unreliable_author", "missing_or_unreliable_author", "author_profile_url_mismatch"]


def test_pdf_paragraphs(spark):
    from lumbrera.sources import pdf

    spans = [(1, 1, 50.0, 100.0, "First"), (1, 1, 90.0, 101.5, "line be-"), (1, 1, 50.0, 112.0, "gins here."), (1, 1, 50.0, 124.0, "Third."), (1, 1, 50.0, 160.0, "New paragraph.")]
    got = pdf.paragraphs(spark.createDataFrame(spans, "doc int, page int, x double, y double, text string")).orderBy("paragraph").collect()
    assert [r["text"] for r in got] == ["First line begins here. Third.", "New paragraph."]


def test_ftc_phrases(spark):
    from lumbrera.operators import agencies

    rows = [("An order resolving antitrust concerns",), ("Agency resolving antitrust concerns",), ("On antitrust concerns",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(agencies.first_label(F.col("t"), agencies.FTC_ACTIONS, "antitrust_enforcement")).collect()]
    assert got == ["consent_order", "consent_order", "antitrust_enforcement"]


def test_quotes_of_few_words(spark):
    from lumbrera.operators import grounding

    docs = [(1, "the quick brown fox\njumps over it all"), (2, "a quick brown foxy\nlazy dog"), (3, None), (4, "brown\njumps over")]
    quotes = [(8, ""), (9, "n"), (10, "ow"), (1, "quick brown fox"), (2, "brown"), (3, "uick brown fo"), (4, "jumps over it al"), (5, "fox\njumps"), (6, "not there at all"), (7, "the quick brown fox\njumps")]
    found = grounding.documents_with(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, quote string"))
    assert "NestedLoopJoin Inner" not in found._jdf.queryExecution().toString()
    got = {r["item_id"]: (r["n"], r["first_doc"]) for r in found.collect()}
    assert got == {k: ((len(d), min(d)) if (d := [i for i, t in docs if t is not None and q in t]) else (0, -1)) for k, q in quotes}


def test_first_of_each_new_key(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "x", 1), (3, "old", 1)], "k int, t string, o int").repartition(4)
    stored = spark.createDataFrame([(3,)], "k int")
    assert sorted(map(tuple, sinks.append_new(stored, rows, "k", ["o"]).collect())) == [(1, "b", 2), (2, "x", 1)]
    assert sorted(map(tuple, sinks.append_new(stored, rows, "k").collect())) == [(1, "a", 3), (2, "x", 1)]


def test_inspection_names_what_matched(spark):
    old = spark.createDataFrame([(1, "u1", "c1", "One"), (2, "u2", "c1", "Two"), (3, None, "", "Three")], "id int, url string, clean string, title string")
    new = spark.createDataFrame([(10, "u2", "c1"), (11, "x", "c1"), (12, None, ""), (13, "u9", None), (14, "u1", None)], "id int, url string, clean string")
    press = spark.createDataFrame([(14, 2, "presscorner")], "id int, matched_id int, reason string")
    got = dedup.inspected(new, old, [("url", F.col("url"), F.col("url")), ("clean", F.col("clean"), F.col("clean"))], press)
    assert sorted(map(tuple, got.collect())) == [(10, True, "url", 2, "Two"), (11, True, "clean", 1, "One"), (12, False, None, None, None), (13, False, None, None, None), (14, True, "presscorner", 2, "Two")]


def test_patches_of_one_key(spark):
    stored = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"x": "1"})], "k string, m map<string,string>")
    patch = spark.createDataFrame([("a", {"x": "9"}), ("a", {"x": "8"}), ("c", {"z": "1"})], "k string, m map<string,string>")
    assert {r["k"]: r["m"] for r in sinks.merge_map(stored, patch, "k", "m").collect()} == {"a": {"x": "8", "y": "2"}, "b": {"x": "1"}}
