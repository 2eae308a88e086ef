"""Which attachment a note means, and the others; what a provider is asked for."""

from pyspark.sql import functions as F

from lumbrera.operators import cases, discovery


def test_related_attachments(spark):
    events = spark.createDataFrame([("c", "e1", "Final report published", "2024-05-10"), ("c", "e2", "Phase 1 decision", "2024-05-10"), ("d", "e3", "Final report", "2024-05-10"), ("x", "e4", "Order", None)], "case string, event string, note string, at string")
    files = [("c", "a1", "Appendix to the final report", 10), ("c", "a2", "Final report", 10), ("c", "a3", "Final report (old)", 1), ("c", "a4", "Glossary of the final report", 30), ("c", "a5", "Timetable", 10), ("d", "b2", "Final report two", 9), ("d", "b1", "Final report one", 10), ("d", "b3", "Annex to the final report", 10)]
    df = spark.createDataFrame([(c, a, t, "u.pdf", "application/pdf", f"2024-05-{d:02d}") for c, a, t, d in files], "case string, attachment string, title string, url string, content_type string, at string")
    got = {r["event"]: (r["level"], r["score"], r["attachment"], r["related"]) for r in cases.match_attachments(events, df).collect()}
    assert got["e1"] == ("EXACT", 100, "a2", ["a1", "a3", "a4"])
    assert got["e3"] == ("AMBIGUOUS", 100, None, ["b1", "b2", "b3"])
    assert got["e2"] == ("NONE", None, None, []) and got["e4"] == ("NONE", None, None, [])


def test_discovery_modes(spark):
    rows = [("https://l.com/in/ann", "organization", "company_url"), ("https://l.com/company/x", " Person", "profile_url"), ("https://l.com/COMPANY/x", None, "company_url"), ("https://l.com/in/x", "", "profile_url"), ("https://l.com/company/x", "team", "company_url"), (" https://l.com/in/x ", "Institution", "company_url")]
    df = spark.createDataFrame(rows, "url string, kind string, want string")
    out = df.select("want", "url", discovery.discover_by(F.col("url"), F.col("kind")).alias("mode"), discovery.discovery_payload(F.col("url"), F.col("kind")).alias("payload")).collect()
    for r in out:
        assert r["mode"] == r["want"]
        assert r["payload"] == '[{"url":"' + r["url"].strip() + ('"}]' if r["mode"] == "company_url" else '","only_authored_posts":true}]')
