"""Rules of quotes, identities, milestones, provisions and anomalies, a row for each case."""

import ast
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumbrera.functions import text
from lumbrera.operators import agencies, audits, cases, grounding
from lumbrera.plans.registry import QUERIES

TITLE, CONTENT = "The “Market” – a study", "Prices rose, and the agree-\nment (a « pact ») was wholly-\nowned. 14. B arriers to ‘entry’ remain; (c) T here it ends."


@pytest.mark.parametrize(
    ("quote", "source", "want"),
    [
        *((f"the {q}market{q} was", 'he said the "market" was closed', "ok") for q in "“”«»\""),
        *((f"the {q}market{q} was", "he said the 'market' was closed", "ok") for q in "‘’`'"),
        *(('the "market" was', f"he said the {q}market{q} was closed", "ok") for q in "“”«»"),
        *(("the 'market' was", f"he said the {q}market{q} was closed", "ok") for q in "‘’`"),
        *((f"2019 {d} 2021", "from 2019-2021 on", "ok") for d in "-–—"),
        ("one two", "one two", "ok"), ("ﬁne", "a fine day", "ok"), ("AGREEMENT", CONTENT, "ok"), ("agree-ment", CONTENT, "ok"), ("wholly-owned", CONTENT, "ok"), ("whollyowned", CONTENT, "ok"),
        ("14. Barriers to 'entry'", CONTENT, "ok"), ("(c) There it ends", CONTENT, "ok"), ("*Prices rose*", CONTENT, "ok"), ("Prices fell", CONTENT, "not_found"), ('""', CONTENT, "empty"), (None, CONTENT, "empty"),
        ('Prices rose, and the agree-ment (a " pact ")...', CONTENT, "ok"), ("Prices rose…", CONTENT, "not_found"), ("x" * 501, "x" * 600, "too_long"), ("x" * 500, "x" * 600, "ok"), ("a", None, "not_found"),
    ],
)
def test_spellings_of_quotes(quote, source, want):
    assert text.check_quote(quote, source, True) == want


def test_no_name_is_defined_twice():
    """A second definition of a module's name replaces the first for all code above it."""
    for path in sorted((Path(__file__).resolve().parents[1] / "lumbrera").rglob("*.py")):
        names = Counter()
        for node in ast.parse(path.read_text()).body:
            if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
                names[node.name] += 1
            elif isinstance(node, ast.Assign):
                names.update(x.id for t in node.targets for x in ast.walk(t) if isinstance(x, ast.Name))
            elif isinstance(node, ast.AnnAssign):
                names[node.target.id] += 1
        assert [n for n, k in names.items() if k > 1] == [], path


def test_fields_that_were_given(spark):
    entries = spark.createDataFrame([(1, TITLE, CONTENT, "An excerpt"), (2, " ", None, "An excerpt"), (3, TITLE, " \n", None), (4, None, "", " ")], "entry_id int, title string, content string, excerpt string")
    asked = [(1, "title", "the 'market'", "not_found"), (1, "Title ", 'the "market" - a', "ok"), (1, "content", "prices", "ok"), (1, "excerpt", "excerpt", "field_not_provided"), (2, "title", "x", "field_not_provided"),
             (2, "EXCERPT", "an excerpt", "ok"), (2, "content", "x", "field_not_provided"), (3, "excerpt", "x", "field_not_provided"), (3, "content", "x", "field_not_provided"), (4, "title", "x", "field_not_provided"),
             (1, "summary", "x", "field_not_provided"), (1, None, "x", "field_not_provided"), (9, "title", "x", "field_not_provided"), (9, "title", "''", "empty"), (1, "content", None, "empty")]
    found = grounding.verified(spark.createDataFrame(asked, "entry_id int, field string, quote string, want string"), entries)
    assert found.columns == ["entry_id", "field", "quote", "want", "verdict"] and found.where("verdict <> want").collect() == [] and found.count() == len(asked)


# Notes of cases with what they are: whether a summary, and of which family.
NOTES = [
    ("Final report published", False, "final_report"), ("Final decision report", False, "final_report"), ("Full report", False, "final_report"), ("Summary of final report", True, "final_report"),
    ("Summary of the final report published.", True, "final_report"), ("Summary of final decision report", True, "final_report"), ("SUMMARY OF  REPORT", True, "final_report"), ("Full text of provisional findings", False, "provisional_findings"),
    ("Notice of provisional findings", False, "provisional_findings"), ("Provisional decision published", False, "provisional_findings"), ("Summary of provisional findings", True, "provisional_findings"),
    ("Summary of the provisional findings", True, "provisional_findings"), ("Summary of provisional decision", True, "provisional_findings"), ("Summary of responses to the provisional findings", False, "provisional_findings"),
    ("Full text decision", False, "decision"), ("Non-confidential decision published", False, "decision"), ("Infringement decision", False, "decision"), ("Clearance decision", False, "decision"), ("Final decision published", False, "decision"),
    ("Phase 1 decision", False, "decision"), ("Summary of Phase 1 decision", True, "decision"), ("Summary of final decision", True, "decision"), ("Summary of decision", True, "decision"), ("Summary of infringement decision", True, "decision"),
    ("Executive summary", True, "general_summary"), ("Executive summary of the final report", True, "final_report"), ("Decision to refer", False, None), ("Final decision", False, None), ("Decision", False, None), ("Summary of hearing", False, None),
    ("Reference decision: merger referred to phase 2", False, None), ("", False, None), (None, False, None),
]


def test_milestones(spark):
    df = spark.createDataFrame(NOTES, "note string, derivative boolean, family string")
    m = agencies.milestone_family(F.col("note"))
    assert df.where(~m["derivative"].eqNullSafe(F.col("derivative")) | ~m["family"].eqNullSafe(F.col("family"))).collect() == []


def test_only_summaries_of_what_is_there_go(spark):
    at = "array<struct<at: timestamp, note: string>>"
    notes = ["Final report published", "Summary of final report published", "Summary of responses to the provisional findings published", "Executive summary of decision published", "Decision to refer", "Summary of phase 1 decision published"]
    events = F.expr("array(" + ", ".join(f"struct(timestamp'2024-05-0{9 - k}' AS at, '{n}' AS note)" for k, n in enumerate(notes)) + ")").cast(at)
    files = F.array().cast("array<struct<attachment: string, title: string, url: string, content_type: string, at: timestamp>>")
    own = spark.range(1).select(F.lit("c1").alias("case"), F.lit("A / B merger inquiry").alias("title"), F.lit("mergers").alias("case_type"), F.lit("cma_case").alias("document_type"), F.lit("body " * 400).alias("body"), F.lit(None).cast("timestamp").alias("updated_at"), events.alias("events"), files.alias("attachments"))
    # Each event is the latest in a case of its own beside the final report, so that its own text is full.
    kept = set()
    for k, n in enumerate(notes):
        two = own.withColumn("events", F.expr(f"array(struct(timestamp'2024-05-09' AS at, '{n}' AS note), struct(timestamp'2024-05-08' AS at, 'Final report published' AS note))").cast(at))
        out = cases.case_milestones(two, spark.createDataFrame([], "attachment string, text string"), F.lit("2024-01-01").cast("timestamp")).where("pos = 0")
        kept |= {k} if out.count() else set()
    assert {notes[k] for k in range(len(notes)) if k not in kept} <= {"Summary of final report published", "Summary of responses to the provisional findings published"} and 1 not in kept
    assert {0, 4, 5} <= kept


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("Section 5 of the FTC Act; Sherman Act section 2", ["FTC Act Section 5", "Sherman Act Section 2"]), ("in violation of Section 7", ["Clayton Act Section 7"]), ("the Clayton Act", ["Clayton Act Section 7"]), ("under section 5", ["FTC Act Section 5"]),
        ("the Sherman Act", ["Sherman Act"]), ("Section 1 of the Sherman Act and Section 2", ["Sherman Act Section 1", "Sherman Act Section 2"]), ("section 1 alone", []), ("HSR Act", ["Hart-Scott-Rodino Act"]),
        ("Hart-Scott-Rodino filing under the Clayton Act", ["Clayton Act Section 7", "Hart-Scott-Rodino Act"]), ("section 12 of the sherman act", ["Sherman Act Section 1"]), ("", []), (None, []),
    ],
)
def test_provisions(spark, words, want):
    assert spark.createDataFrame([(words,)], "x string").select(agencies.provisions(F.col("x"))).first()[0] == want


def test_same_document(spark):
    judgment = "Neutral citation 2026] CAT 67. Case No: 1597/5/7/23. Between Gormsen and Meta Platforms."
    rows = [
        ("[2026] CAT 67", [], [], "", "neutral citation: 2026 cat 67 handed down", True), ("[2026] CAT 67", [], [], "", judgment, False), (None, ["1597/5/7/23"], None, None, judgment, True), ("", ["1598/5/7/23", ""], [], "", judgment, False),
        ("", [], ["Dr. Liza Lovdahl Gormsen v Meta"], "", judgment, True), ("", [], ["Meta v X"], "", judgment, False), ("", [], [], "Between platforms", judgment, True), ("", [], [], "Gormsen ruling", judgment, False), ("", [], [], "Gormsen, Gormsen", judgment, True),
        ("", [None], [None, ""], "", judgment, False), (None, None, None, None, None, False), ("", [], [], "Platform betwee", "x " * 5000 + judgment, True),
    ]
    df = spark.createDataFrame(rows, "citation string, numbers array<string>, names array<string>, title string, body string, want boolean")
    c = F.col
    assert df.where(audits.same_document(c("citation"), c("numbers"), c("names"), c("title"), c("body")) != c("want")).collect() == []


AUDITED = "source string, is_aggregator boolean, title string, url string, content string, content_source string, citation string, case_numbers array<string>, case_names array<string>, case_number string, ecli string, want string"
PDF = "cat_judgment_pdf_text"
CAT, CJ, NC, GN, EC = "Competition Appeal Tribunal", "Court of Justice (CURIA)", "CNMC", "Google News - Merger", "European Commission"


def row(source, title, content, want, url="https://x", kind="", citation="", numbers=(), names=(), number="", ecli="", aggregator=False):
    return (source, aggregator, title, url, content, kind, citation, list(numbers), list(names), number, ecli, want)


AUDIT_ROWS = [
    row(CAT, "[2026] CAT 67 - Gormsen", "Judgment [2026] CAT 67", "IDENTITY_OK ", kind=PDF, citation="[2026] CAT 67"),
    row(CAT, "Gormsen v Meta", "Gormsen alone is named", "IDENTITY_WARNING name_without_number", kind=PDF, citation="[2026] CAT 67", names=["Gormsen v Meta"]),
    row(CAT, "Gormsen v Meta", "another text", "IDENTITY_ERROR no_identifier", kind=PDF, citation="[2026] CAT 67", names=["Gormsen v Meta"]),
    row(CAT, "Ruling", "Case 1597/5/7/23", "IDENTITY_WARNING title_without_reference", kind=PDF, numbers=["1597/5/7/23"]),
    row(CAT, "Ruling", "nothing", "IDENTITY_WARNING summary_without_identifier", numbers=["1597/5/7/23"]),
    row(CAT, "[2026] CAT 67", "nothing", "IDENTITY_OK ", citation="[2026] CAT 67"),
    row(CAT, "Case 1597–5", "1597-5 heard", "IDENTITY_WARNING title_without_reference", numbers=["1597-5"]),
    row(CJ, "Case C‑60/25 [Acme] opinion", "In Case C-60/25 the Court", "IDENTITY_OK "), row(CJ, "Case C-60/25 P", "joined 60/25 and others", "IDENTITY_OK "), row(CJ, "Case C-60/25", "C-61/25", "IDENTITY_WARNING no_identifier"),
    row(CJ, "Opinion [Acme]", "about ACME and others", "IDENTITY_OK "), row(CJ, "Opinion", "ECLI:EU:C:2025:1", "IDENTITY_OK ", ecli="ECLI:EU:C:2025:1"), row(CJ, "Opinion", "text", "IDENTITY_WARNING no_identifier"), row(CJ, "Opinion", "in T-1/20", "IDENTITY_OK ", number="T-1/20"),
    row(NC, "Breve", "x" * 60, "IDENTITY_ERROR short_title"), row(NC, "La CNMC multa", "corto", "IDENTITY_WARNING short_content"), row(NC, "Sanción energética máxima para compañía eléctrica", "nada de eso " * 10, "IDENTITY_WARNING low_overlap"),
    row(NC, "Sanción energética máxima para compañía eléctrica", "la sanción " * 10, "IDENTITY_OK "), row(NC, "12 y 13 de 14", "x" * 60, "IDENTITY_OK "),
    row(EC, "Commission clears merger of airlines today", "unrelated words stand here and here and here again and again", "IDENTITY_WARNING low_overlap"), row(EC, "Commission clears merger", "The Commission has cleared the merger of two companies, it said.", "IDENTITY_OK "),
    row(EC, None, None, "IDENTITY_ERROR short_title"), row(GN, "News", "", "IDENTITY_ERROR short_title"), row(GN, "Merger cleared", "", "IDENTITY_ERROR bad_url", url="ftp://x"), row(GN, "Merger cleared", None, "IDENTITY_OK "), row("Paper", "Merger cleared", None, "IDENTITY_OK ", aggregator=True),
]


def test_identity_audits(spark):
    df = spark.createDataFrame(AUDIT_ROWS, AUDITED)
    names = F.filter(F.split(text.legal_text(F.array_join("case_names", "\n")), "\n"), lambda n: n != "")
    df = df.select("*", text.legal_text(F.col("title")).alias("plain_title"), text.legal_text(F.col("content")).alias("plain_content"), text.legal_text(F.col("citation")).alias("plain_citation"), names.alias("plain_names"))
    out = audits.identity_audit(df).select("title", "content", "want", F.concat_ws(" ", "audit.status", "audit.reason").alias("got")).collect()
    assert [r for r in out if r["want"] != r["got"]] == [] and len(out) == len(AUDIT_ROWS)


def test_anomalies(spark):
    def broken(fetched, entries, analyses, calls, sources=(), cost=0.0):
        runs = spark.createDataFrame([(f, cost) for f in fetched], "fetched int, provider_cost double")
        a = spark.createDataFrame(analyses, "analysis_id int, status string, relevance string")
        k = spark.createDataFrame(calls, "analysis_id int, stage string, status string, cost double")
        s = spark.createDataFrame(list(sources), "source string, is_social boolean, created int, last_run string")
        return sorted(tuple(r) for r in audits.anomalies(audits.health_figures(runs, spark.range(entries), a, k), s).collect())

    pipe = lambda *rules: sorted((r, "pipeline") for r in rules)
    good = [(1, "completed", "relevant"), (2, "completed", "uncertain"), (3, "failed", "relevant")]
    deep = lambda *ids: [(i, "deep_analysis", "completed", 0.01) for i in ids]
    assert broken([5, 5], 4, good, deep(1, 1)) == []
    assert broken([2], 4, good, deep(1)) == pipe("entries_exceed_captured")
    assert broken([0], 4, good, []) == [] and broken([], 4, [], []) == []  # nothing fetched: entries count as captured
    assert broken([-3], 0, good, []) == pipe("negative_counts")
    assert broken([9], 1, good, deep(1, 2)) == pipe("deep_exceeds_relevant")
    assert broken([9], 1, good, deep(1, 3)) == [] and broken([9], 1, good, [(2, "deep_analysis", "failed", 0.0)]) == []
    assert broken([9], 1, good, deep(1), cost=-1.0) == pipe("negative_costs") and broken([9], 1, good, [(1, "triage", "completed", -2.0)]) == pipe("negative_costs")
    social = [("a", True, 3, None), ("b", True, 0, None), ("c", False, 3, None), ("d", True, 3, "2024-01-01")]
    assert broken([9], 1, good, [], social) == [("entries_without_run", "a")]


def test_queries_reach_the_verdicts(spark):
    """The registered queries do not only give one answer."""
    sf = "/root/testdata/sf0.001"
    assert QUERIES["quote_verdicts"](spark, sf).select("verdict").distinct().count() == 5
    assert QUERIES["identity_audit"](spark, sf).select("audit").distinct().count() >= 6 and QUERIES["pdf_identity"](spark, sf).select("same_document").distinct().count() == 2
