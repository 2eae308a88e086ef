"""Source-specific classifiers and identifiers, over phrases put before the publications' titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.operators import agencies as A
from lumbrera.plans.registry import query
from lumbrera.sources.tables import entries, table, with_views

PHRASES = ["Merger blocks cleared", "Consent order and settlement", "Judge hears court case, Docket No. 9-12", "Robocalls and a crypto scam", "Beschluss im Fall", "Fallbericht", "Executive pleads guilty", "Policy statement", "Horseracing budget", "Sherman Act Section 1 and HSR Act", "Partner joins team", "Summary of final report", "Merkblatt", "Nothing of note"]
NOTES_SQL = with_views("entries") + f", n AS (SELECT entry_id, {PHRASES}[CAST(entry_id % {len(PHRASES)} AS INT) + 1] || ' ' || substring(source, 1, 3) AS note FROM entries) "


def notes(spark: SparkSession, sf: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("entry_id") % len(PHRASES) + 1).cast("int"))
    return entries(spark, sf).select("entry_id", F.concat(phrase, F.lit(" "), F.substring("source", 1, 3)).alias("note"))


LABELS = {"ftc": (A.FTC_ACTIONS, "antitrust_enforcement"), "doj": (A.DOJ_ACTIONS, "press_release"), "cartel_office": (A.CARTEL_OFFICE, "other_substantive"), "pdf": (A.FTC_DOCUMENTS, "court_filing")}


@query(with_views("entries") + """SELECT entry_id,
  CASE entry_id % 14 WHEN 0 THEN 'merger_action' WHEN 1 THEN 'consent_order' WHEN 2 THEN 'court_litigation' WHEN 7 THEN 'competition_policy' ELSE 'antitrust_enforcement' END AS ftc,
  CASE entry_id % 14 WHEN 0 THEN 'merger_challenge' WHEN 6 THEN 'plea_agreement' WHEN 9 THEN 'premerger_enforcement' ELSE 'press_release' END AS doj,
  CASE entry_id % 14 WHEN 0 THEN 'merger_control' WHEN 4 THEN 'decision' WHEN 5 THEN 'case_report' WHEN 12 THEN 'guideline' ELSE 'other_substantive' END AS cartel_office,
  CASE entry_id % 14 WHEN 1 THEN 'consent_order' ELSE 'court_filing' END AS pdf FROM entries""")
def action_types(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("entry_id", *[A.first_label(F.col("note"), r, d).alias(n) for n, (r, d) in LABELS.items()])


@query(with_views("entries") + "SELECT entry_id, entry_id % 14 IN (3, 8) AS consumer_only, entry_id % 14 <> 10 AS substantive, FALSE AS editorial FROM entries")
def scope_guards(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("note")
    return notes(spark, sf).select("entry_id", A.consumer_only(n).alias("consumer_only"), A.substantive_post(F.lit("News"), n).alias("substantive"), A.any_of(F.lower(n), A.EDITORIAL).alias("editorial"))


# Acts and sections put together from a publication's number, and a docket.
BASES_SQL = with_views("entries") + """, n AS (SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN 'Sherman Act ' ELSE '' END || CASE WHEN entry_id % 3 = 0 THEN 'Section 1 ' WHEN entry_id % 3 = 1 THEN 'and SECTION 2 ' ELSE '' END
  || CASE WHEN entry_id % 5 = 0 THEN 'Clayton Act ' ELSE '' END || CASE WHEN entry_id % 7 = 0 THEN 'Section 5 ' WHEN entry_id % 7 = 1 THEN 'FTC Act ' WHEN entry_id % 7 = 2 THEN 'under section 7 ' ELSE '' END
  || CASE WHEN entry_id % 11 = 0 THEN 'HSR Act ' WHEN entry_id % 11 = 1 THEN 'Hart-Scott-Rodino ' WHEN entry_id % 11 = 2 THEN 'Robinson-Patman Act ' ELSE '' END || 'Docket No. ' || entry_id || '-' || substring(source, 1, 3) AS note FROM entries),
l AS (SELECT *, lower(note) AS low, contains(lower(note), 'sherman act') AS s, contains(lower(note), 'section 1') AS one, contains(lower(note), 'section 2') AS two, contains(lower(note), 'clayton act') AS c FROM n) """


def based(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    k = F.col("entry_id")
    part = lambda n, *texts: F.coalesce(*[F.when(k % n == i, t) for i, t in texts], F.lit(""))
    parts = [part(2, (0, "Sherman Act ")), part(3, (0, "Section 1 "), (1, "and SECTION 2 ")), part(5, (0, "Clayton Act ")), part(7, (0, "Section 5 "), (1, "FTC Act "), (2, "under section 7 ")), part(11, (0, "HSR Act "), (1, "Hart-Scott-Rodino "), (2, "Robinson-Patman Act "))]
    return e.select("entry_id", F.concat(*parts, F.lit("Docket No. "), k.cast("string"), F.lit("-"), F.substring("source", 1, 3)).alias("note"))


@query(BASES_SQL + """SELECT entry_id, array_to_string(list_filter([
  CASE WHEN s THEN 'Sherman Act § 1 (Conspiracy / Cartel / Restraint of Trade)' END, CASE WHEN s THEN 'Sherman Act § 2 (Monopolization)' END, CASE WHEN c THEN 'Clayton Act § 7A (Hart-Scott-Rodino Premerger Review)' END,
  CASE WHEN c THEN 'Clayton Act § 7 (Substantial Lessening of Competition)' END, CASE WHEN c THEN 'Clayton Act § 8 (Interlocking Directorates)' END,
  CASE WHEN regexp_matches(low, 'hart-scott-rodino|hsr act') THEN 'Hart-Scott-Rodino (HSR) Act' END, CASE WHEN contains(low, 'robinson-patman act') THEN 'Robinson-Patman Act' END], lambda x: x IS NOT NULL), '|') AS statutes,
  array_to_string(list_filter([CASE WHEN c OR contains(low, 'section 7') THEN 'Clayton Act Section 7' END, CASE WHEN contains(low, 'ftc act') OR contains(low, 'section 5') THEN 'FTC Act Section 5' END,
  CASE WHEN s AND one THEN 'Sherman Act Section 1' END, CASE WHEN s AND two THEN 'Sherman Act Section 2' END, CASE WHEN s AND NOT one AND NOT two THEN 'Sherman Act' END,
  CASE WHEN contains(low, 'hart-scott-rodino') OR contains(low, 'hsr act') THEN 'Hart-Scott-Rodino Act' END], lambda x: x IS NOT NULL), '|') AS provisions,
  nullif(regexp_extract(note, '(?i)docket\\s+(?:no\\.|number)\\s*[:\\s]*([A-Za-z0-9\\-:]+)', 1), '') AS docket FROM l""")
def legal_bases(spark: SparkSession, sf: str) -> DataFrame:
    """What two agencies make of the acts and sections that a note names, and its docket."""
    n = F.col("note")
    return based(spark, sf).select("entry_id", F.array_join(A.statutes(n), "|").alias("statutes"), F.array_join(A.provisions(n), "|").alias("provisions"), A.docket(n).alias("docket"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'interim_measure' WHEN 2 THEN 'merger_decision' WHEN 3 THEN 'opinion' END AS act, CASE p_size % 5 WHEN 0 THEN 'antitrust' WHEN 1 THEN 'interim_measures' WHEN 2 THEN 'merger_control' WHEN 3 THEN 'competition_policy' END AS family FROM part")
def act_types(spark: SparkSession, sf: str) -> DataFrame:
    series = F.element_at(F.array(*map(F.lit, ["d", "MC", "dcc", "A", "X"])), (F.col("p_size") % 5 + 1).cast("int"))
    act = A.act_type(F.concat(F.lit(" 24-"), series, F.lit("-"), F.col("p_size")))
    return table(spark, sf, "part").select("p_partkey", act["type"].alias("act"), act["family"].alias("family"))


MILESTONES = [
    "Final report", "Summary of Report", "Summary  of the final report", "Full report and annexes", "Notice of provisional findings", "Summary of provisional findings", "Summary of responses to the provisional findings",
    "Executive summary", "Phase 1 decision", "Summary of phase 1 decision", "Decision to refer", "Clearance decision", "Summary of decision and final report", "Case opened", "Final decision published", "Summary of final decision report",
]
# The families that follow from the phrases, read off by hand: one for each of the notes above.
FAMILY_SQL = [
    ("final_report", False), ("final_report", True), ("final_report", True), ("final_report", False), ("provisional_findings", False), ("provisional_findings", True), ("provisional_findings", False),
    ("general_summary", True), ("decision", False), ("decision", True), (None, False), ("decision", False), ("decision", True), (None, False), ("decision", False), ("final_report", True),
]


@query(with_views("entries") + f"""SELECT entry_id, {[x for _, x in FAMILY_SQL]}[CAST(entry_id % {len(MILESTONES)} AS INT) + 1] AS derivative,
  nullif({[x or '' for x, _ in FAMILY_SQL]}[CAST(entry_id % {len(MILESTONES)} AS INT) + 1], '') AS family FROM entries""")
def milestone_families(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of each kind, with the source's name behind them."""
    note = F.concat(F.element_at(F.array(*map(F.lit, MILESTONES)), (F.col("entry_id") % len(MILESTONES) + 1).cast("int")), F.lit(" - "), F.substring("source", 1, 3))
    m = A.milestone_family(note)
    return entries(spark, sf).select("entry_id", m["derivative"].alias("derivative"), m["family"].alias("family"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ftc:competition:node-' || page_id WHEN page_id % 3 = 1 THEN 'ftc:competition:2024:05:case-' || page_id ELSE 'ftc:competition:note-' || page_id END AS external_id FROM pages")
def external_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://x.gov/news/2024/05/case-"), k)).otherwise(F.concat(F.lit("https://x.gov/note-"), k, F.lit("/")))
    return table(spark, sf, "pages").select("page_id", A.release_id(F.when(F.col("page_id") % 3 == 0, k).otherwise("abc"), url).alias("external_id"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS activity, 'https://www.linkedin.com/posts/a-activity-' || event_id AS url FROM events")
def post_identities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    link = F.concat(F.lit("http://www.linkedin.com/posts/a-activity-"), k, F.lit("/?trk=x#y"))
    item = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("urn:li:ugcPost:"), k)).when(F.col("event_id") % 4 == 1, k)
    seen = F.when(F.col("event_id") % 4 == 2, link)
    return table(spark, sf, "events").select("event_id", A.activity_id(item, seen).alias("activity"), A.post_url(link).alias("url"))


@query("SELECT s_suppkey, s_suppkey % 3 < 2 AS same FROM supplier")
def person_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.concat(F.lit("Nº"), F.col("s_suppkey").cast("string"))
    found = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Dr. Pınar G. "), k)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("pinar "), k, F.lit(", LL.M."))).otherwise(F.concat(F.lit("Petra "), k))
    return table(spark, sf, "supplier").select("s_suppkey", A.same_person(F.concat(F.lit("Pinar "), k), found).alias("same"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'cnmc' WHEN 1 THEN 'doj' WHEN 2 THEN 'dma' ELSE 'generic' END AS extractor FROM pages")
def source_routes(spark: SparkSession, sf: str) -> DataFrame:
    host = F.element_at(F.array(*map(F.lit, ["https://www.CNMC.es/", "https://www.justice.gov/atr", "https://digital-markets-act.ec.europa.eu/", "https://blog.org/"])), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", A.first_label(host, A.ROUTES, "generic").alias("extractor"))


@query(NOTES_SQL + "SELECT entry_id, CASE WHEN contains(lower(note), 'merger') THEN 85 ELSE 25 END AS score FROM n")
def keyword_scores(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("entry_id", A.keyword_score(F.col("note")).alias("score"))
