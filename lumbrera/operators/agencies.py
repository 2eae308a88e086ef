"""Rules of single sources as ordered tables: the first rule whose words a text holds gives its label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.operators import containment
from lumbrera.operators.rules import any_of

Rules = list[tuple[str, list[str]]]

# Labels and words, in order. A rule's words are alternatives; words joined by " + " must all be there.
FTC_ACTIONS: Rules = [
    ("merger_action", ["merger", "acquisition", "deal", "sale to"]),
    ("consent_order", ["consent order", "settlement", "stipulated", "order resolving", "resolves litigation", "resolving antitrust concerns"]),
    ("final_order", ["final order", "approves final"]),
    ("administrative_complaint", ["administrative complaint", "files administrative"]),
    ("court_litigation", ["amicus", "court", "litigation", "judge", "ruling", "win"]),
    ("competition_policy", ["guidelines", "policy statement", "competition policy"]),
    ("competition_guidance", ["guidance"]),
]
FTC_DOCUMENTS: Rules = [
    ("complaint", ["complaint"]), ("consent_order", ["consent", "agreement"]), ("final_order", ["stipulated", "final order"]), ("injunction", ["injunction"]),
    ("decision", ["decision", "ruling"]), ("amicus_brief", ["brief", "amicus"]),
]
DOJ_ACTIONS: Rules = [
    ("consent_decree", ["consent decree", "proposed settlement", "settles"]),
    ("plea_agreement", ["pleads guilty", "guilty plea", "plea agreement"]),
    ("criminal_conviction", ["indictment", "indicted", "jury convicts", "convicted"]),
    ("merger_challenge", ["merger + abandons", "merger + blocks", "merger + challenge"]),
    ("merger_closing_statement", ["closing of its investigation", "closing statement"]),
    ("business_review_letter", ["business review letter"]),
    ("premerger_enforcement", ["premerger", "hsr", "penalty"]),
    ("policy_statement", ["guidelines", "annual report", "call to action"]),
    ("amicus_statement_of_interest", ["statement of interest", "amicus"]),
]
CARTEL_OFFICE: Rules = [
    ("case_report", ["fallbericht"]), ("decision", ["beschluss", "/entscheidungen/"]), ("merger_control", ["fusionskontrolle", "übernahme", "erwerb", "freigabe", "zusammenschluss", "merger"]),
    ("guideline", ["merkblatt", "leitfaden"]), ("sector_inquiry", ["sektoruntersuchung", "kraftstoff", "marktuntersuchung"]), ("press_release", ["pressemitteilungen"]),
]
# Words of competition law, of consumer protection, of editorial and corporate news, and of legal and other files; labels of acts and reports.
COMPETITION = ["competition", "antitrust", "merger", "monopoly", "monopolization", "market power", "clayton act", "sherman act", "ftc act section 5", "hart-scott-rodino", "hsr", "collusion", "cartel", "price-fixing", "exclusive dealing", "non-compete", "unfair methods of competition"]
CONSUMER = ["robocalls", "do not call registry", "telemarketing scam", "debt collection fraud", "crypto scam", "imposter scam", "credit repair scam", "pyramid scheme", "refund checks to consumers", "horseracing"]
EDITORIAL = ["youtube", "jahrespressekonferenz", "stellenangebot", "karriere", "ausbildung", "festakt", "verabschiedung", "personalie", "praktikum", "social media", "veranstaltung", "grußwort", "jahresrückblick"]
LEGAL_PDF = ["complaint", "decree", "plea", "agreement", "indictment", "order", "stipulation", "settlement", "brief", "amicus", "statement", "judgment", "motion", "cis", "competitive-impact"]
NO_PDF = ["annual-report", "brochure", "flyer", "infographic", "budget", "fast-facts", "org-chart"]
CORPORATE = r"(?i)\b(appoint(s|ed|ments?)?|promot(es?|ed|ions?)|join(s|ed)?|seeks?|hiring|recruitment|associate|internship|career|nominat(ed|ions?)|rank(s|ed|ings?)?|gcr 100|best lawyers|recogni[sz]e[sd]?|recognition|awards?|shortlisted|wins? .* award|legal 500|chambers|juve|who'?s who legal|\d+ under \d+)\b"
# The division's labels of statutes and what names them.
STATUTES = [
    ("Sherman Act § 1 (Conspiracy / Cartel / Restraint of Trade)", "sherman act"), ("Sherman Act § 2 (Monopolization)", "sherman act"), ("Clayton Act § 7A (Hart-Scott-Rodino Premerger Review)", "clayton act"),
    ("Clayton Act § 7 (Substantial Lessening of Competition)", "clayton act"), ("Clayton Act § 8 (Interlocking Directorates)", "clayton act"), ("Hart-Scott-Rodino (HSR) Act", "hart-scott-rodino|hsr act"),
    ("Robinson-Patman Act", "robinson-patman act"),
]
ACTS = {"D": ("decision", "antitrust"), "MC": ("interim_measure", "interim_measures"), "DCC": ("merger_decision", "merger_control"), "A": ("opinion", "competition_policy")}
# What notes of summaries and of main documents say, by family, in order.
SUMMARIES = {
    "final_report": ["summary of final report", "summary of the final report", "summary of final decision report", "summary of report"],
    "provisional_findings": ["summary of provisional findings", "summary of the provisional findings", "summary of provisional decision"],
    "decision": ["summary of phase 1 decision", "summary of final decision", "summary of decision", "summary of infringement decision"],
    "general_summary": ["executive summary"],
}
PRIMARY = {
    "final_report": ["final report", "final decision report", "full report"],
    "provisional_findings": ["full text of provisional findings", "notice of provisional findings", "provisional findings", "provisional decision"],
    "decision": ["full text decision", "non-confidential decision", "infringement decision", "clearance decision", "final decision published", "phase 1 decision"],
}


def holds(text: Column, words: str) -> Column:
    out = F.lit(True)
    for w in words.split(" + "):
        out = out & F.contains(text, F.lit(w))
    return out


def first_label(text: Column, rules: Rules, default: str) -> Column:
    """The label of the first rule that the lower-cased text meets."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.when(F.lit(False), "")
    for label, words in rules:
        test = F.lit(False)
        for w in words:
            test = test | holds(low, w)
        out = out.when(test, label)
    return out.otherwise(default)


def consumer_only(text: Column) -> Column:
    """Consumer protection without a word of competition."""
    low = F.lower(text)
    return ~any_of(low, COMPETITION) & any_of(low, CONSUMER)


def antitrust_scope(topics: Column, components: Column, lead: Column, url: Column) -> Column:
    """A topic or component names it, or the lead of a release that no local office issued."""
    named = F.contains(F.lower(F.concat_ws(" ", topics, components)), F.lit("antitrust"))
    return named | (F.contains(F.lower(F.substring(lead, 1, 600)), F.lit("antitrust")) & ~F.contains(F.lower(url), F.lit("/usao-")))


def legal_pdf(href: Column, anchor: Column) -> Column:
    low = F.lower(href)
    return (low.endswith(".pdf") | F.contains(low, F.lit(".pdf?")) | F.contains(low, F.lit("/pdf/"))) & ~any_of(low, NO_PDF) & any_of(F.lower(F.concat_ws(" ", anchor, href)), LEGAL_PDF)


def substantive_post(category: Column, title: Column) -> Column:
    """Law-firm posts without personnel news, events and rankings."""
    c = F.lower(F.trim(category))
    always = any_of(c, ["monthly eu litigation briefing", "papers & reports", "papers and reports", "newsletters"])
    return F.when(c == "events", False).when(always, True).otherwise(~title.rlike(CORPORATE))


def statutes(text: Column) -> Column:
    """The division's labels of the statutes a text names; the section is not told apart, so one act gives all of its labels."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(pattern), label) for label, pattern in STATUTES]))


def provisions(text: Column) -> Column:
    """The commission's provisions: by act, or by the section alone where that means one act; Sherman sections only where they are named, else the act."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *words: any_of(low, list(words))
    sherman = has("sherman act")
    found = [
        (has("clayton act", "section 7"), "Clayton Act Section 7"), (has("ftc act", "section 5"), "FTC Act Section 5"), (sherman & has("section 1"), "Sherman Act Section 1"),
        (sherman & has("section 2"), "Sherman Act Section 2"), (sherman & ~has("section 1", "section 2"), "Sherman Act"), (has("hart-scott-rodino", "hsr act"), "Hart-Scott-Rodino Act"),
    ]
    return F.array_compact(F.array(*[F.when(test, label) for test, label in found]))


def act_type(official_id: Column) -> Column:
    """struct(type, family) of an authority's act number, null if it has no known series."""
    series = F.regexp_extract(F.upper(F.trim(official_id)), "^[0-9]{2}-(D|MC|DCC|A)-[0-9]+", 1)
    pick = lambda k: F.create_map(*[F.lit(x) for key, v in ACTS.items() for x in (key, v[k])])[series]
    return F.when(series != "", F.struct(pick(0).alias("type"), pick(1).alias("family")))


def milestone_family(note: Column) -> Column:
    """(derivative, family) of a case note: summaries are derivatives of a family, and no others are; null is the family of a note of neither kind."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(note, F.lit(""))), "[\\s\\p{Z}]+", " "))

    def first(phrases: dict[str, list[str]]) -> Column:
        out = F.when(F.lit(False), "")
        for name, words in phrases.items():
            out = out.when(any_of(low, words), name)
        return out

    summary = first(SUMMARIES)
    return F.struct(summary.isNotNull().alias("derivative"), F.coalesce(summary, first(PRIMARY)).alias("family"))


def docket(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)docket\s+(?:no\.|number)\s*[:\s]*([A-Za-z0-9\-:]+)", 1), F.lit(""))


def release_id(guid: Column, url: Column) -> Column:
    """An agency's external id: node number, else year, month and slug, else slug."""
    path = F.regexp_replace(F.regexp_extract(url, "^[^:]*://[^/]+/([^?#]*)", 1), "/+$", "")
    dated = F.concat_ws(":", *(F.regexp_extract(path, "(?:^|/)([0-9]{4})/([0-9]{2})/([^/]+)", k) for k in (1, 2, 3)))
    slug = F.regexp_extract(path, "([^/]*)$", 1)
    return F.concat(F.lit("ftc:competition:"), F.when(guid.rlike("^[0-9]+$"), F.concat(F.lit("node-"), guid)).when(path.rlike("(?:^|/)[0-9]{4}/[0-9]{2}/[^/]+"), dated).otherwise(F.when(slug != "", slug).otherwise("item")))


def activity_id(item: Column, url: Column) -> Column:
    """A social post's number, from its id, else from its address."""
    patterns = ["(?i)urn:li:(?:activity|share|ugcpost):([0-9]+)", "(?i)-activity-([0-9]+)", "(?i)/activity/([0-9]+)", "(?i)/update/([0-9]+)", "^([0-9]+)$"]
    return F.coalesce(*[F.nullif(F.regexp_extract(F.trim(c), p, 1), F.lit("")) for c in (item, url) for p in patterns])


def post_url(url: Column) -> Column:
    clean = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "^http://", "https://")
    return F.rtrim(F.trim(F.regexp_replace(clean, "[?#].*$", "")), F.lit("/"))


# Titles that are no part of a name.
TITLES = ["dr", "prof", "professor", "mr", "mrs", "ms", "llm", "phd", "esq", "abogado", "lic", "ing", "avocat", "rechtsanwalt"]
FROM, TO = "ıİøØłŁðÐáàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇşŞğĞšŠžŽčČ", "iioollddaaaaaaeeeeiiiiooooouuuuncaaaaaaeeeeiiiiooooouuuuncssggsszzcc"


def name_tokens(name: Column) -> Column:
    """Lower-case ASCII words of a person's name, without titles."""
    plain = F.lower(F.translate(F.replace(F.replace(F.replace(F.replace(name, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("Æ"), F.lit("ae")), F.lit("."), F.lit("")), FROM, TO))
    return F.filter(F.split(F.trim(F.regexp_replace(plain, "[^a-z0-9_]+", " ")), " "), lambda t: (t != "") & ~t.isin(*TITLES))


def same_person(expected: Column, found: Column) -> Column:
    """Equal names, or equal first and last words with all longer expected words found."""
    a, b = name_tokens(expected), name_tokens(found)
    both = (F.size(a) >= 2) & (F.size(b) >= 2)
    ends = (F.get(a, F.lit(0)) == F.get(b, F.lit(0))) & (F.element_at(a, -1) == F.element_at(b, -1))
    rest = F.size(F.array_except(F.filter(a, lambda t: F.length(t) > 1), b)) == 0
    return (F.size(a) > 0) & (F.size(b) > 0) & ((a == b) | F.coalesce(F.when(both, ends & rest), F.lit(False)))


def person_pairs(entities: DataFrame, authors: DataFrame) -> DataFrame:
    """(entity, author): all pairs of the names in the columns ``entity`` and ``author`` that are ``same_person``.

    Each name is looked up once, however many rows have it. What an entity's words ask for (the first, the last and all of more than one character) is
    joined by containment, so a first name that very many authors share makes no large group.
    """
    named = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct()
    words = name_tokens(F.col("entity"))
    asked = F.array_union(F.filter(words, lambda t: F.length(t) > 1), F.array_compact(F.array(F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1)))))
    small = named(entities, "entity").select(F.col("entity").alias("small_id"), asked.alias("elements"))
    large = named(authors, "author").select(F.col("author").alias("large_id"), name_tokens(F.col("author")).alias("elements"))
    pairs = containment.candidates(small, large).select(F.col("small_id").alias("entity"), F.col("large_id").alias("author"))
    return pairs.where(same_person(F.col("entity"), F.col("author")))


# Source routes, in order: extractor and what its address or name holds.
ROUTES: Rules = [("cnmc", ["cnmc"]), ("tribunal", ["catribunal", "competition appeal tribunal"]), ("curia", ["curia"]), ("dma", ["digital-markets-act"]), ("ec", ["ec.europa.eu", "european commission"]), ("oecd", ["oecd"]), ("cartel_office", ["bundeskartellamt"]), ("cma", ["competition-and-markets", "cma"]), ("adlc", ["autoritedelaconcurrence"]), ("ftc", ["ftc.gov"]), ("doj", ["justice.gov"])]


def keyword_score(text: Column) -> Column:
    """The deterministic stand-in for a model: 85, 55 or 25."""
    low = F.lower(text)
    return F.when(any_of(low, ["merger", "concentrac", "antitrust", "competencia", "cartel"]), 85).when(any_of(low, ["subvencion", "ayuda de estado", "state aid", "regulatorio"]), 55).otherwise(25)


# Policy areas, in the order in which a category is held against them.
POLICY_AREAS = ["antitrust", "mergers", "state aid", "cartels", "foreign subsidies", "competition law", "competition policy", "digital markets"]


def policy_area(categories: Column) -> Column:
    """The first area that the first category with one names; null if none does."""
    area = lambda c: F.get(F.filter(F.array(*map(F.lit, POLICY_AREAS)), lambda a: F.contains(F.lower(c), a)), F.lit(0))
    return F.get(F.filter(F.transform(categories, area), lambda a: a.isNotNull()), F.lit(0))
