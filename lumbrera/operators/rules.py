"""Rule classifiers as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of substantive rulings, and rulings that only name themselves.
SUBSTANTIVE = ["permission to serve", "service out", "cut-off", "host cases", "umbrella proceedings", "trial 1", "trial 2", "trial 3", "opt-out", "opt-in", "class representative", "carriage dispute", "disclosure", "confidentiality", "funder", "funding", "costs reduced", "reasonable and proportionate", "economides", "merricks", "abuse of dominant", "infringement", "damages", "settlement", "distribution plan", "expert reports", "strike out", "summary judgment"]
GENERIC = r"^(ruling of the tribunal( on costs)?|judgment of the tribunal|order of the tribunal|ruling of the chair|order of the chair|judgment of the court of appeal)\.?$"

# Fixed values: (family, words in the source's name, least characters for full, least for partial).
FAMILIES = [
    ("curia", ["curia", "court of justice"], 1, None),
    ("cnmc", ["cnmc"], 300, None),
    ("ec", ["european commission"], 300, None),
    ("cat", ["cat"], None, None),
    ("oecd", ["oecd"], 500, 200),
    ("ftc", ["federal trade commission", "ftc"], 1500, 300),
    ("doj", ["antitrust division", "doj atr", "doj antitrust"], 1500, 300),
    ("linkedin", ["linkedin"], 50, 1),
]


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def sufficiency(source: Column, content: Column, pdf_text: Column | None = None) -> Column:
    """full, partial or insufficient, by the first family whose words the source's name holds."""
    name, body = F.lower(F.coalesce(source, F.lit(""))), F.regexp_replace(F.coalesce(content, F.lit("")), "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")
    n = F.length(body)
    graded = lambda full, part: F.when(n >= full, "full").when((n >= part) if part is not None else F.lit(False), "partial").otherwise("insufficient")
    low = F.lower(body)
    tribunal = F.when(n == 0, "insufficient").when((low.rlike(GENERIC) | (n < 80)) & ~any_of(low, SUBSTANTIVE), "insufficient").otherwise("partial")
    out = F.when(F.coalesce(pdf_text, F.lit(False)), "full") if pdf_text is not None else F.when(F.lit(False), "full")
    for family, words, full, part in FAMILIES:
        test = any_of(name, words) | (name.isin("doj", "doj_atr") if family == "doj" else F.lit(False))
        out = out.when(test, tribunal if family == "cat" else graded(full, part))
    return out.otherwise(graded(1500, 300))


def eligibility(current: Column, level: Column, stale: Column) -> Column:
    """Why a publication is analysed again, or not."""
    return F.when(current, "already_current").when(level == "insufficient", "insufficient").when(stale, "stale_reanalysis").when(level == "partial", "partial").otherwise("eligible")


def retry_class(error: Column, parsed: Column, out_tokens: Column) -> Column:
    return F.when(error == "grounding", "reasonable_retry").when(~parsed & (out_tokens >= 4000), "truncation").when(~parsed, "parse_error").otherwise("unknown")


def run_status(found: Column, failed: Column) -> Column:
    return F.when(failed == 0, "success").when(failed < found, "partial").otherwise("failed")


def stage_outcome(triage_ok: Column, level: Column, relevance: Column, budget_left: Column) -> Column:
    """Triage, then the deep stage for relevant texts while the budget lasts."""
    return F.when(~triage_ok, "failed").when(level == "insufficient", "skipped_insufficient").when(relevance != "relevant", "completed_triage").when(budget_left, "completed_deep").otherwise("incomplete_budget")


# Words that mark a Spanish query.
SPANISH_CUES = ["competencia", "mercado", "sanción", "concentración", "tribunal", "derecho", "comisión"]


def query_language(text: Column) -> Column:
    return F.when(any_of(F.lower(text), SPANISH_CUES), "es").otherwise("en")


# What a case page's notes say, by kind.
AUTHORITATIVE = ["reference decision", "decision published", "decision announced", "decision made", "decision issued", "phase 1 decision", "phase 2 referral", "referred to phase 2", "referral to phase 2", "final report", "provisional findings", "provisional decision", "undertakings accepted", "undertaking accepted", "acceptance of undertakings", "acceptance of final undertakings", "acceptance of interim undertakings", "interim undertakings accepted", "interim undertakings", "interim undertaking", "commitments accepted", "commitment accepted", "acceptance of commitments", "undertaking", "undertakings", "remedies working paper", "final order", "interim order", "enforcement order", "order made", "order published", "directions issued", "conduct requirement", "strategic market status", "sms designation", "statement of objections", "issues statement", "statement of issues", "working paper published", "inquiry launched", "investigation launched", "commencement notice", "director disqualification", "penalty imposed", "penalty of", "first published"]
RESPONSES = r"(?i)\bresponses?\b|\bsubmissions?\b|\brepresentations?\b|\bthird[- ]part(y|ies)\b|\broundtable summar(y|ies)\b|\bconsumer survey\b|\bhearing summar(y|ies)\b"
ADMINISTRATIVE = ["administrative timetable", "case timetable", "timetable updated", "timetable published", "timetable revised", "expected publication", "deadline extended", "contact details", "typographical", "inaccessible", "extension under section", "penalty paid", "derogation letters", "derogation letter", "derogations published", "derogation published"]
GENERAL = ["decision", "clearance", "infringement", "commencement", "launched", "order", "direction"]


def event_note(note: Column) -> Column:
    """SUBSTANTIVE, ADMINISTRATIVE or NON_SUBSTANTIVE.

    A clause that names an official act, free of response and timetable words, decides; then responses, timetables and general words do.
    """
    n = F.regexp_replace(F.lower(F.trim(F.coalesce(note, F.lit("")))), "\\s+", " ")
    official = F.exists(F.split(n, "[,;&:|–—-]|\\s+and\\s+"), lambda c: ~c.rlike(RESPONSES) & ~any_of(c, ADMINISTRATIVE) & any_of(c, AUTHORITATIVE))
    timetable = n.rlike("^(administrative timetable|case timetable|timetable updated)")
    return F.when(n == "", "NON_SUBSTANTIVE").when(official & ~timetable, "SUBSTANTIVE").when(n.rlike(RESPONSES) | any_of(n, ADMINISTRATIVE), "ADMINISTRATIVE").when(any_of(n, GENERAL), "SUBSTANTIVE").otherwise("NON_SUBSTANTIVE")
