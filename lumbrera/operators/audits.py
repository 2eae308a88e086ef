"""Audits: is a text the document that its entry names, does an entry's content belong to its title, do a run's figures agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, WARNING, ERROR = "IDENTITY_OK", "IDENTITY_WARNING", "IDENTITY_ERROR"
# What a source's name holds, in order, and the rules for it; all others are held against the press rules.
KINDS = [("tribunal", "Competition Appeal"), ("court", "Court of Justice"), ("authority", "CNMC"), ("aggregator", "Google News")]
# Letters of title words, by rules.
LETTERS = {"authority": "a-zA-ZáéíóúÁÉÍÓÚñÑ", "press": "a-zA-Z"}
# Separators of words in names and titles.
SEPARATORS = "[\\s,.\\-]+"


def given(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def items(c: Column) -> Column:
    """A list without nulls and empty texts; a null list is empty."""
    return F.coalesce(F.filter(c, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def held(text: Column, part: Column) -> Column:
    """The text holds the part, which is not empty."""
    return (given(part) != "") & F.contains(given(text), given(part))


def same_document(citation: Column, case_numbers: Column, case_names: Column, title: Column, text: Column) -> Column:
    """Does a fetched text hold the neutral citation (without brackets), a case number, a party's word of five characters or more, or two of the title's words
    of six or more? Words may be parts of longer ones; a title word that comes twice counts twice. Null text holds nothing."""
    low = F.lower(given(text))
    plain = F.regexp_replace(F.lower(given(citation)), "[\\[\\]]", "")
    words = lambda c, n: F.filter(F.split(F.lower(c), SEPARATORS), lambda w: F.length(w) >= n)
    number = F.exists(items(case_numbers), lambda n: F.contains(low, F.lower(n)))
    party = F.exists(items(case_names), lambda name: F.exists(words(name, 5), lambda w: F.contains(low, w)))
    titled = F.size(F.filter(words(given(title), 6), lambda w: F.contains(low, w))) >= 2
    return held(low, plain) | number | party | titled


def source_kind(source: Column, is_aggregator: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, words in KINDS:
        test = F.contains(given(source), F.lit(words))
        out = out.when(test | F.coalesce(is_aggregator, F.lit(False)) if kind == "aggregator" else test, kind)
    return out.otherwise("press")


def verdict(status: Column, reason: Column) -> Column:
    return F.struct(status.alias("status"), reason.alias("reason"))


def tribunal_audit(title: Column, content: Column, plain_title: Column, plain_content: Column, citation: Column, plain_citation: Column, case_numbers: Column, plain_names: Column, content_source: Column) -> Column:
    low_title, low_content = F.lower(plain_title), F.lower(plain_content)
    cited = lambda raw, plain: held(raw, citation) | held(plain, plain_citation)
    numbered = lambda c: F.exists(items(case_numbers), lambda n: F.contains(c, n))
    first = lambda name: F.lower(F.get(F.filter(F.split(name, "\\s+"), lambda w: w != ""), F.lit(0)))
    in_title = cited(title, plain_title)
    named_title = in_title | F.exists(items(plain_names), lambda n: F.contains(low_title, F.lower(n))) | numbered(given(title))
    in_content, by_number = cited(content, plain_content), numbered(plain_content)
    by_name = F.exists(items(plain_names), lambda n: F.contains(low_content, first(n)))
    whole = given(content_source) == "cat_judgment_pdf_text"
    exact = in_content | by_number
    return (
        F.when(whole & ~exact & by_name, verdict(F.lit(WARNING), F.lit("name_without_number")))
        .when(whole & ~exact, verdict(F.lit(ERROR), F.lit("no_identifier")))
        .when(~whole & ~(exact | by_name | in_title), verdict(F.lit(WARNING), F.lit("summary_without_identifier")))
        .when(~named_title, verdict(F.lit(WARNING), F.lit("title_without_reference")))
        .otherwise(verdict(F.lit(OK), F.lit("")))
    )


def court_audit(content: Column, plain_title: Column, plain_content: Column, case_number: Column, ecli: Column) -> Column:
    """The case number, given or from the title, with or without its letter and suffix; the ECLI; or the name in the title's brackets."""
    target = F.coalesce(F.nullif(case_number, F.lit("")), F.regexp_extract(plain_title, "C-[0-9]+/[0-9]+(?:\\s+P)?", 0))
    base = F.trim(F.replace(F.replace(target, F.lit("C-"), F.lit("")), F.lit(" P"), F.lit("")))
    number = (target != "") & (F.contains(plain_content, target) | F.contains(plain_content, base))
    party = F.lower(F.regexp_extract(plain_title, "\\[([^\\]]+)\\]", 1))
    found = number | held(content, ecli) | held(plain_content, ecli) | held(F.lower(plain_content), party)
    return F.when(found, verdict(F.lit(OK), F.lit(""))).otherwise(verdict(F.lit(WARNING), F.lit("no_identifier")))


def press_audit(title: Column, content: Column, letters: str) -> Column:
    """At least a fifth of the title's words of five letters or more, or two of them, in the content."""
    low = F.lower(given(content))
    words = F.transform(F.regexp_extract_all(given(title), F.lit(f"(?U)\\b[{letters}]{{5,}}\\b"), 0), F.lower)
    matched = F.size(F.filter(words, lambda w: F.contains(low, w)))
    few = (F.size(words) > 0) & (matched < F.size(words) * 0.2) & (matched < 2)
    return (
        F.when(F.length(given(title)) < 10, verdict(F.lit(ERROR), F.lit("short_title")))
        .when(F.length(given(content)) < 50, verdict(F.lit(WARNING), F.lit("short_content")))
        .when(few, verdict(F.lit(WARNING), F.lit("low_overlap")))
        .otherwise(verdict(F.lit(OK), F.lit("")))
    )


def aggregator_audit(title: Column, url: Column) -> Column:
    return F.when(F.length(given(title)) < 5, verdict(F.lit(ERROR), F.lit("short_title"))).when(~given(url).startswith("http"), verdict(F.lit(ERROR), F.lit("bad_url"))).otherwise(verdict(F.lit(OK), F.lit("")))


def identity_audit(entries: DataFrame) -> DataFrame:
    """``audit``: struct(status, reason), beside the columns of ``entries``.

    These are source, is_aggregator, title, url, content, content_source, citation, case_numbers, case_names, case_number and ecli, and ``plain_title``, ``plain_content``,
    ``plain_citation`` and ``plain_names``, the same as ``functions.text.legal_text``. Nulls are empty.
    """
    c = F.col
    plain_title, plain_content = given(c("plain_title")), given(c("plain_content"))
    kind = source_kind(c("source"), c("is_aggregator"))
    rules = {
        "tribunal": tribunal_audit(c("title"), c("content"), plain_title, plain_content, c("citation"), c("plain_citation"), c("case_numbers"), c("plain_names"), c("content_source")),
        "court": court_audit(c("content"), plain_title, plain_content, c("case_number"), c("ecli")),
        "authority": press_audit(c("title"), c("content"), LETTERS["authority"]),
        "aggregator": aggregator_audit(c("title"), c("url")),
    }
    out = F.when(F.lit(False), verdict(F.lit(""), F.lit("")))
    for name, rule in rules.items():
        out = out.when(kind == name, rule)
    return entries.withColumn("audit", out.otherwise(press_audit(c("title"), c("content"), LETTERS["press"])))


def health_figures(runs: DataFrame, entries: DataFrame, analyses: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of figures: captured, entries, analysed, relevant, deep, model_cost, provider_cost.

    ``runs`` has fetched and provider_cost, ``analyses`` analysis_id, status and relevance, ``calls`` analysis_id, stage, status and cost. Where no run fetched anything but
    there are entries, the entries count as captured. Deep analyses are completed ones with a completed deep call.
    """
    n = entries.agg(F.count("*").alias("entries"))
    r = runs.agg(F.coalesce(F.sum("fetched"), F.lit(0)).cast("bigint").alias("fetched"), F.coalesce(F.sum("provider_cost"), F.lit(0.0)).alias("provider_cost"))
    done = analyses.where("status = 'completed'")
    a = done.agg(F.count("*").alias("analysed"), F.count_if(F.col("relevance") == "relevant").alias("relevant"))
    own = calls.join(done.select("analysis_id").distinct(), "analysis_id", "left_semi")
    deep = F.when((F.col("stage") == "deep_analysis") & (F.col("status") == "completed"), F.col("analysis_id"))
    k = own.agg(F.countDistinct(deep).alias("deep"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("model_cost"))
    one = n.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(k))  # a row each
    captured = F.when((F.col("fetched") == 0) & (F.col("entries") > 0), F.col("entries")).otherwise(F.col("fetched"))
    return one.select(captured.alias("captured"), "entries", "analysed", "relevant", "deep", "model_cost", "provider_cost")


def anomalies(figures: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule, subject): the rules that the figures break, and the sources (source, is_social, created, last_run) that have entries but no run."""
    # Costs are rounded before they are added up, as in the report.
    total = F.round(F.col("model_cost") + F.col("provider_cost"), 4)
    rules = [
        ("entries_exceed_captured", (F.col("captured") > 0) & (F.col("entries") > F.col("captured"))),
        ("negative_counts", (F.col("captured") < 0) | (F.col("entries") < 0)),
        ("deep_exceeds_relevant", F.col("deep") > F.col("relevant")),
        ("deep_exceeds_analysed", F.col("deep") > F.col("analysed")),
        ("negative_costs", (F.col("model_cost") < 0) | (F.col("provider_cost") < 0) | (total < 0)),
    ]
    broken = figures.select(F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))).alias("rule"), F.lit("pipeline").alias("subject"))
    silent = sources.where("is_social AND created > 0 AND last_run IS NULL").select(F.lit("entries_without_run").alias("rule"), F.col("source").cast("string").alias("subject"))
    return broken.unionByName(silent)
