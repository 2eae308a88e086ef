"""Personal data: patterns, and terms that disclose them.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Beyond them, the words of the documents with each base value are gathered
over the whole corpus: for a value e and a term t, co(e, t) counts the distinct documents in which both stand, and df(t) the distinct
documents with t. Documents of one text count once. The term discloses the value if
co >= MIN_CONTEXTS, P(e | t) = co / df >= MIN_SHARE and the normalised pointwise mutual information of e and t is
MIN_NPMI or more. Disclosing terms are spans of kind ``term`` in every document: ``sanitise`` removes those with P >= REMOVE_SHARE and
generalises the others.

Null texts count as empty and have no spans. Repeated rows get equal spans. A null doc_id stays null. With no base values or an empty
table there are no terms. ``find`` reads no other columns; ``sanitise`` keeps all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.common import bounded_batches, chunks, cut, strings, unused

KINDS = ("email", "ip", "card", "phone", "term")
MIN_CONTEXTS = 3
MIN_SHARE = 0.5
REMOVE_SHARE = 0.9
MIN_NPMI = 0.7
#: Terms sent to the executors at a time; more are handled in several passes.
MAX_TERMS = 100_000
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Every ip, card and phone match lies within one of these stretches.
STRETCH = re.compile(r"[+0-9][+0-9 ().\-]{6,}")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start; offsets in code points. A match that fails its test is dropped and not tried again."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at)):
            out.append(("email", lo, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    stretches = [(m.start(), m.group()) for m in STRETCH.finditer(text)]
    for a, s in stretches:
        out += [("ip", a + m.start(), a + m.end()) for m in IP.finditer(s) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for a, s in stretches:
        for m in CARD.finditer(s):
            d = NOT_DIGIT.sub("", m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", a + m.start(), a + m.end()))
    for a, s in stretches:
        if "+" in s:
            out += [("phone", a + m.start(), a + m.end()) for m in PHONE.finditer(s) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def value_of(kind: str, found: str) -> str:
    """The protected entity, whatever its spelling."""
    return f"{kind}:{found.lower() if kind == 'email' else found if kind == 'ip' else NOT_DIGIT.sub('', found)}"


def is_term(word: str) -> bool:
    return len(word) > 2 and not word.isdigit()


def lower(text: str) -> str:
    return text.encode().translate(LOWER).decode()


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


def values(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, text): the base values, hashed, and the hash of each text with them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 0):
                ent, mark = [], []
                for text in strings(b.column(0)).to_pylist():
                    own = {text_hash(value_of(kind, text[x:y])) for kind, x, y in base_spans(text)}
                    ent += own
                    mark += [text_hash(text)] * len(own) if own else []
                if ent:
                    yield pa.RecordBatch.from_arrays([pa.array(ent, pa.int64()), pa.array(mark, pa.int64())], ["entity", "text"])

    return docs.select(text_col).mapInArrow(work, "entity bigint, text bigint")


def parted(rows: DataFrame, key: str) -> list[DataFrame]:
    """The rows in parts of about MAX_TERMS at most."""
    n = rows.count()
    parts = -(-n // MAX_TERMS)
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) if parts > 1 else rows for k in range(parts)]


def together(docs: DataFrame, entities: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, text): the words of each text with one of the entities, those within base values left out."""
    out = None
    parts = parted(entities, "entity")
    for own in parts:
        held = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in own.collect()))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in chunks(whole, 0):
                    for text in strings(b.column(0)).to_pylist():
                        spans = base_spans(text)
                        ents = {e for kind, x, y in spans if (e := text_hash(value_of(kind, text[x:y]))) in held.value}
                        if ents:
                            terms = pa.array(sorted(words_beside(text, spans)), pa.string())
                            mark = pa.array([text_hash(text)] * len(terms), pa.int64())
                            for e in ents:
                                yield pa.RecordBatch.from_arrays([pa.array([e] * len(terms), pa.int64()), terms, mark], ["entity", "term", "text"])

        out = one_at_a_time(out, docs.select(text_col).mapInArrow(work, "entity bigint, term string, text bigint"), held, len(parts) > 1)
    return docs.sparkSession.createDataFrame([], "entity bigint, term string, text bigint") if out is None else out


def one_at_a_time(before: DataFrame | None, rows: DataFrame, held: Broadcast, several: bool) -> DataFrame:
    """The rows after those before; of several passes each is written and its broadcast given up before the next one is made."""
    if several:
        rows = cut(rows)
        held.destroy()
    return rows if before is None else before.unionAll(rows)


def words_beside(text: str, spans: list[Span]) -> set[str]:
    """The text's terms, lower-cased, that stand somewhere outside its base values."""
    out, at = set(), 0
    for x, y in [*sorted((x, y) for _, x, y in spans), (len(text), len(text))]:
        # A word that a value cuts is no term.
        found = [m for m in WORD.finditer(text, at, max(at, x)) if not (m.end() == x and x < len(text) and WORD.match(text, x)) and not (m.start() == at > 0 and WORD.match(text, at - 1))]
        out.update(w for w in {lower(m.group()) for m in found} if is_term(w))
        at = max(at, y)
    return out


def term_texts(docs: DataFrame, terms: DataFrame, exact: bool, text_col: str = "text") -> DataFrame:
    """(term, n): how many distinct texts of one task have each of the terms; with ``exact`` (term, n), n being the hash of each such text."""
    out = None
    parts = parted(terms, "term")
    for own in parts:
        held = docs.sparkSession.sparkContext.broadcast(frozenset(r[0].encode() for r in own.collect()))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            counts: dict[bytes, int] = {}
            seen: set[int] = set()
            for whole in batches:
                for b in chunks(whole, 0):
                    word, mark = [], []
                    for text in strings(b.column(0)).to_pylist():
                        own = text_hash(text)
                        if own in seen:
                            continue
                        seen.add(own)
                        for w in held.value.intersection(text.encode().translate(FOLD).split()):
                            if exact:
                                word.append(w.decode())
                                mark.append(own)
                            else:
                                counts[w] = counts.get(w, 0) + 1
                    if word:
                        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(mark, pa.int64())], ["term", "n"])
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])

        out = one_at_a_time(out, docs.select(text_col).mapInArrow(work, "term string, n bigint"), held, len(parts) > 1)
    return docs.sparkSession.createDataFrame([], "term string, n bigint") if out is None else out


def disclosing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, share): the terms that disclose a base value, with the highest P(e | t)."""
    bounded_batches(docs.sparkSession)
    # A value of fewer documents cannot reach MIN_CONTEXTS with any term.
    per_entity = cut(values(docs, text_col).distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= MIN_CONTEXTS))
    seen = together(docs, per_entity.select("entity"), text_col).distinct()
    co = cut(seen.groupBy("entity", "term").agg(F.count("*").alias("co")).where(F.col("co") >= MIN_CONTEXTS))
    # The distinct texts of a task are no more than those of all: most common words leave here.
    most = co.groupBy("term").agg(F.max("co").alias("co"))
    least = term_texts(docs, most.select("term"), False, text_col).groupBy("term").agg(F.max("n").alias("n"))
    rare = cut(most.join(least, "term").where(F.col("co") >= MIN_SHARE * F.col("n")).select("term"))
    df = term_texts(docs, rare, True, text_col).distinct().groupBy("term").agg(F.count("*").alias("df"))
    total = docs.select(F.xxhash64(F.coalesce(text_col, F.lit("")))).distinct().count()
    share = F.least(F.lit(1.0), F.col("co") / F.col("df"))
    pmi = F.log2(F.col("co") * F.lit(float(total)) / (F.col("df") * F.col("n_e")))
    npmi = pmi / F.greatest(F.log2(F.lit(float(total)) / F.col("co")), F.lit(1e-9))
    return co.join(per_entity, "entity").join(df, "term").where((share >= MIN_SHARE) & (npmi >= MIN_NPMI)).groupBy("term").agg(F.max(share).alias("share"))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,share:double>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: base spans and disclosing terms (with their P(e | t) as share), by kind as listed, then start."""
    found = spans_of(docs.select(id_col, text_col), cut(disclosing(docs, text_col)), text_col, "spans")
    return found.select(id_col, "spans")


def spans_of(docs: DataFrame, terms: DataFrame, text_col: str, name: str) -> DataFrame:
    """The documents with their spans under ``name``.

    Each pass over the texts looks for about MAX_TERMS terms at most. Of several passes each is written and its terms given up before
    the next one starts, so that executors hold one such set at a time.
    """
    parts = parted(terms, "term") or [terms]
    out = docs
    for k, own in enumerate(parts):
        held = docs.sparkSession.sparkContext.broadcast({r[0].encode(): r[1] for r in own.collect()})
        out = out.withColumn(name, marker(held, k == 0)(F.col(text_col), F.col(name) if k else F.lit(None).cast(SPANS)))
        if len(parts) > 1:
            out = cut(out)
            held.destroy()
    return out


def marker(held, base: bool):
    @F.pandas_udf(SPANS)
    def mark(texts: pd.Series, before: pd.Series) -> pd.Series:
        terms, out = held.value, []
        flagged = frozenset(terms)
        for text, had in zip(texts, before, strict=True):
            text = text or ""
            spans = [(*s, None) for s in base_spans(text)] if base else [(s["kind"], s["start"], s["end"], s["share"]) for s in had]
            if flagged and not flagged.isdisjoint(text.encode().translate(FOLD).split()):
                own = sorted((x, y) for kind, x, y, _ in spans if kind != "term")
                spans = spans + [("term", m.start(), m.end(), terms[w]) for m in WORD.finditer(text) if (w := lower(m.group()).encode()) in terms and not any(a < m.end() and m.start() < b for a, b in own)]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
            out.append([{"kind": k, "start": x, "end": y, "share": p} for k, x, y, p in spans])
        return pd.Series(out)

    return mark


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with base values replaced by their kind in brackets, disclosing terms by ``[TERM]`` or by nothing."""
    terms, name = cut(disclosing(docs, text_col)), unused(docs, "_spans")

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is None or not len(own):
                out.append(text)
                continue
            parts, at = [], 0
            for x, y, kind, share in sorted((s["start"], s["end"], s["kind"], s["share"] or 0.0) for s in own):
                if x >= at:
                    parts += [text[at:x], "" if share >= REMOVE_SHARE else f"[{kind.upper()}]"]
                at = max(at, y)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out)

    return spans_of(docs, terms, text_col, name).withColumn(text_col, rewrite(F.col(text_col), F.col(name))).drop(name)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from ``find``."""
    found = find(docs)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
