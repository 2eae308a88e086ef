"""Each operator against brute force, libraries or round trips, on small texts."""

import hashlib
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import Broadcast
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumbrera.llm import arrow_shards, decontaminate, licence_scan, line_dedup, passages, piece_codec, privacy, quality, simhash, sketch
from lumbrera.llm.components import components
from lumbrera.llm.licence_texts import TEXTS, templates

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LIB = sentencepiece.SentencePieceProcessor(model_file=PIECES)
CODEC = piece_codec.PieceCodec(open(PIECES, "rb").read())
CACHE = arrow_shards.WordCache(open(WORDS, encoding="utf-8").read())
DOCS = "doc_id bigint, text string"
PARTS = st.lists(st.sampled_from(["a", "the", "ing", " ", "   ", "▁", "\n", "é", "É", "日本", "😀", "=", "x", "0", "<s>", "\t", "ation", "'s", "..", ",", "<|endoftext|>", "İ", "́", "Ab", "\x00"]), max_size=30).map("".join)


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@settings(max_examples=300, deadline=None)
@given(PARTS | st.text(max_size=60))
def test_pieces_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = LIB.encode(text)
    assert CODEC.encode(pa.array([text]))[0].tolist() == ids
    assert CODEC.decode(np.array([1, *ids, 2], np.int32), np.array([len(ids) + 2]))[0].decode() == LIB.decode([1, *ids, 2])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 13, 259, 260, 264, 300, 154, 167, 168, 233, 243, 28705, 29871]), max_size=12))
def test_pieces_decode_any_ids(ids):
    assert CODEC.decode(np.array(ids, np.int32), np.array([len(ids)]))[0].decode() == LIB.decode(ids)


@pytest.mark.parametrize("text", [" " * 700, "x" + " " * 333 + "the end", "a" * 20000, "=" * 999, "中文" * 3000])
def test_pieces_of_long_runs(text):
    assert CODEC.encode(pa.array([text]))[0].tolist() == LIB.encode(text)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_word_cache_equals_the_library(text):
    flat, number = CACHE.encode(pa.array([text, "again"]))
    assert flat[: number[0]].tolist() == CACHE.lib.encode(text, add_special_tokens=False).ids


def test_shards_round_trip(spark, tmp_path):
    rows = [(k, prose(k, 40 + k)) for k in range(60)] + [(100, None), (101, ""), (None, "no id")]
    folder = f"file://{tmp_path}/shards"
    m = arrow_shards.write_shards(spark.createDataFrame(rows, DOCS), folder, WORDS, 2, seq_len=64, partitions=3)
    found = {r["doc_id"]: r for r in arrow_shards.read_documents(m, folder).collect()}
    lib, at = Tokenizer.from_file(WORDS), 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        assert (found[key]["start"], found[key]["n_tokens"], found[key]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    shard = arrow_shards.ShardReader(folder, m.orderBy("shard").first()["file"])
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == 64 and mask.all()


def test_sketches():
    a, b = prose(1, 3000), prose(2, 300)
    assert sketch.to_text(sketch.sketch(a)) == sketch.to_text(sketch.sketch(a.upper()))
    both = sketch.from_text(sketch.merge(sketch.to_text(sketch.sketch(a)), sketch.to_text(sketch.sketch(b))))
    near, part = sketch.overlap(both, sketch.sketch(b))
    assert part == 1 and near < 0.3
    short, short_too = (next(t for k in range(99) if sketch.sketch(t := prose(at + k, 6)).least is not None) for at in (700, 900))
    for x, y in ((a, short), (short, a), (short, short_too), (short, short), (short, ""), ("", a)):
        together = np.union1d(sketch.shingle_hashes(x), sketch.shingle_hashes(y))
        want = {h >> 13 for h in together.tolist() if h < 2**61}
        merged = sketch.from_text(sketch.merge(sketch.to_text(sketch.sketch(x)), sketch.to_text(sketch.sketch(y))))
        assert set(merged.kept.tolist()) == want and merged.least == (None if want or not len(together) else int(together.min()) >> 16)
    assert sketch.overlap(sketch.sketch(short), sketch.sketch(short)) == (1, 1) and sketch.overlap(sketch.sketch(short), sketch.sketch(short_too)) == (0, None)
    assert sketch.overlap(sketch.sketch(short), sketch.sketch(f"{short} {a}")) == (0, None) and sketch.overlap(sketch.sketch(short), sketch.sketch("")) == (0, 0)
    half = sketch.sketch(" ".join(a.split()[:1500]))
    assert abs(sketch.overlap(sketch.sketch(a), half)[0] - 0.5) < 0.08
    assert sketch.overlap(sketch.sketch(""), sketch.sketch("")) == (1, 1) and sketch.overlap(sketch.sketch(""), half) == (0, 0)


def test_next_documents(spark):
    rows = [(3 * k, prose(k, 20 + k % 7)) for k in range(50)] + [(500, None)]
    got = {r["doc_id"]: r for r in sketch.with_next(spark.createDataFrame(rows, DOCS)).collect()}
    for (k, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        new = sketch.edited(text or "", after or "")
        assert got[k]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[k]["n_chars"] == len(text or "")
        assert got[k]["edited_fingerprint"] == sketch.to_text(sketch.sketch(new))


def test_likeness_against_whole_shingle_sets(spark):
    rows = [(k, prose(k if k % 3 else k - 1, 600 + 300 * (k % 3 == 0))) for k in range(24)]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for r in sketch.with_next(spark.createDataFrame(rows, DOCS)).collect():
        text, after = rows[r["doc_id"]][1], rows[(r["doc_id"] + 1) % 24][1]
        for near, other in ((r["near_edited"], sketch.edited(text, after)), (r["near_next"], after)):
            a, b = grams(text), grams(other)
            assert abs(near - len(a & b) / len(a | b)) < 0.15


def test_quality_learns_and_leaves_ids_out(spark):
    rows = [(k, prose(k, 60) if k % 3 else " ".join(f"{w}!!".upper() for w in prose(k, 60).split())) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    got = quality.classify(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) == int(r["score"] >= 0.3) for r in held)
    again = quality.fit(docs.withColumn("doc_id", F.col("doc_id")), labels)
    assert np.allclose(again.score(np.array([quality.statistics(rows[1][1])])), [next(r["score"] for r in got if r["doc_id"] == 1)], atol=1e-6)


def test_normal_equations_against_a_direct_solve(spark):
    r = random.Random(9)
    rows = [(k, " ".join(("X!! " if k % 2 and r.random() < 0.4 else "") + w for w in prose(k, 20 + k % 30).split())) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    model = quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    train = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 5 in (1, 2, 3)]
    x, y = np.array([quality.statistics(t) for _, t in train]), np.array([k % 2 for k, _ in train], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 1e-9, x.std(0), 1))
    z = model.features(x)
    assert np.allclose(z @ np.linalg.solve(z.T @ z + quality.RIDGE * len(y) / 10 * np.eye(z.shape[1]), z.T @ y), model.raw(x), atol=1e-5)
    # The random features approximate the Gaussian kernel of the standardised statistics.
    s = (x[:40] - model.mean) / model.scale
    kernel = np.exp(-quality.GAMMA * ((s[:, None] - s[None]) ** 2).sum(2))
    assert np.abs(z[:40, : quality.FEATURES] @ z[:40, : quality.FEATURES].T - kernel).max() < 0.25
    # Calibration: of held bins, the least-squares monotone fit, by brute force over all blocks.
    held = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 5 == 4]
    raw = model.raw(np.array([quality.statistics(t) for _, t in held]))
    v = np.array([k % 2 for k, _ in held], float)[np.argsort(raw)]
    fit = [max(min(v[a : b + 1].mean() for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    assert np.allclose(np.interp(np.sort(raw), model.at, model.to), fit, atol=0.35) and np.all(np.diff(model.to) > 0)


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").where("quality IS NOT NULL").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 2, 1, 3, 4]), np.full(5, 4.0))
    assert y.tolist() == [0, 0.375, 0.75, 1] and x.tolist() == [0, 1.5, 3, 4]


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None)]])
def test_quality_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(1, "one text"), (2, ""), (3, None)], DOCS)
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)


EMAIL, CARD = "ann.lee@mail.example.org", "4785 3805 9239 1139"


def test_base_spans():
    text = f"x {EMAIL}, 10.0.0.255 10.0.0.256 +1 (555) 010-9999 {CARD}."
    kinds = [text[a:b] for _, a, b in privacy.base_spans(text)]
    assert [k for k, _, _ in privacy.base_spans(text)][:2] == ["email", "ip"] and kinds[:2] == [EMAIL, "10.0.0.255"]
    assert privacy.luhn("4111111111111111") and not privacy.luhn("4111111111111112")


PIECES_OF_DATA = st.lists(st.sampled_from([EMAIL, "a@b", ".c", "@", "10.0.0.255", "1.2.3", "999", CARD, "4111-1111-1111-1111", "+", "+1 (555) 010", "-9999", " ", "  ", "0", "12", ".", "x", "é", "\n", "%_", "٣", "(", ")"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES_OF_DATA)
def test_base_spans_against_the_patterns(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    assert privacy.base_spans(text) == [(kind, m.start(), m.end()) for kind, pattern, test in rules for m in re.finditer(pattern, text) if test(m.group())]


@pytest.mark.parametrize("most", [privacy.MAX_TERMS, 2])
def test_disclosing_against_brute_force(spark, monkeypatch, most):
    """P and normalised PMI over distinct documents, by hand; with few terms a pass, many passes."""
    monkeypatch.setattr(privacy, "MAX_TERMS", most)
    r, people = random.Random(2), [(f"user{k}@mail.example.org", [f"name{k}", f"team{k % 3}"]) for k in range(6)]
    rows = []
    for k in range(160):
        mail, terms = people[r.randrange(6)]
        own = [w for w in terms if r.random() < 0.8] + [f"w{r.randrange(30)}" for _ in range(8)] + ([mail] if r.random() < 0.7 else [])
        r.shuffle(own)
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, rows[k][1]) for k in range(30)]
    texts = {t for _, t in rows}
    have = {t: (set(re.findall(r"user[0-9]@mail\.example\.org", t)), {w for w in re.sub(r"user\S+", "", t).split() if privacy.is_term(w)}) for t in texts}
    want = {}
    for mail, _ in people:
        n_e = sum(mail in m for m, _ in have.values())
        for term in {w for _, ws in have.values() for w in ws}:
            co, df = sum(mail in m and term in ws for m, ws in have.values()), sum(term in ws for _, ws in have.values())
            if co >= privacy.MIN_CONTEXTS and co / df >= privacy.MIN_SHARE:
                if np.log2(co * len(texts) / (df * n_e)) / np.log2(len(texts) / co) >= privacy.MIN_NPMI:
                    want[term] = max(want.get(term, 0), co / df)
    docs = spark.createDataFrame(rows, DOCS)
    got = dict(privacy.disclosing(docs).collect())
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want) and len(want) > 3
    spans = {x["doc_id"]: [rows[x["doc_id"]][1][s["start"] : s["end"]] for s in x["spans"] if s["kind"] == "term"] for x in privacy.find(docs).where("doc_id < 1000").collect()}
    assert all(spans[k] == [w for w in t.split() if w in want] for k, t in rows if k < 1000)


def test_disclosing_terms_go(spark):
    rows = [(k, f"s{k} t{k * 7} u{k} reach jsmithy at {EMAIL} v{k} q{k * 3}") for k in range(6)] + [(100 + k, f"filler number {k} reach the and at of") for k in range(200)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(spark.createDataFrame([(999, "jsmithy alone")], DOCS))
    assert [r["term"] for r in privacy.disclosing(docs).collect()] == ["jsmithy"]
    out = {r["doc_id"]: r["text"] for r in privacy.sanitise(docs).collect()}
    assert "jsmithy" not in out[999] and EMAIL not in out[0] and "[EMAIL]" in out[0] and out[100] == rows[6][1]


def test_copies_disclose_nothing(spark):
    docs = spark.createDataFrame([(k, f"same words about jsmithy and {EMAIL} here") for k in range(9)] + [(50 + k, f"other {k}") for k in range(90)], DOCS)
    assert privacy.disclosing(docs).count() == 0


def test_far_terms_disclose(spark):
    """Terms far from the value, in documents with one signature block and with copies of them."""
    rows = [(10 * k + j, f"jsmithy wrote {prose(k, 40)} regards {EMAIL} from the office of the north wing") for k in range(4) for j in range(5)]
    docs = spark.createDataFrame(rows + [(500 + k, f"other regards from the office of the north wing wrote {k}") for k in range(90)] + [(700, "jsmithy alone")], DOCS)
    assert [(r["term"], r["share"]) for r in privacy.disclosing(docs).collect()] == [("jsmithy", 0.8)]


def test_licences_against_brute_force():
    scan, texts, r = licence_scan.Templates(templates()), templates(), random.Random(3)

    def brute(text):
        ws, out = text.encode().translate(licence_scan.FOLD).split(), []
        for name, t in texts:
            tw = t.encode().translate(licence_scan.FOLD).split()
            tg, best = set(zip(tw, tw[1:])), None
            for i in range(len(ws) - 1):
                seen = set()
                for j in range(i + 1, len(ws)):
                    seen.add((ws[j - 1], ws[j]))
                    d = 2 * len(seen & tg) / (len(seen) + len(tg))
                    if d >= 0.8 and (best is None or d > best[0]):
                        best = (d, i, j, name)
            if best:
                out.append(best)
        kept = []
        for d, a, b, n in sorted(out, key=lambda m: (-m[0], m[1] - m[2], m[1], m[3])):
            if all(b < x or y < a for _, x, y, _ in kept):
                kept.append((n, a, b, d))
        return sorted(kept, key=lambda m: m[1])

    for _ in range(40):
        ws = []
        for _ in range(r.randint(1, 2)):
            x = r.choice(texts[: -len(TEXTS)])[1].split()
            if r.random() < 0.5:
                x[r.randrange(len(x))] = "word"
            ws += x + ["pad"] * r.randint(0, 3)
        assert scan.matches(" ".join(ws)) == brute(" ".join(ws))
    wrapped = "Intro.\n" + TEXTS["MIT"].replace(", ", ",\n") + "\nOutro."
    assert scan.matches(wrapped)[0][0] == "MIT"


@pytest.mark.parametrize(("unit", "n"), [("MIT License", 0), ("Licensed under the MIT License.", 20_000), ("licensed under the word mit license pad of the", 0)])
def test_licences_in_repeated_words(unit, n):
    """100,000 words: a place takes a look at no more bigrams than a template's bound allows, so this takes about a second."""
    text, began = " ".join([unit] * (100_000 // len(unit.split()))), time.perf_counter()
    assert len(licence_scan.Templates(templates()).matches(text)) == n and time.perf_counter() - began < 20


def test_licences_that_stand_again():
    scan, text = licence_scan.Templates([("A", "one two three four five six"), ("B", "one two three four five seven")]), "one two three four five six"
    assert [m[:3] for m in scan.matches(f"{text} pad {text}")] == [("A", 0, 5), ("A", 7, 12)]
    assert [m[:3] for m in scan.matches(f"{text} pad one two three four five x seven")] == [("A", 0, 5), ("A", 7, 11)]


def brute_windows(text, items, window=10):
    ws, hit, found = decontaminate.words(text), set(), set()
    for key, t in items:
        own = decontaminate.words(t)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == own[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(key)
    return hit, found


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton_against_brute_force(items, doc):
    items = [(str(k), " ".join(x)) for k, x in enumerate(items)]
    auto = decontaminate.Automaton([(k, decontaminate.words(t)) for k, t in items], 4)
    spans, found = auto.document(decontaminate.words(" ".join(doc)))
    hit, want = brute_windows(" ".join(doc), items, 4)
    assert {p for a, b in spans for p in range(a, b)} == hit and {auto.items[k] for k in found} == want


def test_benchmark_in_several_automata(spark, monkeypatch):
    """Small automata, long items in pieces: the same results, and never two broadcasts at once."""
    items = [(k, prose(40 + k, 4 + 9 * k)) for k in range(9)] + [(20, ""), (21, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(k, f"{prose(80 + k, 30)} {' '.join(prose(40 + k % 9, 4 + 9 * (k % 9)).split()[k % 4 :])} {prose(90 + k, 20)}") for k in range(30)] + [(99, None)]
    docs = spark.createDataFrame(rows, DOCS)
    want, clean = sorted(decontaminate.digest(docs, bench).collect()), sorted(decontaminate.cleaned(docs, bench).collect())
    alive, passes, marker, destroy = set(), [], decontaminate.marker, Broadcast.destroy

    def sent(held, *rest):
        assert not alive
        alive.add(held)
        passes.append(held)
        return marker(held, *rest)

    monkeypatch.setattr(decontaminate, "marker", sent)
    monkeypatch.setattr(Broadcast, "destroy", lambda held: (alive.discard(held), destroy(held)))
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", 180)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 12)
    assert sorted(decontaminate.digest(docs, bench).collect()) == want and len(passes) > 2
    assert sorted(decontaminate.cleaned(docs, bench).collect()) == clean
    for k, text in rows:
        hit, found = brute_windows(text or "", [(str(i), t or "") for i, t in items])
        assert next((r["n_hit"], r["n_items"]) for r in want if r["doc_id"] == k) == (len(hit), len(found))


def test_cleaned_documents(spark):
    item = prose(5, 15)
    docs = spark.createDataFrame([(1, f"{prose(6, 30)}, {item}! {prose(7, 30)}", 0), (2, item, 0), (3, prose(8, 30), 0), (4, None, 7)], DOCS + ", n_chars bigint")
    got = {r["doc_id"]: r for r in decontaminate.cleaned(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert set(got) == {1, 3, 4} and item not in got[1]["text"] and got[1]["text"].startswith(prose(6, 30)) and got[1]["n_chars"] == len(got[1]["text"]) and got[3]["text"] == prose(8, 30) and got[4]["n_chars"] == 7


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_fingerprint_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)  # large cells are dealt into parts
    r = np.random.default_rng(1)
    fps = {}
    for base in r.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(12):
            flips = sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False))
            fps[len(fps)] = base ^ flips
    rows = [(k, v - (1 << 64) if v >> 63 else v) for k, v in fps.items()]
    links = simhash.links(spark.createDataFrame(rows, "rep bigint, fp bigint").groupBy("fp").agg(F.min("rep").alias("rep")))
    got = {k: k for k in fps} | {x["node"]: x["root"] for x in components(links).collect()}
    want = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    same = {}
    for k, v in fps.items():
        same.setdefault(v, k)
    assert {k: got[same[v]] for k, v in fps.items()} == want


def test_fingerprint_hash_is_the_engines(spark):
    own = spark.sql("SELECT xxhash64('the quick b') AS h").first()["h"] & (2**64 - 1)
    assert simhash.fingerprint("The QUICK\tb") == own and simhash.fingerprint(" \n") == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "quick", "ÄB", "x1", ".", "\t", "\n", "\u00a0", "\x0b", " "]), max_size=24).map(" ".join))
def test_fingerprints_against_a_plain_reading(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    grams = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "u bigint, v bigint")
    assert dict(components(edges).collect()) == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def edit_words(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_lines_against_brute_force(spark):
    r, docs = random.Random(4), []
    for k in range(14):
        lines = []
        for _ in range(6):
            ws = prose(r.randrange(9), 7 + r.randrange(2)).split()
            roll = r.random()
            if roll < 0.3:
                ws[r.randrange(len(ws))] = "new"
            elif roll < 0.5:
                del ws[r.randrange(len(ws))]
            elif roll < 0.6:
                ws.insert(r.randrange(len(ws)), "more")
            elif roll < 0.7:
                ws = ws[:3]
            lines.append(" ".join(ws))
        docs.append((k, "\n".join(lines)))
    seen, want = [], {}
    for k, text in docs:
        gone = []
        for i, line in enumerate(text.split("\n")):
            ws = line.lower().split()
            if len(ws) >= 5:
                if any(edit_words(ws, o) <= 1 for o in seen):
                    gone.append(str(i))
                seen.append(ws)
        want[k] = ",".join(gone)
    got = {x["doc_id"]: x["gone"] for x in line_dedup.digest(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == want and any(want.values())


def test_lines_without_numbers(spark):
    docs = [(1, "one two three four five six"), (None, "one two three four five seven"), (None, "a lone line that stays here"), (None, "same words in both texts\nx"), (None, "same words in both texts\ny")]
    got = [x["gone"] for x in line_dedup.digest(spark.createDataFrame(docs, DOCS)).orderBy("gone").collect()]
    assert got == ["", "", "", "0", "0"]


def test_lines_leave_plans_native(spark):
    plan = line_dedup.dropped_lines(spark.createDataFrame([(1, "a b c d e")], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_compact_windows():
    r = np.random.default_rng(2)
    for _ in range(60):
        h = r.integers(0, 20, r.integers(1, 40)).astype(np.uint64)
        l, c, e = passages.compact_windows(h, 1)
        assert c.tolist() == list(range(len(h)))
        for a, b, z in zip(l, c, e):
            assert a + np.argmin(h[a : z + 1]) == b and (a == 0 or h[a - 1] <= h[b]) and (z == len(h) - 1 or h[z + 1] < h[b])


def test_passages(spark):
    own, r = prose(11, 70), random.Random(5)
    near = own.split()
    near[30] = "changed"
    rows = [(1, f"{prose(1, 80)} {own} {prose(2, 80)}"), (2, f"{prose(3, 60)} {own} {prose(4, 60)}"), (3, f"{prose(5, 50)} {' '.join(near)}"), (4, prose(6, 200)), (5, f"{' '.join(own.split()[:20])} {prose(7, 100)}"), (6, None), (7, "line of one word " * 90)]
    got = {x["doc_id"]: x for x in passages.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[2]["sources"] == [1] and got[2]["spans"] == "60:129" and got[3]["sources"] == [1] and got[3]["spans"] == "50:119"
    assert all(got[k]["spans"] == "" for k in (1, 4, 5, 6, 7))


def test_passages_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(passages, "FOLLOWERS", 4)  # several tasks a leader
    rows = [(k, prose(50, 120) + " " + prose(100 + k, 10)) for k in range(30)]
    got = {x["doc_id"]: x for x in passages.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0]["n_passages"] == 0 and all(got[k]["sources"] == [0] and got[k]["n_words"] >= 120 for k in range(1, 30))


def test_passages_behind_unlike_leaders(spark):
    rows = []
    for k in range(12):
        line = prose(300 + k, 48)  # too short for a passage; the documents that have only it lead its signatures
        own = [line] * 4 + [f"a{k} {line} b{k}"] * 2
        rows += [(10 * k + j, f"{prose(1000 + 10 * k + j, 60)} {x} {prose(2000 + 10 * k + j, 60)}") for j, x in enumerate(own)]
    got = {x["doc_id"]: (x["sources"], x["spans"]) for x in passages.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[k] == (([k - 1], "60:109") if k % 10 == 5 else ([], "")) for k in got)


def shingle_set(ws):
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}


def test_places_of_groups_without_an_earlier_document_are_left_out(spark):
    """The open document is the first of group 1, and the last of group 2."""
    rows = spark.createDataFrame([(1, 5, 50, True), (1, 6, 60, False), (2, 5, 50, False), (2, 6, 60, True)], "group bigint, doc bigint, th int, open boolean")
    assert not passages.twins(rows)
    assert {r["group"] for r in passages.worth(rows, False).collect()} == {2}
    assert passages.twins(rows.unionAll(spark.createDataFrame([(3, 5, 51, True)], rows.schema)))


def test_likely_surroundings_are_those_that_share_a_window():
    """A block's leaders against counting window by window, with a shingle repeated over and over among them."""
    rng, least = np.random.default_rng(5), passages.MIN_SHINGLES
    base = rng.integers(0, 1 << 32, 91, dtype=np.uint32)

    def copy(rate):
        h = np.where(rng.random(91) < rate, rng.integers(0, 1 << 32, 91, dtype=np.uint32), base)
        return np.where(rng.random(91) < 0.1, base[0], h).astype(np.uint32)

    rows = [(k, 0, 45, copy(rng.random() * 0.3)) for k in range(60)]
    asked = [copy(rng.random() * 0.3) for _ in range(40)] + [base[:30], rng.integers(0, 1 << 32, 91, dtype=np.uint32)]
    block = passages.Surroundings(rows)
    best = lambda h, other: max((int(np.isin(h[i : i + least], other).sum()) for i in range(len(h) - least + 1)), default=0)
    want = [{k for k, *_, x in rows if best(h, x) >= passages.MIN_SIMILARITY * least} for h in asked]
    every = np.concatenate([x for *_, x in rows])
    assert block.dense(asked) == [n for n, h in enumerate(asked) if best(h, every) >= passages.MIN_SIMILARITY * least]
    assert [{x[0] for x in block.like(h)} for h in asked] == want
    assert 0 < sum(map(len, want)) < len(rows) * len(asked)


@pytest.mark.parametrize(("leaders", "group"), [(passages.LEADERS, passages.GROUP), (2, 8)])
def test_passages_recall_in_groups_of_edited_copies(spark, monkeypatch, leaders, group):
    """Brute force: of the copies that are near some earlier copy of their group, nine in ten at least are found at each width and rate."""
    monkeypatch.setattr(passages, "LEADERS", leaders)
    monkeypatch.setattr(passages, "GROUP", group)  # with few, larger groups are told apart by longer runs
    r, rows, own, kinds = random.Random(7), [], {}, [(60, 0.02), (60, 0.03), (80, 0.02), (80, 0.03)]
    for g in range(20):
        size, rate = kinds[g % 4]
        base = prose(5000 + g, size).split()
        for k in range(40):
            copy = [f"x{r.randrange(10**6)}" if r.random() < rate else w for w in base]
            own[100 * g + k] = shingle_set(copy)
            rows.append((100 * g + k, f"{prose(r.random(), 40)} {' '.join(copy)} {prose(r.random(), 40)}"))
    near = lambda a, b: len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.8
    want = {d for d in own if any(near(d, e) for e in range(d - d % 100, d))}
    got = {x["doc_id"]: x["sources"] for x in passages.digest(spark.createDataFrame(rows, DOCS)).collect() if x["n_passages"]}
    for kind in range(4):
        these = {d for d in want if d // 100 % 4 == kind}
        print(kinds[kind], len(these), len(these & set(got)) / len(these))
        assert len(these) > 30 and len(these & set(got)) >= 0.9 * len(these)
    assert all(s < d and s // 100 == d // 100 for d, sources in got.items() for s in sources)


@pytest.mark.parametrize("gap", [1, 2])
def test_passages_in_large_groups_of_frequent_lines(spark, monkeypatch, gap):
    """Passages of two frequent lines about other words: both lines stand in more documents than are held against each other, and share under 32 shingles."""
    monkeypatch.setattr(passages, "LEADERS", 2)
    monkeypatch.setattr(passages, "GROUP", 8)
    rows, sets = [], 12
    for g in range(sets):
        a, b = prose(7000 + g, 29), prose(7100 + g, 29)
        for k in range(-60, 60):
            rows.append((1000 * g + k, f"{prose(8000 + 1000 * g + k, 40)} {(a, b)[k % 2]} {prose(20500 + 1000 * g + k, 40)}"))
        for k in (60, 61):
            rows.append((1000 * g + k, f"{prose(8000 + 1000 * g + k, 40)} {a} {' '.join(f'x{k}y{n}' for n in range(gap))} {b} {prose(20500 + 1000 * g + k, 40)}"))
    got = {x["doc_id"]: x["sources"] for x in passages.digest(spark.createDataFrame(rows, DOCS)).collect() if x["n_passages"]}
    print(len(got), sets)
    assert all(k % 1000 == 61 and sources == [k - 1] for k, sources in got.items()) and len(got) >= 0.9 * sets


def test_passages_of_rows_with_one_number(spark):
    own, other = prose(600, 80), prose(601, 80)
    rows = [(1, f"{prose(602, 60)} {own}"), (1, f"{prose(603, 60)} {other}"), (2, f"{own} {prose(604, 40)}"), (3, f"{other} {prose(605, 40)}")]
    rows += [rows[0]]
    got = {(x["doc_id"], x["spans"]): x["sources"] for x in passages.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[(2, "0:79")] == [1] and got[(3, "0:79")] == [1] and got[(1, "")] == []


def test_passages_of_repeats(spark):
    unit, notice = prose(80, 40), prose(81, 8)
    phrase = f"{prose(82, 20)} {prose(83, 7)} {prose(83, 7)} {prose(84, 18)}"
    rows = []
    for k, own in enumerate((" ".join([unit] * 10), " ".join([notice] * 50), phrase)):
        rows += [(10 * k + j, f"{prose(90 + 10 * k + j, 70)} {own} {prose(190 + 10 * k + j, 70)}") for j in (1, 2)]
    got = {x["doc_id"]: (x["sources"], x["spans"]) for x in passages.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[2] == ([1], "70:469") and got[12] == ([11], "70:469") and got[22] == ([21], "70:121")
    assert all(got[k] == ([], "") for k in (1, 11, 21))


CLASH = ", n_tokens int, ids_sha256 string, fingerprint string, score double, spans string, h string, d string, th string, gone string, rep int, root int, node int, _shard int, x string, key string, leader string, fp string, component_id string, n string, w string, near string"
ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "lost words have no number here"), (4, "one two three four five seven"), (5, " \n\t "), (6, f"mail {EMAIL} now")]


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, "two three four"), (2, None), (None, "x"), (3, "")], "item_id bigint, text string")
    return {
        "pieces": lambda d: piece_codec.digest_documents(d, PIECES), "encode": lambda d: piece_codec.encode_documents(d, PIECES), "sketch": sketch.with_next, "fingerprints": sketch.fingerprints,
        "quality": lambda d: quality.classify(d, labels), "privacy": privacy.digest, "sanitise": privacy.sanitise, "shards": lambda d: arrow_shards.round_trip(d, WORDS, 2), "licences": licence_scan.digest,
        "benchmark": lambda d: decontaminate.digest(d, bench), "cleaned": lambda d: decontaminate.cleaned(d, bench, max_coverage=1.0), "simhash": simhash.near_duplicates, "lines": line_dedup.digest, "dedup_lines": line_dedup.dedup_lines, "passages": passages.digest,
    }


@pytest.mark.parametrize("name", ["pieces", "encode", "sketch", "fingerprints", "quality", "privacy", "sanitise", "shards", "licences", "benchmark", "cleaned", "simhash", "lines", "dedup_lines", "passages"])
def test_odd_rows(spark, name):
    """Nulls, empty texts, ties, repeated rows, clashing columns: a row for each row; an empty table gives none."""
    op = operators(spark)[name]
    plain = op(spark.createDataFrame(ROWS, DOCS))
    assert plain.count() == len(ROWS)
    wide = spark.createDataFrame(ROWS, DOCS).selectExpr("*", *[f"cast(null as {p.split()[1]}) as {p.split()[0]}" for p in CLASH.strip(", ").split(", ")])
    got = op(wide)
    key = lambda df: Counter(str(r) for r in df.select(*plain.columns).collect())
    assert key(got) == key(plain)
    assert op(spark.createDataFrame([], DOCS)).count() == 0


def test_defined_odd_results(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    near = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert near[(2, "0" * 16)] == near[(3, "0" * 16)] == near[(5, "0" * 16)] == 2
    gone = Counter((r["doc_id"], r["gone"]) for r in line_dedup.digest(docs).collect())
    assert gone[(1, "")] == 2 and gone[(4, "0")] == 1
    kept = simhash.keep_first(docs)
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 1, 2, 4, 6] and kept.where("doc_id IS NULL").count() == 1


def test_pieces_take_few_bytes_beside_the_text():
    """What encoding and decoding hold beside ids and texts is laid out in slices, whatever a chunk holds."""
    r = random.Random(8)
    texts = [" ".join("".join(r.choices("abcdefgho  é", k=r.randrange(2, 12))) for _ in range(600)) for _ in range(600)] + [" " * 70_000 + "x" * 9 + "é" * 70_000]
    tracemalloc.start()
    try:
        flat, number = CODEC.encode_flat(pa.array(texts))
        decoded = CODEC.decode(flat, number)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25 * sum(len(t.encode()) for t in texts)
    want = [LIB.encode(t) for t in texts]
    assert number.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    assert [t.decode() for t in decoded] == [LIB.decode(x) for x in want]


def test_pairs_of_passages_meet_a_few_times(spark, monkeypatch):
    """Edited copies of a passage share many places and groups; each two of them are handed on once by those with one smallest document, over many batches."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    r, base = random.Random(3), prose(41, 70).split()
    rows = [(k, prose(k + 900, 60, 10**6) + " " + " ".join(w if r.random() > 0.02 else f"v{k}" for w in base) + " " + prose(k + 2000, 60, 10**6)) for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    members = passages.members(docs, "doc_id", "text").select("doc", "th", "place", F.lit(True).alias("open")).distinct()
    runs = passages.by_words(members, passages.RUNS[0], docs, "doc_id", "text")
    lead = passages.ranked(passages.worth(runs, False))
    left = runs.select("group", "doc", "th", "place").distinct()
    handed, distinct = [], type(docs).distinct
    monkeypatch.setattr(type(docs), "distinct", lambda df: (handed.append(df) if df.columns == passages.PAIR else None) or distinct(df))
    monkeypatch.setattr(passages, "discard", lambda df: None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        pairs = passages.likely_pairs(lead, left, docs, "doc_id", "text")
        assert 300 < pairs.count() and handed[-1].count() < 3 * pairs.count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_met_documents_start_anew_beyond_their_bound():
    met = passages.Met(most=100)
    for k in range(20):
        who = met.numbers([(k, 0, 45, np.zeros(0, np.uint32)), (k + 1, 0, 45, np.zeros(0, np.uint32))])
        own = met.of(99 + k % 3, 0)
        own[who] = True
        assert met.of(99 + k % 3, 0)[who].all() and sum(map(len, met.flags.values())) <= met.held <= 100
