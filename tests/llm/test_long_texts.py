"""Texts of a million characters and more, through each operator and each stage."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumbrera.llm import arrow_shards, decontaminate, line_dedup, passages, privacy, quality, simhash, sketch, stages

DOCS = "doc_id bigint, text string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
LINE = "five words in a line"
LONG = {1: "word other " * 120_000, 2: "x" * 1_500_000, 3: f"{LINE}\n" * 40_000, 4: "a@b." * 100_000 + " +1 234" * 50_000, 5: " ".join(f"w{k}" for k in range(150_000))}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*LONG.items(), (6, "short text of seven words it is"), (7, None)], DOCS).repartition(3)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_fingerprints(docs):
    got = by_id(sketch.with_next(docs), "n_chars", "fingerprint", "edited_sha256")
    for k, text in LONG.items():
        after = LONG.get(k + 1, "short text of seven words it is")
        assert got[k] == (len(text), sketch.to_text(sketch.sketch(text)), hashlib.sha256(sketch.edited(text, after).encode()).hexdigest())


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (6, 0)], "doc_id bigint, quality int")
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in by_id(quality.classify(docs, labels), "score", "predicted").values())


def test_personal_data(docs):
    got = by_id(privacy.digest(docs), "n_email", "n_ip", "n_card", "n_phone")
    assert got[4] == tuple(sum(k == kind for k, _, _ in privacy.base_spans(LONG[4])) for kind in privacy.KINDS[:4]) and got[1] == (0, 0, 0, 0)


def test_shards(docs):
    got, lib = by_id(arrow_shards.round_trip(docs, WORDS, end_id=2), "n_tokens", "ids_crc32"), Tokenizer.from_file(WORDS)
    for k in (1, 3, 5):
        ids = [*lib.encode(LONG[k], add_special_tokens=False).ids, 2]
        assert got[k] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert len(got) == 7


def test_benchmark(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(70_000, 70_040))), (2, "none of this stands anywhere in the texts at all")], "item_id bigint, text string")
    got = by_id(decontaminate.digest(docs, bench), "n_words", "n_hit", "n_items")
    assert got[5] == (150_000, 40, 1) and got[1] == (240_000, 0, 0) and got[7] == (0, 0, 0)
    left = by_id(decontaminate.cleaned(docs, bench), "text")
    assert "w70020 " not in left[5][0] and "w69999" in left[5][0] and left[2][0] == LONG[2]


def test_simhash(docs):
    got = by_id(simhash.near_duplicates(docs), "fingerprint", "component_id")
    assert len(got) == 7 and got[7][0] == "0" * 16 and got[2][0] != "0" * 16
    assert {k for k in by_id(simhash.keep_first(docs), "text")} == {c for _, c in got.values()}


def test_lines(docs):
    got = by_id(line_dedup.digest(docs), "n_lines", "n_gone")
    assert got[3] == (40_001, 39_999) and got[2] == (1, 0)


def test_passages(spark, docs):
    more = docs.unionAll(spark.createDataFrame([(20, "before it all " + " ".join(f"w{k}" for k in range(100_000, 100_200)) + " and after")], DOCS))
    got = {r["doc_id"]: (r["sources"], r["n_words"]) for r in passages.digest(more).collect()}
    assert got[20][0] == [5] and got[20][1] >= 195 and got[1] == ([], 0)


def test_stages(docs):
    spark = docs.sparkSession
    out = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    for stage in (stages.lines, stages.simhash_groups):
        after = stage(spark, out, "")
        assert after.columns == out.columns and 0 < after.count() <= out.count()
    tokens = stages.tokenise(spark, out.where("doc_id IN (1, 6)"), "")
    assert tokens.count() == 2
