"""The pipeline on planted documents: what must go goes, the rest stays."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lumbrera.llm import decontaminate, privacy, quality


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfgm')}{r.choice('aeiou')}{r.choice('lnrst')}{r.choice('aeiou')}{r.randrange(40)}" for _ in range(n))


def test_pipeline(spark, tmp_path):
    item = prose(900, 30)
    rows = [(k, prose(k, 80) + ".\n" + prose(k + 500, 40) + ".") for k in range(200)]
    junk = [(300 + k, "\n".join(" ".join(w.upper() + "!!" for w in prose(k, 5).split()) for _ in range(9))) for k in range(100)]
    copies = [(500, rows[3][1]), (501, rows[3][1] + " Tail.")]
    leak = [(510, rows[0][1].replace("a", "o") + "\n" + prose(77, 60) + " " + item + " " + prose(78, 60))]
    docs = spark.createDataFrame(rows + junk + copies + leak, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) + 0L n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k, _ in rows[:150]] + [(k, 0, 0) for k, _ in junk[:80]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(k >= 300 and k < 400 for k in out)
    assert all(k in out for k, _ in rows)
    text = dict(rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(out[k]["decoded"] == text[k] and list(out[k]["ids"]) == [1, *lib.encode(text[k]), 2] for k in (0, 7, 199))
    assert len({500, 501} & set(out)) <= 1
    assert 510 in out and b" ".join(decontaminate.words(item)[:10]) not in b" ".join(decontaminate.words(out[510]["decoded"]))


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]


EXTRA = ["_gone", "_n_lines", "_spans", "score", "predicted", "a.b", "_hits", "_items", "_row", "_d", "th", "fp", "rep", "Score", "b`c"]


@pytest.fixture(scope="module")
def wide(spark):
    """Documents with extra columns, one of each name that an operator might use itself, and what stands in them."""
    rows = [(k, prose(k % 9 if k % 4 else k, 30) + "\n" + prose(500, 8), "en", "s", 7) for k in range(40)] + [(90, None, None, None, None), (91, "", "en", "s", 0), (None, "no number here", "en", "s", 14)]
    extra = [c for c in EXTRA if c != "Score"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("*", *[F.concat(F.lit(c + ":"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in extra]), extra


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_other_columns(spark, wide, tmp_path, stage):
    docs, extra = wide
    spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(3, 15))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in extra)
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_other_operators_keep_other_columns(spark, wide):
    docs, extra = wide
    out = privacy.sanitise(docs.where("doc_id < 90"))
    assert out.columns == docs.columns and all(r[c] == f"{c}:{r['doc_id']}" for r in out.collect() for c in extra)
    with pytest.raises(ValueError, match="other names"):
        quality.scored(docs, quality.Model(np.zeros(24), np.ones(24)))


def test_tokenising_odd_rows(spark, wide):
    docs, _ = wide
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == docs.count()
