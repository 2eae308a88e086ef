"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.llm import decontaminate, line_dedup, piece_codec, simhash
from lumbrera.llm import quality as quality_model
from lumbrera.llm.common import own_columns, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = unused(docs, "score"), unused(docs, "predicted")
    found = quality_model.scored(docs, model, score_col=score, predicted_col=predicted)
    return found.where(F.col(predicted) == 1).select(*own_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, equal or nearly so, earlier in the corpus."""
    return line_dedup.dedup_lines(docs, report=False)


def simhash_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids with begin and end, and the decoded text."""
    return piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
