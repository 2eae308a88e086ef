"""The corpus pipeline: filter, deduplicate, decontaminate and tokenise documents, one written stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumbrera.llm import stages
from lumbrera.llm.common import fresh_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", stages.quality),
    ("line dedup", stages.lines),
    ("SimHash near-dedup", stages.simhash_groups),
    ("benchmark decontamination", stages.benchmark),
    ("SentencePiece encoding and decoding", stages.tokenise),
]

#: Fitted models, component search and tokenising have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
