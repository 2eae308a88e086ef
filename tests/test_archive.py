"""Searches through trigram postings give what a scan gives, and read fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from lumbrera.operators import archive

SCHEMA = "entry_id bigint, title string, content string"
QUERIES = ["needle", "NEEDLE in", "wor", "w", "", "100%", "a_b", "ü Ñ", "w1 w2", "zzz", "line\ntwo", "e\\f", "  needle  ", "n%dle", "w_ w1", "_", "%", "😀 x"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(k, f"title {k % 9}", " ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(2, 30)))) for k in range(600)]
    odd = [None, "", "ab", "a Needle in", "100% sure", "1000 sure", "a_b", "axb", "Ü ñ", "line\ntwo", "e\\f", "😀 X", "x" * 300_000 + "needle"]
    return out + [(1000 + k, None if k % 3 else "needle title", t) for k, t in enumerate(odd)] + [(None, "no id", "needle"), (5, "title 5", "needle"), (5, "title 5", "needle")]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('archive')}"
    df = spark.createDataFrame(rows, SCHEMA)
    archive.add(df.where("entry_id < 400"), at, "entry_id", ["title", "content"], file_rows=64)
    archive.add(df.where("entry_id >= 400 OR entry_id IS NULL"), at, "entry_id", ["title", "content"], file_rows=64)
    return at


@pytest.mark.parametrize("q", QUERIES)
def test_equals_a_scan(spark, rows, folder, q):
    df = spark.createDataFrame(rows, SCHEMA)
    for columns in (["content"], ["title", "content"]):
        test = F.lit(False)
        like = F.lit(False)
        for c in columns:
            test = test | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
            like = like | F.coalesce(F.col(c).ilike("%" + q.strip().replace("\\", "\\\\") + "%"), F.lit(False))
        key = lambda d: sorted(map(repr, d.select("entry_id", "title", F.length("content")).collect()))
        assert key(archive.search_text(spark, folder, q, columns)) == key(df.where(test))
        assert key(archive.search_pattern(spark, folder, q, columns)) == key(df.where(like))


def test_files_read(spark, folder):
    every, none = archive.files_with(spark, folder, ["w"])
    assert none is None and len(every) >= 9
    assert archive.files_with(spark, folder, ["zzz"])[0] == []
    files, pages = archive.files_with(spark, folder, ["needle in"])
    assert len(files) == 1 and pages.count() == 1
    read = [f.split("/texts/")[1] for f in archive.search_text(spark, folder, "needle in", ["content"]).inputFiles() if "/texts/" in f]
    assert read == [f.split("/texts/")[1] for f in files]
    assert len(archive.files_with(spark, folder, ["needle"])[0]) < len(every) / 2


def test_empty_archive(spark, tmp_path):
    at = f"file://{tmp_path}/none"
    archive.add(spark.createDataFrame([], SCHEMA), at, "entry_id", ["content"])
    assert archive.search_text(spark, at, "needle", ["content"]).collect() == [] and archive.search_pattern(spark, at, "w", ["content"]).collect() == []
