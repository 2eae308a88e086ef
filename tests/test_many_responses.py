"""Stored answers of very many and of very long sources are read by tasks of bounded size, and in order."""

from test_responses import feed, put

from lumbrera.sources import responses


def read(spark, path):
    responses.register(spark)
    return spark.read.format("stored_responses").load(f"file://{path}")


def test_many_sources_share_tasks(spark, tmp_path):
    for k in range(600):
        put(tmp_path, "rss", f"{k:04d}", "1.xml", feed(k))
    df = read(spark, tmp_path)
    assert df.rdd.getNumPartitions() == 1
    assert [(r["source"], r["url"]) for r in df.collect()] == [(f"{k:04d}", f"https://x/{k}") for k in range(600)]


def test_a_long_source_is_split(spark, tmp_path):
    at = tmp_path / "provider=rss" / "source=long"
    at.mkdir(parents=True)
    for k in range(4100):
        (at / f"{k:05d}.xml").write_text(feed(k))
    put(tmp_path, "rss", "short", "1.xml", feed("s"))
    df = read(spark, tmp_path)
    assert df.rdd.getNumPartitions() == 3
    assert [r["url"] for r in df.collect()] == [*(f"https://x/{k}" for k in range(4100)), "https://x/s"]


def test_store_leaves_a_file_for_each_answer(spark, tmp_path):
    rows = [("rss", str(k % 3), f"{k:03d}.xml", feed(f"é{k}")) for k in range(100)] + [("rss", "0", "none.xml", None)]
    answers = spark.createDataFrame(rows, "provider string, source string, name string, body string")
    for _ in range(2):  # a repetition writes the same files again
        responses.store(answers, f"file://{tmp_path}")
    found = {(f.parent.name, f.name): f.read_text() for f in tmp_path.rglob("*") if f.is_file()}
    assert found == {(f"source={s}", n): b or "" for _, s, n, b in rows}
    assert sorted(r["url"] for r in read(spark, tmp_path).collect()) == sorted(f"https://x/é{k}" for k in range(100))
