"""The data source of stored answers, in batch and as a stream that is stopped and started."""

from pathlib import Path

from pyspark.sql import functions as F

from lumbrera.sources import feeds, responses
from lumbrera.sources.listings import listing

LISTING = '<div class="views-row"><time datetime="2024-01-0{0}">x</time><span class="views-field-title"><a href="/c/{0}">Case <b>{0}</b></a></span></div><div class="views-row"><p>no link</p></div>'


def feed(*names, root="rss", channel=True):
    items = "".join(f"<item><title>T {n}</title><link> https://x/{n} </link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>" for n in names)
    return f"<{root}>{'<channel>' if channel else ''}{items}{'</channel>' if channel else ''}</{root}>"


def put(root: Path, provider: str, source: str, name: str, body: str | bytes) -> None:
    at = root / f"provider={provider}" / f"source={source}"
    at.mkdir(parents=True, exist_ok=True)
    (at / name).write_bytes(body if isinstance(body, bytes) else body.encode())


def rows(df):
    return sorted((r["provider"], r["source"], r["file"], r["pos"], r["url"]) for r in df.collect())


def test_batch(spark, tmp_path):
    responses.register(spark)
    put(tmp_path, "rss", "a", "0001.xml", feed("a1", "a2"))
    put(tmp_path, "rss", "a", "0002.xml", feed("a3", root="rdf", channel=False))
    put(tmp_path, "rss", "b", "0001.xml", "<rss><channel><item><title>no link</title></item><item><link>https://x/b2</link></item></channel></rss>")
    put(tmp_path, "rss", "b", "0002.xml", "<rss><broken")
    put(tmp_path, "rss", "b", "0003.xml", "")
    put(tmp_path, "rss", "b", "0004.xml", b"<rss><channel><item><title>\xff</title><link>https://x/b4</link></item></channel></rss>")
    put(tmp_path, "rss", "long", "1.xml", feed(*range(50)))
    put(tmp_path, "cnmc", "c", "1.html", LISTING.format(1))
    put(tmp_path, "cnmc", "c", "_base", "https://site.org/list\n")
    put(tmp_path, "cnmc", "c", ".hidden", LISTING.format(2))
    put(tmp_path, "unknown", "d", "1.xml", feed("d"))
    (tmp_path / "stray.xml").write_text(feed("stray"))
    df = spark.read.format("stored_responses").load(f"file://{tmp_path}")
    want = [("cnmc", "c", "1.html", 0, "https://site.org/c/1"), ("rss", "a", "0001.xml", 0, "https://x/a1"), ("rss", "a", "0001.xml", 1, "https://x/a2"), ("rss", "a", "0002.xml", 0, "https://x/a3"), ("rss", "b", "0001.xml", 1, "https://x/b2"), ("rss", "b", "0004.xml", 0, "https://x/b4")]
    assert rows(df.where("source <> 'long'")) == want and df.where("source = 'long'").count() == responses.FEED_ITEMS
    assert df.rdd.getNumPartitions() == 4  # a source a partition
    assert {r["provider"] for r in spark.read.format("stored_responses").option("provider", "cnmc").load(str(tmp_path)).collect()} == {"cnmc"}


def test_equals_the_column_readers(spark, tmp_path):
    responses.register(spark)
    xml = feed(*range(30))
    put(tmp_path, "rss", "s", "1.xml", xml)
    put(tmp_path, "cnmc", "s", "1.html", LISTING.format(3))
    df = spark.read.format("stored_responses").load(f"file://{tmp_path}")
    by_column = feeds.rss_items(spark.createDataFrame([(xml,)], "xml string")).select("pos", "item.title", F.trim("item.link").alias("url"), F.col("item.pubDate").alias("published"))
    assert sorted(map(tuple, df.where("provider = 'rss'").select("pos", "title", "url", "published").collect())) == sorted(map(tuple, by_column.collect()))
    page = spark.createDataFrame([(LISTING.format(3),)], "html string").select(F.explode(listing("cnmc")("html", F.lit(""))).alias("i")).select("i.*")
    assert list(map(tuple, df.where("provider = 'cnmc'").select("title", "url", "published", "category", "summary").collect())) == list(map(tuple, page.collect()))


def test_empty_and_missing_folders(spark, tmp_path):
    responses.register(spark)
    assert spark.read.format("stored_responses").load(f"file://{tmp_path}").collect() == []
    assert spark.read.format("stored_responses").load(f"file://{tmp_path}/none").collect() == []


def test_a_provider_of_ones_own(spark, tmp_path):
    responses.provide("lines", lambda text, base: [(k, {"url": base + x}) for k, x in enumerate(text.split())])
    try:
        responses.register(spark)
        put(tmp_path, "lines", "s", "1.txt", "a b")
        put(tmp_path, "lines", "s", "_base", "https://y/")
        assert rows(spark.read.format("stored_responses").load(f"file://{tmp_path}")) == [("lines", "s", "1.txt", 0, "https://y/a"), ("lines", "s", "1.txt", 1, "https://y/b")]
    finally:
        del responses.PROVIDERS["lines"]


def test_stream_doubles_nothing(spark, tmp_path):
    responses.register(spark)
    store = tmp_path / "in"
    store.mkdir()

    def run():
        df = spark.readStream.format("stored_responses").option("files_per_source", 2).load(f"file://{store}")
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    for k in range(5):
        put(store, "rss", "a", f"{k:04d}.xml", feed(f"a{k}"))
    put(store, "rss", "b", "0000.xml", feed("b0"))
    want = [("rss", "a", f"{k:04d}.xml", 0, f"https://x/a{k}") for k in range(5)] + [("rss", "b", "0000.xml", 0, "https://x/b0")]
    assert run() == want and run() == want
    put(store, "rss", "a", "0005.xml", feed("a5"))
    put(store, "rss", "c", "0000.xml", feed("c0", "c1"))
    put(store, "rss", "b", "-early.xml", feed("early"))  # under a name that was passed
    want = sorted([*want, ("rss", "a", "0005.xml", 0, "https://x/a5"), ("rss", "c", "0000.xml", 0, "https://x/c0"), ("rss", "c", "0000.xml", 1, "https://x/c1")])
    assert run() == want and run() == want
