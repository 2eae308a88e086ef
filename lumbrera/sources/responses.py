"""Stored answers of sources as a data source: ``spark.read.format("stored_responses")``, and the same as a stream.

Fetchers leave each answer as a file of its own, in ``<path>/provider=<provider>/source=<source>/``, named so that names ascend in the order of arrival. A provider
says how an answer is parsed; ``provide`` adds one. A source is a partition, so that its answers are read in order by one task, and sources
side by side; one of more than ``FILES`` answers is several, that follow each other, and where there are more than ``TASKS`` partitions, sources that follow
each other share one of ``FILES`` answers at most. A row is an item of an answer. ``store`` leaves answers as a fetcher does.

The stream's offset is the last file read of each source. Files that come under an earlier name than that are not read. A stream that is started again goes on
after the files of its last batch, and a batch that is repeated reads the files it read before. ``files_per_source`` bounds what a batch reads of one source.

Broken answers, and answers in other encodings than UTF-8 (of which what is not valid is replaced), give the items that can be read, or none. Names that begin with
``_`` or ``.`` are not read; a file ``_base`` holds the address that relative links of a source's pages start from. An empty or missing folder has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lumbrera.sources.listings import LAYOUTS, items

NAME = "stored_responses"
SCHEMA = "provider string, source string, file string, pos int, title string, url string, published string, category string, summary string"
FIELDS = ["title", "url", "published", "category", "summary"]
#: Items of a feed that are taken, from its beginning.
FEED_ITEMS = 20
#: Answers that a task reads, and tasks with a source each.
FILES, TASKS = 4096, 256

#: (text, base address) -> items in order: the place in the answer and its fields.
Parser = Callable[[str, str], list[tuple[int, dict]]]


def feed_items(xml: str, base: str) -> list[tuple[int, dict]]:
    """Items of the channel, or else of the root, that have a link."""
    try:
        root = ElementTree.fromstring(xml.strip())
    except ElementTree.ParseError:
        return []
    found = root.findall("channel/item") or root.findall("item")
    text = lambda i, tag: (i.findtext(tag) or "").strip() or None
    rows = [(k, {"title": text(i, "title"), "url": text(i, "link"), "published": text(i, "pubDate"), "category": text(i, "category"), "summary": text(i, "description")}) for k, i in enumerate(found[:FEED_ITEMS])]
    return [(k, r) for k, r in rows if r["url"]]


@dataclass(frozen=True)
class Listing:
    """A site's listing pages, by its layout."""

    site: str

    def __call__(self, html: str, base: str) -> list[tuple[int, dict]]:
        return list(enumerate(items(html, base, LAYOUTS[self.site])))


PROVIDERS: dict[str, Parser] = {"rss": feed_items} | {site: Listing(site) for site in LAYOUTS}


def provide(name: str, parser: Parser) -> None:
    """Add a provider; ``register`` then makes it known to a session."""
    PROVIDERS[name] = parser


@dataclass
class SourceFiles:
    """Answers of one source, in order."""

    provider: str
    source: str
    files: list[str]


@dataclass
class Task(InputPartition):
    """What a task reads, in order."""

    parts: list[SourceFiles]


def tasks(sources: Iterable[tuple[tuple[str, str], list[str]]]) -> list[InputPartition]:
    """Tasks of bounded size over all answers; one of nothing if there are none."""
    parts = [SourceFiles(*key, files[k : k + FILES]) for key, files in sources for k in range(0, len(files), FILES)]
    if len(parts) <= TASKS:
        return [Task([p]) for p in parts] or [Task([])]
    out, room = [], 0
    for p in parts:
        if len(p.files) > room:
            out.append(Task([]))
            room = FILES
        out[-1].parts.append(p)
        room -= len(p.files)
    return out


class Folder:
    """What is stored under a path, and how it is parsed."""

    def __init__(self, path: str, only: str | None, providers: dict[str, Parser]) -> None:
        self.path, self.only, self.providers = path, only, providers

    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def sources(self) -> dict[tuple[str, str], list[str]]:
        """Names of answers by (provider, source), ascending."""
        store, root = self.opened()
        listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out: dict[tuple[str, str], list[str]] = {}
        for f in listed:
            provider, _, rest = f.path[len(root) :].strip("/").partition("/")
            source, _, name = rest.partition("/")
            if f.type == fs.FileType.File and name and "/" not in name and name[0] not in "_." and provider.startswith("provider=") and source.startswith("source="):
                key = provider.removeprefix("provider="), source.removeprefix("source=")
                if key[0] in self.providers and self.only in (None, key[0]):
                    out.setdefault(key, []).append(name)
        return {k: sorted(v) for k, v in sorted(out.items())}

    def rows(self, task: Task) -> Iterator[tuple]:
        store, root = self.opened()
        for part in task.parts:
            yield from self.of_source(store, place(root, part.provider, part.source), part)

    def of_source(self, store: fs.FileSystem, at: str, part: SourceFiles) -> Iterator[tuple]:
        read = lambda name: store.open_input_stream(f"{at}/{name}", compression=None).read().decode("utf-8", "replace")
        base = read("_base").strip() if store.get_file_info(f"{at}/_base").type == fs.FileType.File else ""
        parse = self.providers[part.provider]
        for name in part.files:
            for pos, item in parse(read(name), base):
                yield (part.provider, part.source, name, pos, *(item.get(f) for f in FIELDS))


def place(root: str, provider: str, source: str) -> str:
    return f"{root.rstrip('/')}/provider={provider}/source={source}"


def store(answers: DataFrame, path: str) -> None:
    """Leave each answer (provider, source, name, body) as a file under ``path``. Answers are dealt by name to as many tasks as a shuffle has; a task that is repeated writes its files again."""
    folder = Folder(path, None, {})

    def put(rows: Iterator[Row]) -> None:
        into, root = folder.opened()
        made = None
        for provider, source, name, body in rows:
            at = place(root, provider, source)
            if at != made:
                into.create_dir(at, recursive=True)
                made = at
            with into.open_output_stream(f"{at}/{name}", compression=None) as f:
                f.write((body or "").encode())

    # A number that is given is kept: small partitions by size would be many files each.
    n = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = answers.select("provider", "source", "name", "body").repartition(n, "provider", "source", "name")
    dealt.sortWithinPartitions("provider", "source").foreachPartition(put)


class BatchReader(DataSourceReader):
    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return tasks(self.folder.sources().items())

    def read(self, partition: Task) -> Iterator[tuple]:
        return self.folder.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder, files_per_source: int) -> None:
        self.folder, self.most = folder, files_per_source
        self.reached: dict[str, str] | None = None

    def initialOffset(self) -> dict:
        return {"last": {}}

    def latestOffset(self) -> dict:
        """The last file of each source, or the one that a batch of ``files_per_source`` reaches."""
        last = dict(self.reached or {})
        for (provider, source), files in self.folder.sources().items():
            key = f"{provider}/{source}"
            new = [f for f in files if f > last.get(key, "")]
            if new:
                last[key] = new[self.most - 1] if 0 < self.most < len(new) else new[-1]
        return {"last": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = end["last"]
        out = []
        for (provider, source), files in self.folder.sources().items():
            key = f"{provider}/{source}"
            own = [f for f in files if start["last"].get(key, "") < f <= end["last"].get(key, "")]
            if own:
                out.append(((provider, source), own))
        return tasks(out)

    def read(self, partition: Task) -> Iterator[tuple]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        self.reached = end["last"]


class StoredResponses(DataSource):
    """Options: ``path``; ``provider``, to read those of one; ``files_per_source`` of a stream's batch (0: all that is there)."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.providers = dict(PROVIDERS)

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def folder(self) -> Folder:
        if "path" not in self.options:
            raise ValueError("stored_responses: give the folder as path")
        return Folder(self.options["path"], self.options.get("provider"), self.providers)

    def reader(self, schema: object) -> DataSourceReader:
        return BatchReader(self.folder())

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return StreamReader(self.folder(), int(self.options.get("files_per_source", "0")))


def register(spark: SparkSession) -> None:
    """Make the data source known to the session, with the providers that there are now."""
    providers = dict(PROVIDERS)

    class Registered(StoredResponses):
        def __init__(self, options: dict[str, str]) -> None:
            super().__init__(options)
            self.providers = providers

    spark.dataSource.register(Registered)
