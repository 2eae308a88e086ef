"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton is built on the driver from the benchmark's items and is sent to the executors. It holds ``MAX_ITEM_WORDS`` words at most: long
items are cut into pieces that overlap by a window less one word, so that no window is lost, and a larger benchmark is dealt into
groups of pieces whose sizes are checked. Each group takes a pass over the documents of its own, which is written before the next group is
fetched and sent, so that the driver and each executor hold one automaton at a time. Documents stream through it word by word: the longest match ending at each word is tracked, and where it reaches a window's
length, the window's words are hit. Words that no item has end a match at once, so the automaton runs only over stretches
of item words that are long enough to hold a window.

Words are maximal runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. Null or empty texts have no words.
Items that are null or have no words are never found. Equal items are all reported. Repeated documents give repeated rows.
An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumbrera.llm.common import bounded_batches, chunks, cut, strings

#: Words of one automaton at most; some 200 to 400 bytes each in a Python worker.
MAX_ITEM_WORDS = 1_000_000
#: Words of a piece of a long item.
PIECE_WORDS = 100_000
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
KEEP = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of the items' words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.items = [i for i, _ in items]
        own: list[list[int]] = []
        for _, ws in items:
            own.append([self.ids.setdefault(w, len(self.ids) + 1) for w in ws])
            last = 0
            for c in own[-1]:
                last = self.extend(last, c)
        self.shortest = min([window, *(len(x) for x in own if x)])
        # Per state, the items that a window ending there belongs to; and the short items that end there.
        self.found: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, x in enumerate(own):
            if not x:
                continue
            s = 0
            for n, c in enumerate(x, 1):
                s = self.next[s][c]
                if n >= window:
                    self.found.setdefault(self.up(s, window), set()).add(k)
            if len(x) < window:
                self.short.setdefault(s, []).append((len(x), k))
        # The nearest state with short items, from each state up the links.
        self.near = [-1] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.near[s] = s if s in self.short else self.near[self.link[s]]

    def extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self.clone(last, c, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self.clone(p, c, q)
        return cur

    def clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def up(self, s: int, n: int) -> int:
        """The state of the last n words of what s stands for."""
        while self.len[self.link[s]] >= n:
            s = self.link[s]
        return s

    def scan(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of words [from, to) and the items found, over one stretch of item words."""
        nxt, link, length, near, window = self.next, self.link, self.len, self.near, self.window
        s = n = 0
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, c in enumerate(ids, 1):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            else:
                s = n = 0
                continue
            if n >= window:
                at = self.up(s, window) if length[link[s]] >= window else s
                items |= self.found.get(at, set())
                hits.append((i - window, i))
            t = near[s]
            while t != -1:
                for size, k in self.short.get(t, ()):
                    if size <= n:
                        items.add(k)
                        hits.append((i - size, i))
                t = near[link[t]]
        return hits, items

    def document(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit ranges of a document's words, and the items found."""
        if len(ws) < self.shortest or not self.ids:
            return [], set()
        get = self.ids.get
        ids = [get(w, 0) for w in ws]
        known = np.flatnonzero(np.array([0, *ids, 0], np.int32) == 0)
        gap = np.diff(known)
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        for k in np.flatnonzero(gap > self.shortest).tolist():
            a = int(known[k])
            h, found = self.scan(ids[a : int(known[k + 1]) - 1])
            hits += [(a + x, a + y) for x, y in h]
            items |= found
        merged: list[tuple[int, int]] = []
        for a, b in sorted(hits):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def pieces(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words, n): the items' words, space-joined, in pieces of PIECE_WORDS that overlap by window - 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 1):
                out = []
                for item, text in zip(b.column(0).to_pylist(), strings(b.column(1)).to_pylist(), strict=True):
                    ws = words(text)
                    for at in range(0, max(1, len(ws) - window + 1), PIECE_WORDS) if ws and item is not None else ():
                        own = ws[at : at + PIECE_WORDS + window - 1]
                        out.append((item, b" ".join(own).decode(), len(own)))
                if out:
                    item, text, n = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(text), pa.array(n, pa.int64())], ["item", "words", "n"])

    return benchmark.select(F.col(id_col).cast("string"), text_col).mapInArrow(work, "item string, words string, n bigint")


def automata(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[tuple[Automaton, bool]]:
    """One after another, each of at most MAX_ITEM_WORDS words, and whether it is one of several. An empty benchmark has one of no items."""
    rows, groups = pieces(benchmark, window, id_col, text_col), 1
    group = lambda: F.pmod(F.xxhash64("item", "words"), F.lit(groups))
    while (rows.groupBy(group()).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > MAX_ITEM_WORDS:
        groups *= 2
        if groups == 2:
            rows = cut(rows)
    for k in range(groups):
        own = rows.where(group() == k) if groups > 1 else rows
        yield Automaton([(r["item"], r["words"].encode().split()) for r in own.select("item", "words").toLocalIterator()], window), groups > 1


HITS = "array<struct<first:bigint,last:bigint>>"


def marked(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """The documents under the names c0, c1, ... with three columns more: hits (merged word ranges, last exclusive), items and n_words."""
    bounded_batches(docs.sparkSession)
    at, width = docs.columns.index(text_col), len(docs.columns)
    out = docs.toDF(*[f"c{k}" for k in range(width)])
    out = out.withColumns({"hits": F.array().cast(HITS), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("bigint")})
    for own, several in automata(benchmark, window, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(own)
        del own
        out = out.mapInArrow(marker(held, at, width), out.schema)
        if several:
            out = cut(out)
            held.destroy()
    return out


def marker(held: Broadcast, at: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds what one automaton finds in column ``at`` to the hits and items that stand in the two columns from ``width`` on, and counts words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = held.value
        for whole in batches:
            for b in chunks(whole, at):
                hits, items, n = b.column(width).to_pylist(), b.column(width + 1).to_pylist(), []
                for k, text in enumerate(strings(b.column(at)).to_pylist()):
                    ws = words(text)
                    n.append(len(ws))
                    new, found = auto.document(ws)
                    if new:
                        spans = merged([(h["first"], h["last"]) for h in hits[k]] + new)
                        hits[k] = [{"first": x, "last": y} for x, y in spans]
                        items[k] = sorted({*items[k], *(auto.items[i] for i in found)})
                more = [pa.array(x, b.schema.field(width + k).type) for k, x in enumerate((hits, items, n))]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *more], schema=b.schema)

    return work


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, hits array<struct<first, last>> of word numbers (last exclusive, merged), items array<string> (sorted)."""
    found = marked(docs.select(id_col, text_col), benchmark, window, text_col, item_col, item_text)
    return found.select(F.col("c0").alias(id_col), "n_words", "hits", "items")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The query's columns, from ``matches``."""
    m = matches(docs, benchmark, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda acc, x: acc + x["last"] - x["first"])
    return m.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The documents without the words that benchmark windows hit.

    A hit stretch goes with everything from its first to its last word's end. A document with more than ``max_coverage`` of its
    words hit goes as a whole. Other documents are unchanged. All columns stay; ``count_col``, if there, counts the new text.
    """
    found = marked(docs, benchmark, window, text_col, "item_id", "text")
    at, width = docs.columns.index(text_col), len(docs.columns)
    counted = docs.columns.index(count_col) if count_col in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, at):
                hits, n, texts, keep = b.column(width), b.column(width + 2), b.column(at).to_pylist(), np.ones(b.num_rows, bool)
                for k in np.flatnonzero(pc.list_value_length(hits).to_numpy(zero_copy_only=False)).tolist():
                    own = [(h["first"], h["last"]) for h in hits[k].as_py()]
                    keep[k] = sum(y - x for x, y in own) <= max_coverage * n[k].as_py()
                    texts[k] = without(texts[k], own)
                cols = list(b.columns[:width])
                cols[at] = pa.array(texts, cols[at].type)
                if counted is not None:
                    cols[counted] = pc.if_else(pc.is_null(cols[at]), cols[counted], pc.utf8_length(cols[at]).cast(cols[counted].type))
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:width]).filter(pa.array(keep))

    return found.mapInArrow(work, StructType(found.schema.fields[:width])).toDF(*docs.columns)


def without(text: str, hits: list[tuple[int, int]]) -> str:
    """The text less the given ranges of its words."""
    raw = text.encode()
    mask = np.frombuffer(raw.translate(KEEP), np.uint8) != 32
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, last = [], 0
    for a, b in hits:
        out.append(raw[last : begin[a]])
        last = int(end[b - 1])
    out.append(raw[last:])
    return b"".join(out).decode()
