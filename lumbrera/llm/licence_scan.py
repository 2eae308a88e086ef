"""Licence scans by Dice coefficient over word bigrams.

A document's words are compared with licence templates: for each template and each place where one of its bigrams stands, the stretch from there
whose set of bigrams has the highest Dice coefficient with the template's. A stretch of s distinct bigrams and a template of t can only reach a
coefficient of q if q / (2 - q) <= s / t <= (2 - q) / q; these bounds, with the number of the template's own distinct bigrams that a text and a
stretch hold, leave most templates and stretches out before a coefficient is computed. The best stretch begins and ends with a bigram of the
template, each of them new to it, so only those are tried, and none is missed. Going through the words from the last to the first, the
distinct bigrams that follow are kept in the order in which they first stand, so a place takes one look at no more of them than the
upper bound allows, however often they are repeated: the work is in proportion to the text.

Of matches that overlap, the one of the highest coefficient stays (then the longer, then the earlier, then by name). The words left
before, between and after the matches are compared again until none matches, so a text that stands several times is found each time. Words are maximal runs of
ASCII letters (A-Z lower-cased), digits and non-ASCII characters. Null or empty texts, and texts of one word, have no matches. Repeated rows
give repeated results; a null doc_id stays null. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.common import bounded_batches, chunks, strings
from lumbrera.llm.licence_texts import templates

MIN_DICE = 0.8
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

Match = tuple[str, int, int, float]


class Templates:
    def __init__(self, texts: list[tuple[str, str]], least: float = MIN_DICE) -> None:
        self.least = least
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = []
        self.sizes: list[int] = []
        index: dict[int, list[int]] = {}
        grams = []
        for name, text in texts:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in text.encode().translate(FOLD).split()]
            if len(ids) > 1:
                grams.append((name, set(zip(ids, ids[1:], strict=False))))
        self.base = len(self.vocab) + 1
        for name, own in grams:
            for a, b in own:
                index.setdefault(a * self.base + b, []).append(len(self.names))
            self.names.append(name)
            self.sizes.append(len(own))
        self.keys = np.array(sorted(index), np.int64)
        self.where = [index[k] for k in sorted(index)]
        self.bounds = [(least / (2 - least) * t, (2 - least) / least * t) for t in self.sizes]

    def matches(self, text: str) -> list[Match]:
        """(licence, first word, last word, coefficient) by first word; the words left between matches are looked at again."""
        ws = text.encode().translate(FOLD).split()
        out: list[Match] = []
        left = [(0, len(ws))]
        while left:
            lo, hi = left.pop()
            found = [(name, lo + a, lo + b, dice) for name, a, b, dice in self.once(ws[lo:hi])]
            if found:
                out += found
                left += zip([lo, *(b + 1 for _, _, b, _ in found)], [*(a for _, a, _, _ in found), hi], strict=True)
        return sorted(out, key=lambda m: m[1])

    def once(self, ws: list[bytes]) -> list[Match]:
        """The best stretches, those left out that overlap a better one."""
        if len(ws) < 2:
            return []
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in ws], np.int64)
        key = ids[:-1] * self.base + ids[1:]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        here = (self.keys[at] == key) & (ids[:-1] > 0) & (ids[1:] > 0)
        hits: dict[int, list[int]] = {}
        for k in np.unique(at[here]).tolist():
            for t in self.where[k]:
                hits.setdefault(t, []).append(k)
        # With fewer of its bigrams a template cannot reach the least coefficient.
        hits = {t: own for t, own in hits.items() if len(own) >= self.least * self.sizes[t] / (2 - self.least) - 1e-9}
        if not hits:
            return []
        number: dict[tuple[bytes, bytes], int] = {}
        grams = [number.setdefault(g, len(number)) for g in zip(ws, ws[1:], strict=False)]
        found: list[tuple[float, int, int, str]] = []
        for t, own in hits.items():
            places = np.flatnonzero(here & np.isin(at, own)).tolist()
            ours = bytearray(len(number))
            for p in places:
                ours[grams[p]] = 1
            best = self.from_each(t, places, grams, ours)
            best.sort(key=lambda m: (-m[0], m[1], m[2]))
            found += [(*m, self.names[t]) for m in apart(best)]
        found.sort(key=lambda m: (-m[0], m[1] - m[2], m[1], m[3]))
        return sorted(((name, a, b, dice) for dice, a, b, name in apart(found)), key=lambda m: m[1])

    def from_each(self, t: int, places: list[int], grams: list[int], ours: bytearray) -> list[tuple[float, int, int]]:
        """Coefficient, first and last word of the best stretch from each place (the shortest of equals), if it reaches the least."""
        size, most = self.sizes[t], int(self.bounds[t][1] + 1e-9)
        ahead: OrderedDict[int, int] = OrderedDict()  # distinct bigrams, the one that stands next last
        starts, out = set(places), []
        for p in range(places[-1], places[0] - 1, -1):
            ahead[grams[p]] = p
            ahead.move_to_end(grams[p])
            if p not in starts:
                continue
            best, end, shared = 0.0, p, 0
            for seen, (g, q) in enumerate(islice(reversed(ahead.items()), most), 1):
                if ours[g]:
                    shared += 1
                    dice = 2 * shared / (seen + size)
                    if dice > best:
                        best, end = dice, q
            if best >= self.least:
                out.append((best, p, end + 1))
        return out


def apart(found: Iterable[tuple]) -> list[tuple]:
    """Of (coefficient, first, last, ...), best first, those that overlap none before them."""
    begins: list[int] = []
    ends: list[int] = []
    out = []
    for m in found:
        k = bisect_left(begins, m[1])
        if (k == 0 or ends[k - 1] < m[1]) and (k == len(begins) or m[2] < begins[k]):
            begins.insert(k, m[1])
            ends.insert(k, m[2])
            out.append(m)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_DICE, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id and matches array<struct<licence, first, last, dice>>, first and last being word numbers, last inclusive."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(Templates(texts or templates(), least))
    kind = pa.list_(pa.struct([("licence", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("dice", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for whole in batches:
            for b in chunks(whole, 1):
                found = [[{"licence": n, "first": x, "last": y, "dice": d} for n, x, y, d in own.matches(t)] for t in strings(b.column(1)).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], [id_col, "matches"])

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, matches array<struct<licence:string,first:bigint,last:bigint,dice:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, licences (distinct, sorted, comma-joined), n_matches, best_licence, best_dice and the matches as licence:first:last."""
    m = scan(docs)
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["licence"])))
    best = F.aggregate("matches", F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("licence")), lambda acc, x: F.when(x["dice"] > acc["dice"], F.struct(x["dice"].alias("dice"), x["licence"].alias("licence"))).otherwise(acc))
    text = F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["licence"], x["first"].cast("string"), x["last"].cast("string"))), ",")
    return m.select("doc_id", F.array_join(names, ",").alias("licences"), F.size("matches").cast("bigint").alias("n_matches"), best["licence"].alias("best_licence"), F.round(best["dice"], 6).alias("best_dice"), text.alias("matches"))
