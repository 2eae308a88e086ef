"""Near-duplicate passages across documents through compact windows.

A document is a sequence of 5-word shingles. For each of ``len(MULTIPLIERS)`` hash functions, the Cartesian tree over the shingles' hashes gives
compact windows: (l, c, r) such that every subsequence from l..c to c..r has its minimum at c; those at least ``MIN_SHINGLES`` wide are kept,
about 2 n / MIN_SHINGLES of them. An interval join within the document joins the windows of two functions that share a subsequence of
exactly that width with both minima; its signature is the pair of minima. Passages that share a signature are candidates.

In the first round a signature's documents are led by the smallest one. Each other one is verified against the leader: their shared shingles form
stretches, which count as near duplicates at a Jaccard similarity of ``MIN_SIMILARITY`` or more over at least MIN_SHINGLES shingles. Places that a
verified stretch covers are done with.

What is left may be near another document of the signature, be that covered or not. Passages of MIN_SHINGLES shingles at that similarity have one
edit at most, so that they share a run of 20 shingles, and longer ones longer runs. So the places of those signatures are put into groups by
16 equal shingles before, after or about them, each place once however many signatures it has, which tells apart documents that only have a frequent line in common. A group's
distinct surroundings, each by its smallest document, lead it: the uncovered places are verified against the first ``LEADERS`` of them, and then
against all the others, if there are ``GROUP`` at most. The places still uncovered of larger groups, as of a paragraph that stands in thousands of
documents that are unlike otherwise, are told apart in the same way by MIN_SHINGLES equal shingles, which are a passage already.

What is still uncovered in those larger groups is held against all of their surroundings (``likely_pairs``): by the shingles about both places first, in blocks of
surroundings, which takes no row a pair; and then by the texts, with each earlier document that has as many shingles of a window about the place as a passage needs.
So no pair that could be near is left out. Such pairs that are not near are verified too; in the worst case their number is the square of such a group.

Leaders with many followers are salted: each task holds one leader's shingles and one follower at a time.

Of a long run of shingles that each stood within the last MIN_SHINGLES places, as of a line repeated over and over, the middle gives no windows;
its ends do, so that such a passage is found in another document too.

Words are maximal runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. Null, empty and shorter texts have no
passages. Documents are told apart by doc_id and a hash of the text, in that order: rows that repeat a doc_id with another text are documents of
their own, rows that repeat both are one. Repeats within one document are not compared. Rows without a doc_id have no passages. Other
columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbrera.llm.common import bounded_batches, chunks, cut, discard, ragged, strings
from lumbrera.llm.sketch import FOLD, SHINGLE

MIN_WORDS = 50
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
MIN_SIMILARITY = 0.8
FOLLOWERS = 512
#: Leaders that the places left of a group are held against first, and surroundings of a group that are all held against each other.
LEADERS, GROUP = 8, 64
#: Equal shingles about a place that put it into one group, and those that make up its surroundings.
RUNS, AROUND = (16, MIN_SHINGLES), 2 * MIN_SHINGLES - 1
#: Shingles to either side of a leader's place that a passage may take up there, and surroundings of a group that a task holds.
REACH, BLOCK = int(np.ceil(MIN_SHINGLES / MIN_SIMILARITY)), 2048
#: Texts and shingles that a task keeps for further pairs of theirs, about.
KNOWN_BYTES = 32 << 20
#: At most so many numbers are broadcast, whatever the corpus is.
SPOTS = 1 << 20
#: Odd multipliers; functions 2 k and 2 k + 1 make signature k.
MULTIPLIERS = np.random.default_rng(19).integers(1 << 62, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> np.ndarray:
    """Hashes of the text's shingles, mixed from those of its words; none of a text with fewer words.

    Within one task Python's own hash of a word will do; what is compared between tasks needs one that is the same everywhere.
    """
    ws = text.encode().translate(FOLD).split()
    if len(ws) < SHINGLE:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(digest, ws), np.uint64 if digest is not hash else np.int64, len(ws)).view(np.uint64)
    n = len(ws) - SHINGLE + 1
    h = w[:n].copy()
    for k in range(1, SHINGLE):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return h ^ (h >> np.uint64(29))


def smaller(h: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller hash (the left one of equals being smaller), or -1, by pointer jumping."""
    at = np.arange(-1, len(h) - 1)
    live = np.arange(len(h))
    while len(live):
        live = live[at[live] >= 0]
        live = live[h[at[live]] > h[live]]
        at[live] = at[at[live]]
    return at


def compact_windows(h: np.ndarray, least: int = MIN_SHINGLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree's nodes that span at least ``least`` places, by c.

    Such a node is the (left one of the) least of some ``least`` places in a row; and so are the nearest smaller places on either side of it, as they span all
    that it spans. So the tree is made of these places alone.
    """
    n, width = len(h), 1
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    at, low = np.arange(n), h
    while width < least:
        step = min(width, least - width)
        at = np.where(low[step:] < low[:-step], at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        width += step
    c = at[np.r_[True, at[1:] != at[:-1]]]
    few = h[c]
    left = np.r_[c + 1, 0][smaller(few)]
    back = few[::-1]
    # From the right, an equal hash further left is the smaller one.
    at = np.arange(-1, len(c) - 1)
    live = np.arange(len(c))
    while len(live):
        live = live[at[live] >= 0]
        live = live[back[at[live]] >= back[live]]
        at[live] = at[at[live]]
    right = np.r_[c[::-1] - 1, n - 1][at][::-1]
    return left, c, right


def signatures(docs: list[np.ndarray], least: int = MIN_SHINGLES) -> tuple[np.ndarray, ...]:
    """(signature, document, place): joined windows of each two functions, the place being the first of the two minima.

    The documents lie one after another, with a hash smaller than all others between them, so that no window spans two. All places of
    a signature in a document are kept.
    """
    sizes = np.array([len(h) for h in docs])
    flat, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(flat)
    # Equal hashes are few: only those are put into the order of their places.
    same = np.diff(flat[order]) == 0
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    order[tied] = order[tied][np.lexsort((order[tied], flat[order[tied]]))]
    again = np.zeros(len(flat), bool)
    again[order[1:]] = (np.diff(flat[order]) == 0) & (np.diff(order) < least) & (owner[order[1:]] == owner[order[:-1]])
    # Of a run of such places only the middle goes: every window at either end, and one of each phase of the repeats, stays whole.
    edge = np.flatnonzero(np.diff(np.concatenate(([False], again, [False])).astype(np.int8)))
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        again[lo : min(hi, lo + 2 * least)] = again[max(lo, hi - 2 * least) : hi] = False
    original = np.flatnonzero(~again)
    flat, owner = flat[original], owner[original]
    original -= (np.cumsum(sizes) - sizes)[owner]
    sizes = np.bincount(owner, minlength=len(docs))
    starts = np.cumsum(sizes + 1) - sizes
    h = np.zeros(int((sizes + 1).sum()) + 1, np.uint64)
    real = np.zeros(len(h), bool)
    at = ragged(starts, sizes)
    h[at], real[at] = flat, True
    keys, places = [], []
    for k in range(0, len(MULTIPLIERS), 2):
        ha, hb = (np.where(real, np.maximum(h * m, np.uint64(1)), np.uint64(0)) for m in MULTIPLIERS[k : k + 2])
        (la, ca, ra), (lb, cb, rb) = (tuple(x[real[w[1]]] for x in w) for w in (compact_windows(ha, least), compact_windows(hb, least)))
        # Minima that one subsequence of the least width holds lie closer together than that.
        first = np.searchsorted(cb, np.maximum(la, ca - least + 1))
        last = np.searchsorted(cb, np.minimum(ra, ca + least - 1), side="right")
        i = np.repeat(np.arange(len(ca)), last - first)
        j = ragged(first, last - first)
        both = (lb[j] <= ca[i]) & (ca[i] <= rb[j]) & (np.minimum(ra[i], rb[j]) - np.maximum(la[i], lb[j]) + 1 >= least)
        i, j = i[both], j[both]
        key = (ha[ca[i]] ^ (ha[ca[i]] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hb[cb[j]] + np.uint64(k)
        keys.append(key ^ (key >> np.uint64(31)))
        places.append(np.minimum(ca[i], cb[j]))
    key, place = np.concatenate(keys), np.concatenate(places)
    doc = np.searchsorted(starts, place, side="right") - 1
    order = np.lexsort((place, key))
    first = np.r_[True, (np.diff(key[order]) != 0) | (np.diff(place[order]) != 0)] if len(key) else np.zeros(0, bool)
    key, place, doc = (x[order][first] for x in (key, place, doc))
    return key, doc, original[place - 1 - doc]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, text) of the rows with a doc_id; th tells texts of one doc_id apart."""
    known = docs.where(F.col(id_col).isNotNull())
    return known.select(F.col(id_col).cast("bigint").alias("doc"), F.hash(text_col).alias("th"), F.col(text_col).alias("text"))


def members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(group, doc, th, place), the group being the signature."""
    names = ["group", "doc", "th", "place"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 2):
                texts = strings(b.column(2)).to_pylist()
                hashes = [shingles(t) if len(t) >= 2 * MIN_WORDS - 1 else () for t in texts]
                long = [k for k, h in enumerate(hashes) if len(h) >= MIN_SHINGLES]
                if long:
                    key, doc, place = signatures([hashes[k] for k in long])
                    at = pa.array(np.array(long)[doc])
                    cols = [pa.array(key.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(place.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return identified(docs, id_col, text_col).mapInArrow(work, "group bigint, doc bigint, th int, place int")


def shared(rows: DataFrame) -> DataFrame:
    """The rows whose group has two documents or more."""
    ends = [F.min("doc").alias("_low"), F.max("doc").alias("_high"), F.min("th").alias("_th"), F.max("th").alias("_other")]
    groups = rows.groupBy("group").agg(*ends).where("_low <> _high OR _th <> _other").select("group")
    # Those groups are few beside the rows: they are hashed, and the rows need no sort.
    return rows.join(groups.hint("shuffle_hash"), "group")


def mixed(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(30))


def backs(size: int) -> tuple[int, int, int]:
    """How far before a place its three runs of ``size`` shingles begin."""
    return 0, size - 1, size // 2


def by_words(rows: DataFrame, size: int, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(group, doc, th, place, open, around): each place (doc, th, place, open) in three groups, by the ``size`` shingles from it on, up to it and about it.

    The last two bits of ``group`` tell which of the three. ``around`` is a hash of the AROUND shingles about the place: every passage of the least length with that place lies within them. Repeated places count once.
    """
    own = rows.groupBy("doc", "th").agg(F.collect_set(F.struct("place", "open")).alias("asked"))
    texts = fetched(docs, own, id_col, text_col).select("doc", "th", "asked", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 3):
                own = b.column(2)
                place, left = (own.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                edge, row, out = own.offsets.to_numpy(), np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy())), []
                for n, text in enumerate(b.column(3).to_pylist()):
                    h = shingles(text or "")
                    # The running sum of mixed hashes tells stretches of shingles apart.
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h) * MULTIPLIERS[0])))
                    own_rows = np.arange(edge[n], edge[n + 1])
                    at = place[own_rows].astype(np.int64)
                    lo, hi = np.maximum(at - AROUND // 2, 0), np.minimum(at + AROUND // 2 + 1, len(h))
                    around = mixed((total[hi] - total[lo]) * MULTIPLIERS[1] + (at - lo).astype(np.uint64))
                    for side, back in enumerate(backs(size)):
                        lo = at - back
                        k = np.flatnonzero((lo >= 0) & (lo + size <= len(h)))
                        run = mixed((total[lo[k] + size] - total[lo[k]]) * MULTIPLIERS[1])
                        out.append((run & ~np.uint64(3) | np.uint64(side), own_rows[k], around[k]))
                if out:
                    run, k, around = (np.concatenate(x) for x in zip(*out, strict=True))
                    ids = [b.column(c).take(pa.array(row[k - edge[0]])) for c in (0, 1)]
                    cols = [pa.array(run.view(np.int64)), *ids, pa.array(place[k]), pa.array(left[k]), pa.array(around.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["group", "doc", "th", "place", "open", "around"])

    return texts.mapInArrow(work, "group bigint, doc bigint, th int, place int, open boolean, around bigint")


def fetched(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``asked`` (doc, th, ...) with the texts. Texts whose place in a table of SPOTS places nothing asked for has stay out of the shuffle."""
    spot = F.pmod(F.xxhash64("doc"), F.lit(SPOTS))
    spots = asked.select(spot.alias("_spot")).distinct()
    texts = identified(docs, id_col, text_col).withColumn("_spot", spot).join(F.broadcast(spots), "_spot", "left_semi").drop("_spot")
    return asked.join(texts, ["doc", "th"])


PAIR = ["leader", "leader_th", "doc", "th"]
EARLIER = "leader < doc OR leader = doc AND leader_th < th"


def first_asked(rows: DataFrame) -> DataFrame:
    """The distinct pairs (leader, leader_th, doc, th) of each group's smallest document and another."""
    lead = rows.groupBy("group").agg(F.min(F.struct("doc", "th")).alias("_lead"))
    lead = lead.select("group", F.col("_lead.doc").alias("leader"), F.col("_lead.th").alias("leader_th"))
    return rows.join(lead.hint("shuffle_hash"), "group").where(EARLIER).select(*PAIR).distinct()


class Leader:
    """A document's shingles, sorted once for all of its followers."""

    def __init__(self, a: np.ndarray) -> None:
        self.a, self.order = a, np.argsort(a, kind="stable")
        self.sorted = a[self.order]


def stretches(lead: Leader, b: np.ndarray, least: int = MIN_SHINGLES, like: float = MIN_SIMILARITY) -> list[tuple[int, int, int, int]]:
    """(first, last, first in the leader, last in the leader) of the places of b that are near a passage of the leader."""
    a, order, ordered = lead.a, lead.order, lead.sorted
    if len(a) < least or len(b) < least:
        return []
    if np.array_equal(a, b):
        return [(0, len(b) - 1, 0, len(a) - 1)]
    at = np.searchsorted(ordered, b)
    at[at == len(a)] = 0
    same = ordered[at] == b
    # A stretch that is alike shares 2 like / (1 + like) of its shingles, so some window of the least length nearly does.
    total = np.cumsum(np.concatenate(([0], same)))
    dense = total[least:] - total[:-least]
    if dense.max() < like * least:
        return []
    # Shared shingles count only where a window of the least length shares half of its own, not scattered lines.
    edge = np.zeros(len(b) + 1, np.int32)
    half = np.flatnonzero(2 * dense >= least)
    edge[half] += 1
    edge[half + least] -= 1
    counted = same & (np.cumsum(edge[:-1]) > 0)
    where, hit = order[at], np.flatnonzero(counted)
    # A shingle may stand in a several times: its first and last place give diagonals, and equal places along those with some hits give runs.
    final = order[np.searchsorted(ordered, b[hit], side="right") - 1]
    diags, counts = np.unique(np.concatenate((where[hit] - hit, final - hit)), return_counts=True)
    # Words repeated over and over have too many diagonals with few hits: those from the ends of long stretches of shared shingles will do.
    ends = np.flatnonzero(np.diff(np.concatenate(([False], counted, [False])).astype(np.int8)))
    long = ends[1::2] - ends[::2] >= least
    first, last = ends[::2][long], ends[1::2][long] - 1
    of_last = order[np.searchsorted(ordered, b[last], side="right") - 1]
    runs = []
    for d in np.unique(np.concatenate((diags[counts >= SHINGLE], where[first] - first, of_last - last))).tolist():
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        equal = np.zeros(hi - lo + 2, bool)
        np.equal(a[lo + d : hi + d], b[lo:hi], out=equal[1:-1])
        edge = np.flatnonzero(equal[1:] != equal[:-1]).tolist()
        runs += [(lo + x, lo + y - 1, d) for x, y in zip(edge[::2], edge[1::2], strict=True) if y - x >= SHINGLE]
    runs.sort(key=lambda run: (run[0], -run[1]))
    far = -1
    out: list[tuple[int, int, int, int]] = []
    # Runs on one diagonal or near it grow into stretches as long as they stay alike; a gap of over a quarter of what is shared never is.
    open_: list[list[int]] = []
    for i, j, d in runs:
        # What lies within an equal passage seen before adds nothing.
        if j <= far:
            continue
        if j - i + 1 >= least:
            far = j
        for s in open_:
            if 4 * (i - s[1] - 1) <= s[5] + j - i + 1 and abs(d - s[4]) <= least and i + d > s[3] and i > s[1] and j + d - s[2] >= 0 and jaccard_bound(s, i, j, d) >= like:
                s[1], s[3], s[4], s[5] = j, j + d, d, s[5] + j - i + 1
                break
        else:
            open_ = [s for s in open_ if i - s[1] <= max(least, s[1] - s[0])] if len(open_) > 16 else open_
            done = [i, j, i + d, j + d, d, j - i + 1]
            open_.append(done)
            out.append(done)  # type: ignore[arg-type]
    equal_all = lambda s: s[5] == s[1] - s[0] + 1 == s[3] - s[2] + 1
    return [(s[0], s[1], s[2], s[3]) for s in out if s[1] - s[0] + 1 >= least and (equal_all(s) or jaccard(a[s[2] : s[3] + 1], b[s[0] : s[1] + 1]) >= like)]


def jaccard_bound(s: list[int], i: int, j: int, d: int) -> float:
    """Similarity of a stretch with a run added, if no shingle repeats."""
    common = s[5] + j - i + 1
    return common / ((j - s[0] + 1) + (j + d - s[2] + 1) - common)


def distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.r_[True, a[1:] != a[:-1]]]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = distinct(a), distinct(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


SEGMENTS = "doc bigint, th int, leader bigint, leader_th int, first int, last int, from_first int, from_last int"


def verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Near-duplicate stretches (in shingles) of each pair (leader, leader_th, doc, th)."""
    parts = pairs.groupBy("leader", "leader_th").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts"))
    salted = pairs.join(parts, ["leader", "leader_th"]).select(*PAIR, F.pmod(F.xxhash64("doc", "th"), F.col("parts")).cast("int").alias("part"))
    lead = parts.select("leader", "leader_th", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # Each text is fetched once for all its rows, as leader and as follower.
    roles = salted.select("doc", "th", "leader", "leader_th", "part", F.lit(1).alias("role")).unionAll(
        lead.select(F.col("leader").alias("doc"), F.col("leader_th").alias("th"), "leader", "leader_th", "part", F.lit(0).alias("role"))
    )
    keys = ["leader", "leader_th", "part"]
    rows = fetched(docs, roles, id_col, text_col).repartition(*keys).sortWithinPartitions(*keys, "role", "doc", "th").select(*keys, "role", "doc", "th", "text")
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 5]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead, known, size = None, None, {}, 0
        for whole in batches:
            for b in chunks(whole, 6):
                out = []
                for leader, leader_th, part, role, doc, th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    # A document has many leaders, and copies of the leader are many.
                    h = known.get(text)
                    if h is None:
                        h = shingles(text or "", hash)
                        size += len(text or "") + h.nbytes
                        if size > KNOWN_BYTES:
                            known, size = {}, 0
                        known[text] = h
                    if role == 0:
                        held, lead = (leader, leader_th, part), Leader(h)
                    elif held == (leader, leader_th, part):
                        out += [(doc, th, leader, leader_th, *s) for s in stretches(lead, h)]
                if out:
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [p.split()[0] for p in SEGMENTS.split(", ")])

    return rows.mapInArrow(work, SEGMENTS)


def merged(spans: F.Column) -> F.Column:
    """Of structs (first, last), ascending: those that touch or overlap as one."""
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    joined = lambda acc, x: F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], x["last"]).alias("last"))
    add = lambda acc, x: F.when(
        (F.size(acc) > 0) & (last(acc)["last"] >= x["first"] - 1), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined(acc, x)))
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(spans, F.array().cast("array<struct<first:int,last:int>>"), add)


def spans_of(found: DataFrame) -> DataFrame:
    """(doc, th, spans): each document's verified stretches, merged."""
    return found.groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")).select("doc", "th", merged(F.col("spans")).alias("spans"))


OPEN = "spans IS NULL OR NOT exists(spans, s -> place BETWEEN s.first AND s.last)"


def twins(rows: DataFrame) -> bool:
    """Whether texts share a doc_id."""
    return not rows.groupBy("doc").agg(F.min("th").alias("_th"), F.max("th").alias("_other")).where("_th <> _other").isEmpty()


def worth(rows: DataFrame, twice: bool) -> DataFrame:
    """The rows of groups in which an open document has an earlier one, or (where texts share a doc_id: ``twice``) may have one of its own doc_id."""
    ends = [F.min("doc").alias("_low"), F.max(F.when(F.col("open"), F.col("doc"))).alias("_high"), F.min("th").alias("_th"), F.max("th").alias("_other")]
    groups = rows.groupBy("group").agg(*ends).where("_low < _high OR _low = _high AND _th <> _other" if twice else "_low < _high").select("group")
    return rows.join(groups.hint("shuffle_hash"), "group")


def ranked(rows: DataFrame) -> DataFrame:
    """(group, leader, leader_th, place, rank, n): each group's distinct surroundings by their smallest documents, in order."""
    lead = rows.groupBy("group", "around").agg(F.min(F.struct("doc", "th", "place")).alias("_lead")).select("group", "_lead.*")
    own = W.partitionBy("group")
    names = [F.col("doc").alias("leader"), F.col("th").alias("leader_th"), "place"]
    return lead.select("group", *names, F.row_number().over(own.orderBy("doc", "th", "place")).alias("rank"), F.count("*").over(own).alias("n"))


def surroundings(places: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, place, at, near): of each place (doc, th, place) half the bits of the shingles up to REACH from it, and its own position among them."""
    own = places.groupBy("doc", "th").agg(F.collect_set("place").alias("asked"))
    texts = fetched(docs, own, id_col, text_col).select("doc", "th", "asked", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 3):
                row, place, at, near = [], [], [], []
                for n, (own, text) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    h = (shingles(text or "") >> np.uint64(32)).astype(np.uint32)
                    for p in own:
                        lo = max(0, p - REACH)
                        row.append(n)
                        place.append(p)
                        at.append(p - lo)
                        near.append(h[lo : p + REACH + 1].tobytes())
                cols = [b.column(c).take(pa.array(row)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(place, pa.int32()), pa.array(at, pa.int32()), pa.array(near, pa.binary())], ["doc", "th", "place", "at", "near"])

    return texts.mapInArrow(work, "doc bigint, th int, place int, at int, near binary")


class Met:
    """Which documents have met which leaders, numbered as they come. At most about ``most`` flags are kept; then the documents start anew."""

    def __init__(self, most: int = 1 << 25) -> None:
        self.most, self.ids, self.flags, self.held = most, {}, {}, 0

    def numbers(self, rows: list[tuple[int, int, int, np.ndarray]]) -> np.ndarray:
        return np.array([self.ids.setdefault(x[:2], len(self.ids)) for x in rows])

    def of(self, doc: int, th: int) -> np.ndarray:
        own = self.flags.get((doc, th))
        if own is None or len(own) < len(self.ids):
            own, before = np.zeros(2 * len(self.ids), bool), own
            self.held += len(own)
            if self.held > self.most:
                self.flags, self.held = {}, len(own)
            if before is not None:
                own[: len(before)] = before
            self.flags[doc, th] = own
        return own


class Surroundings:
    """The surroundings (doc, th, at, shingles) of a block of a group's leaders, by shingle."""

    def __init__(self, rows: list[tuple[int, int, int, np.ndarray]]) -> None:
        near = [np.unique(x) for *_, x in rows]
        self.rows, self.doc, self.th = rows, np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64)
        owner, flat = np.repeat(np.arange(len(near)), [len(x) for x in near]), np.concatenate(near)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owner = flat[order], owner[order]

    def dense(self, asked: list[np.ndarray], least: int = MIN_SHINGLES, like: float = MIN_SIMILARITY) -> list[int]:
        """Those of ``asked`` with ``least`` shingles in a row of which as many as a passage needs stand in the block, at whatever leaders."""
        long = [k for k, h in enumerate(asked) if len(h) >= least]
        if not long or not len(self.shingles):
            return []
        flat, sizes = np.concatenate([asked[k] for k in long]), np.array([len(asked[k]) for k in long])
        at = np.searchsorted(self.shingles, flat)
        at[at == len(self.shingles)] = 0
        total = np.concatenate(([0], np.cumsum(self.shingles[at] == flat)))
        held, starts = total[least:] - total[:-least], np.cumsum(sizes) - sizes
        # No window spans two of them.
        for k in range(1, least):
            held[starts[1:] - k] = 0
        return [long[k] for k in np.flatnonzero(np.maximum.reduceat(held, starts) >= like * least).tolist()]

    def earlier(self, doc: int, th: int) -> np.ndarray:
        return (self.doc < doc) | (self.doc == doc) & (self.th < th)

    def like(self, h: np.ndarray, least: int = MIN_SHINGLES, like: float = MIN_SIMILARITY, of: np.ndarray | None = None) -> list[tuple[int, int, int, np.ndarray]]:
        """The leaders (among those marked in ``of``) that have as many shingles of some ``least`` ones in a row of h as a passage needs."""
        # A line repeated over and over has few shingles at many places.
        own, place, times = np.unique(h, return_inverse=True, return_counts=True)
        lo = np.searchsorted(self.shingles, own)
        n = np.searchsorted(self.shingles, own, side="right") - lo
        total = np.cumsum(np.concatenate(([0], (n > 0)[place])))
        if len(h) < least or (total[least:] - total[:-least]).max() < like * least:
            return []
        owner, at = self.owner[ragged(lo, n)], np.repeat(np.arange(len(own)), n)
        likely = np.bincount(owner, times[at], len(self.rows)) >= like * least
        if of is not None:
            likely &= of
        if not likely.any():
            return []
        row, keep = np.cumsum(likely) - 1, likely[owner]
        has = np.zeros((int(likely.sum()), len(own)), np.int8)
        has[row[owner[keep]], at[keep]] = 1
        total = np.cumsum(has[:, place], axis=1, dtype=np.int16)
        total = np.concatenate((np.zeros((len(total), 1), np.int16), total), axis=1)
        found = np.flatnonzero(likely)[(total[:, least:] - total[:, :-least] >= like * least).any(axis=1)]
        return [self.rows[k] for k in found.tolist()]


def about(at: int, h: np.ndarray) -> np.ndarray:
    return h[max(0, at - MIN_SHINGLES + 1) : at + MIN_SHINGLES]


def likely_pairs(lead: DataFrame, left: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(leader, leader_th, doc, th) of the open places ``left`` and the earlier surroundings ``lead`` of their groups that could be near there.

    A near passage of the least length with the place lies within MIN_SHINGLES - 1 of it, and its like within REACH of the leader's place. Groups with one smallest
    document are a family. Each task holds a share of a family's leaders, whichever groups they are in, group by group (at most about BLOCK surroundings at a time), and the open places
    of the group pass by one at a time. So most groups in which a document meets a leader over and over, as one for each place of a passage, are in one task, which hands the two on once.
    """
    known = lead.join(left.select("group").distinct(), "group").select("group", F.col("leader").alias("doc"), F.col("leader_th").alias("th"), "place")
    asking = left.select("group", "doc", "th", "place").distinct()
    near = cut(surroundings(known.select("doc", "th", "place").unionAll(asking.select("doc", "th", "place")), docs, id_col, text_col))
    groups = known.groupBy("group").agg(F.min("doc").alias("family"), F.count("*").alias("_n"))
    shares = groups.groupBy("family").agg(F.ceil(F.max("_n") / BLOCK).cast("int").alias("shares"))
    groups = cut(groups.join(shares, "family").select("group", "family", "shares"))
    own = F.pmod(F.xxhash64("doc", "th"), F.col("shares")).cast("int")
    rows = known.join(groups, "group").select("family", own.alias("part"), "group", F.lit(0).alias("role"), "doc", "th", "place").unionAll(
        asking.join(groups, "group").select("family", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"), "group", F.lit(1).alias("role"), "doc", "th", "place")
    )
    keys = ["family", "part"]
    rows = rows.join(near, ["doc", "th", "place"]).select(*keys, "group", "role", "doc", "th", "at", "near").repartition(*keys).sortWithinPartitions(*keys, "group", "role")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leaders, block, waiting, out, met, who = None, [], None, [], [], Met(), None

        def answer() -> None:
            nonlocal block, who
            if waiting and leaders:
                if block is None:
                    block, who = Surroundings(leaders), met.numbers(leaders)
                asked = [about(at, h) for *_, at, h in waiting]
                for k in block.dense(asked):
                    doc, th = waiting[k][:2]
                    done = met.of(doc, th)
                    found = {x[:2] for x in block.like(asked[k], of=block.earlier(doc, th) & ~done[who])}
                    done[[met.ids[x] for x in found]] = True
                    out.extend((*x, doc, th) for x in found)
            waiting.clear()

        for b in batches:
            for family, part, group, role, doc, th, at, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held != (family, part, group):
                    answer()
                    if not held or held[:2] != (family, part):
                        met = Met()
                    held, leaders, block = (family, part, group), [], None
                (waiting if role else leaders).append((doc, th, at, np.frombuffer(x, np.uint32)))
            answer()
            if out:
                kinds = [pa.int64(), pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], PAIR)
                out.clear()

    out = cut(rows.mapInArrow(work, "leader bigint, leader_th int, doc bigint, th int").distinct())
    discard(near)
    discard(groups)
    return out


def still_open(left: DataFrame, found: DataFrame) -> DataFrame:
    return left.join(spans_of(found), ["doc", "th"], "left").where(OPEN).drop("spans")


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and th, leader and leader_th (an earlier document), first and last word of the passage in doc, and those in leader; last is inclusive."""
    spark = docs.sparkSession
    bounded_batches(spark)
    every = cut(members(docs, id_col, text_col))
    rows = cut(shared(every))
    discard(every)
    tried = cut(first_asked(rows))
    found = cut(verified(docs, tried, id_col, text_col))

    def hold(ask: DataFrame, left: DataFrame) -> DataFrame:
        """Verify those pairs that have not been tried; the places of ``left`` that stay open."""
        nonlocal tried, found
        pairs = cut(ask.select(*PAIR).distinct().join(tried, PAIR, "left_anti"))
        if pairs.isEmpty():
            return left
        tried = tried.unionAll(pairs)
        new = cut(verified(docs, pairs, id_col, text_col))
        found = found.unionAll(new)
        return cut(still_open(left, new))

    before, rows = rows, cut(rows.join(spans_of(found), ["doc", "th"], "left").select("group", "doc", "th", "place", F.expr(OPEN).alias("open")))
    discard(before)
    twice = twins(rows)
    places, spent, large = worth(rows, twice).select("doc", "th", "place", "open"), [rows], None
    for size in RUNS:
        runs = cut(by_words(places, size, docs, id_col, text_col))
        for table in spent:
            discard(table)
        lead = cut(ranked(worth(runs, twice)))
        spent = [lead] if large else []
        if lead.isEmpty():
            break
        left = cut(runs.where("open").join(lead.where("rank = 1 AND n > 1"), "group").where(EARLIER).select("group", "doc", "th", runs["place"], "n"))
        discard(runs)
        for low, high, most in ((0, LEADERS, 1 << 62), (LEADERS, GROUP, GROUP)):
            turn = lead.where((F.col("rank") > low) & (F.col("rank") <= high) & (F.col("n") <= most))
            left = hold(left.select("group", "doc", "th").join(turn, "group").where(EARLIER), left)
        # Smaller groups have been held against each other.
        left = left.where(F.col("n") > GROUP)
        if left.isEmpty():
            break
        again = lead.join(left.select("group").distinct(), "group").select(F.col("leader").alias("doc"), F.col("leader_th").alias("th"), "place", F.lit(False).alias("open"))
        again = again.unionAll(left.select("doc", "th", "place", F.lit(True).alias("open")))
        places = again.groupBy("doc", "th", "place").agg(F.max("open").alias("open"))
        large = large or (lead, left)
    if large:
        lead, left = large
        left = cut(still_open(left, found))
        if not left.isEmpty():
            hold(likely_pairs(lead, left, docs, id_col, text_col), left)
    word = F.lit(SHINGLE - 1)
    ends = [F.col("first"), (F.col("last") + word).alias("last"), F.col("from_first"), (F.col("from_last") + word).alias("from_last")]
    return found.distinct().select("doc", "th", "leader", "leader_th", *ends)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_passages, n_words in them, the earlier documents (ascending) and the merged word spans as first:last."""
    found = cut(near_passages(docs))
    spans = spans_of(found).join(found.groupBy("doc", "th").agg(F.array_sort(F.collect_set("leader")).alias("leaders")), ["doc", "th"])
    own = docs.select("doc_id", F.hash("text").alias("_th"))
    out = own.join(spans, (F.col("doc_id") == F.col("doc")) & (F.col("_th") == F.col("th")), "left")
    n_words = F.coalesce(F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["last"] - x["first"] + 1), F.lit(0))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["first"].cast("string"), x["last"].cast("string"))), ",")
    return out.select(
        "doc_id",
        F.greatest(F.coalesce(F.size("spans"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_passages"),
        n_words.cast("bigint").alias("n_words"),
        F.coalesce("leaders", F.array().cast("array<bigint>")).alias("sources"),
        F.coalesce(text, F.lit("")).alias("spans"),
    )
