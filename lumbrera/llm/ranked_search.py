"""Ranked lexical search over a clustered index of reordered documents.

Building: a tree of recursive graph bisections is fitted on at most about FIT_DOCS documents (of at most FIT_BYTES each); it only decides where
documents stand, never what is found. Every document is sent down the tree by its terms. The leaves, in order, are cut into blocks of about
BLOCK_TERMS postings, whatever the leaves' sizes, so copies that fill a leaf are spread over blocks. In its block a document is placed by a bisection of the
block's own documents, and each run of CLUSTER of them is one row of the index: its terms with document counts and greatest contributions, its
postings, and the documents' ids and lengths. Terms are kept as they are, not as hashes.

Searching: items are taken in batches of bounded size. One pass over the term columns counts df; one more sums, for each item and cluster, the
greatest contributions of the item's terms: no document of the cluster can score more. Clusters are then visited in falling order of that
bound, some at first and eight times as many in each further round, and an item stops when its next bound is below the score of its k-th best
document so far: what is left cannot enter the list, not even by its doc_id. Scores are sums of integers below 2**53, so products of dense
matrices in doubles give them exactly; longer items are summed in 64-bit integers.

Terms are maximal runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Null and empty texts have none: such documents are not counted
in N and never found, such items have no rows. Repeated rows of either table are documents or items of their own. Equal scores are ranked by ascending
doc_id, null last. Only ids and texts are read. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumbrera.llm import bisection
from lumbrera.llm.common import bounded_batches, chunks, cut, discard, ragged, strings
from lumbrera.llm.sketch import FOLD

#: Documents, and bytes of each, that the tree is fitted on; its depth and the least documents of a leaf.
FIT_DOCS, FIT_BYTES, DEPTH, LEAF_DOCS = 4096, 1 << 16, 6, 32
#: Postings of a block, documents of a cluster, and partitions that blocks are dealt into at most.
BLOCK_TERMS, CLUSTER, PARTS = 800_000, 256, 20_000
#: Items, and their distinct terms together, that are searched at a time (an item of more terms alone).
BATCH_ITEMS, BATCH_TERMS = 256, 200_000
#: Clusters that an item visits first, how many times as many in each further round, and visits of a round at most.
FIRST, FURTHER, VISITS = 4, 8, 1_000_000

COUNTED = "doc_id bigint, n bigint, leaf int, n_terms bigint, terms binary, tf binary"
ROWS = "cluster bigint, terms binary, df binary, top binary, place binary, tf binary, ids array<bigint>, n binary"


class Index(NamedTuple):
    """A row a cluster; documents with a term, and all their terms."""

    rows: DataFrame
    n_docs: int
    n_words: int


def counts(text: bytes) -> Counter[bytes]:
    return Counter(text.translate(FOLD).split())


def length_part(n: np.ndarray, index_docs: int, index_words: int) -> np.ndarray:
    """m of documents of n terms."""
    if len(n) and 25 * int(n.max()) * index_docs >= 2**63:
        return np.array([75 + 25 * x * index_docs // index_words for x in n.tolist()], np.int64)
    return 75 + 25 * n * index_docs // index_words


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def fitted(docs: DataFrame, depth: int = DEPTH) -> tuple[pa.Array, np.ndarray]:
    """The tree's terms and nodes, from a sample of the documents."""
    n = docs.count()
    small = docs.where(F.octet_length("text") <= FIT_BYTES)
    sample = small.sample(min(1.0, 1.2 * FIT_DOCS / max(n, 1)), seed=1).select(F.col("text").cast("binary").alias("text")).limit(2 * FIT_DOCS)
    found = [c for c in (counts(r[0]) for r in sample.toLocalIterator()) if c]
    df = Counter(chain.from_iterable(found))
    number = {t: k for k, t in enumerate(t for t, d in df.items() if 1 < d <= len(found) // 2)}
    found = [own for own in ([number[t] for t in c if t in number] for c in found) if own]
    depth = max(0, min(depth, (len(found) // LEAF_DOCS).bit_length() - 1))
    lengths = np.array([len(own) for own in found], np.int64)
    sample_docs = bisection.Docs(np.cumsum(lengths) - lengths, lengths, np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum())))
    return pa.array(list(number), pa.binary()), bisection.tree(sample_docs, len(number), depth)


def counted(docs: DataFrame, fit: tuple[pa.Array, np.ndarray]) -> DataFrame:
    """Each document with a term: its length, its leaf, its distinct terms and how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(fit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, nodes = shared.value
        for whole in batches:
            for b in chunks(whole, 1):
                each = [counts(t) for t in strings(b.column(1)).cast(pa.binary()).to_pylist()]
                lengths = np.array([len(c) for c in each], np.int64)
                flat = pa.array(chain.from_iterable(each), pa.binary(), size=int(lengths.sum()))
                codes = pc.fill_null(pc.index_in(flat, known), len(known)).to_numpy().astype(np.int64)
                leaf = bisection.leaves(nodes, lengths, codes)
                n = [c.total() for c in each]
                tf = [np.fromiter(c.values(), np.int64, len(c)).astype("<u4").tobytes() for c in each]
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(leaf, pa.int32()), pa.array(lengths), pa.array([b" ".join(c) for c in each], pa.binary()), pa.array(tf, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "leaf", "n_terms", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, COUNTED).where("n > 0")


def clusters(block: pa.Table, n_docs: int, n_words: int) -> pa.RecordBatch:
    """The index rows of one block, without their numbers."""
    flat = pa.array(b" ".join(block["terms"].to_pylist()).split(b" "), pa.binary()).dictionary_encode()
    codes, n_codes = flat.indices.to_numpy().astype(np.int64), len(flat.dictionary)
    lengths = block["n_terms"].to_numpy()
    tf = np.frombuffer(b"".join(block["tf"].to_pylist()), "<u4").astype(np.int64)
    n = block["n"].to_numpy()
    owner = np.repeat(np.arange(len(n)), lengths)
    # Terms of one document, or of most, say nothing about where documents belong.
    df = np.bincount(codes, minlength=n_codes)
    telling = ((df > 1) & (df <= len(n) // 2))[codes]
    some, few = np.unique(owner[telling], return_counts=True)
    placed = bisection.order(bisection.Docs(np.cumsum(few) - few, few, codes[telling]), n_codes, CLUSTER)
    order = np.r_[some[placed], np.setdiff1d(np.arange(len(n)), some)].astype(np.int64)
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    # Postings by cluster, term and place.
    place = rank[owner]
    by = np.lexsort((place, codes, place // CLUSTER))
    place, codes, tf = place[by], codes[by], tf[by]
    part = contribution(tf, length_part(n, n_docs, n_words)[order[place]])
    head = np.flatnonzero(np.r_[True, (np.diff(place // CLUSTER) != 0) | (np.diff(codes) != 0)])
    top, run = np.maximum.reduceat(part, head), np.diff(np.r_[head, len(codes)])
    words, of = flat.dictionary.take(pa.array(codes[head])).to_pylist(), place[head] // CLUSTER
    ids = block["doc_id"].combine_chunks().take(pa.array(order))
    out = []
    for k in range(-(-len(n) // CLUSTER)):
        a, b = np.searchsorted(of, [k, k + 1])
        lo, hi = head[a], head[b] if b < len(head) else len(codes)
        own = slice(k * CLUSTER, min(len(n), (k + 1) * CLUSTER))
        out.append((b" ".join(words[a:b]), run[a:b].astype("<u4").tobytes(), top[a:b].astype("<u4").tobytes(), (place[lo:hi] - k * CLUSTER).astype("<u2").tobytes(), tf[lo:hi].astype("<u4").tobytes(), ids[own].to_pylist(), n[order[own]].astype("<i8").tobytes()))
    kinds = [*[pa.binary()] * 5, pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["terms", "df", "top", "place", "tf", "ids", "n"])


def build(docs: DataFrame) -> Index:
    """The index of all documents."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    seen = cut(counted(docs, fitted(docs)))
    # A row a leaf.
    sizes = sorted((r["leaf"], r["docs"], r["words"], r["terms"]) for r in seen.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.sum("n_terms").alias("terms")).collect())
    n_docs, n_words, n_terms = (sum(s[k] for s in sizes) for k in (1, 2, 3))
    blocks = max(1, -(-n_terms // BLOCK_TERMS))
    begins, before = {}, 0
    for leaf, _, _, terms in sizes:
        begins[leaf] = (before / max(n_terms, 1) * blocks, terms / max(n_terms, 1) * blocks)
        before += terms
    parts = min(blocks, PARTS)
    if sizes:
        spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / float(1 << 20)
        at = F.create_map(*chain.from_iterable((F.lit(leaf), F.array(F.lit(a), F.lit(s))) for leaf, (a, s) in begins.items()))[F.col("leaf")]
        block = F.least(F.floor(at[0] + spread * at[1]), F.lit(blocks - 1))
        seen_blocks = seen.select(block.alias("block"), "doc_id", "n", "n_terms", "terms", "tf")
    else:
        seen_blocks = seen.select(F.lit(0).cast("bigint").alias("block"), "doc_id", "n", "n_terms", "terms", "tf")
    dealt = seen_blocks.repartitionById(parts, (F.col("block") * parts / blocks).cast("int")).sortWithinPartitions("block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def closed() -> Iterator[pa.RecordBatch]:
            rows = clusters(pa.Table.from_batches(held), n_docs, n_words)
            number = (at << 24) + np.arange(rows.num_rows)
            for k in range(rows.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(number[k : k + 1]), *[c.slice(k, 1) for c in rows.columns]], ["cluster", *rows.schema.names])

        for b in batches:
            own = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(own)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(own)], strict=True):
                if lo == hi:
                    continue
                if held and own[lo] != at:
                    yield from closed()
                    held.clear()
                at = int(own[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from closed()

    rows = cut(dealt.mapInArrow(work, ROWS))
    discard(seen)
    return Index(rows, n_docs, n_words)


class Batch(NamedTuple):
    """Items in hand: their weights by term (``starts`` and ``ends`` of each known term), and whether sums in doubles are exact."""

    known: pa.Array
    starts: np.ndarray
    lengths: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    exact: bool


def batches_of(items: DataFrame) -> Iterator[list[tuple[Row, Counter[bytes]]]]:
    """Items with a term, as many at a time as the limits allow."""
    held: list[tuple[Row, Counter[bytes]]] = []
    size = 0
    for r in items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).toLocalIterator():
        c = counts(r["text"] or b"")
        if not c:
            continue
        if held and (len(held) == BATCH_ITEMS or size + len(c) > BATCH_TERMS):
            yield held
            held, size = [], 0
        held.append((r, c))
        size += len(c)
    if held:
        yield held


def document_counts(index: Index, known: pa.Array) -> np.ndarray:
    """df of the known terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for terms, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code = pc.fill_null(pc.index_in(pa.array(terms.split(b" "), pa.binary()), known), -1).to_numpy()
                total[code[code >= 0]] += np.frombuffer(df, "<u4")[code >= 0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "df"])

    out = np.zeros(len(known), np.int64)
    for r in index.rows.select("terms", "df").mapInArrow(work, "code bigint, df bigint").groupBy("code").agg(F.sum("df").alias("df")).collect():
        out[r["code"]] = r["df"]
    return out


def weighed(index: Index, own: list[Counter[bytes]]) -> Batch:
    """Weights of the items' terms that some document has."""
    number = {t: k for k, t in enumerate(dict.fromkeys(chain.from_iterable(own)))}
    df = document_counts(index, pa.array(list(number), pa.binary()))
    w = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    code = np.fromiter((number[t] for c in own for t in c), np.int64)
    item = np.repeat(np.arange(len(own)), [len(c) for c in own])
    weight = w[code] * np.fromiter((q for c in own for q in c.values()), np.int64)
    live = weight > 0
    code, item, weight = code[live], item[live], weight[live]
    by = np.argsort(code, kind="stable")
    some, starts, lengths = np.unique(code[by], return_index=True, return_counts=True)
    most = np.bincount(item, weight.astype(float), minlength=len(own)).max(initial=0) * 1e6
    return Batch(pa.array(list(number), pa.binary()).take(pa.array(some)), starts, lengths, item[by], weight[by], most < 2.0**52)


def item_entries(b: Batch, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the known terms in hand: place in ``codes``, item and weight of each use."""
    at = ragged(b.starts[codes], b.lengths[codes])
    return np.repeat(np.arange(len(codes)), b.lengths[codes]), b.item[at], b.weight[at]


def cluster_bounds(index: Index, batch: Batch, n_items: int) -> DataFrame:
    """(item, cluster, bound) where the bound is above 0."""
    shared = index.rows.sparkSession.sparkContext.broadcast(batch)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            for cluster, terms, top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code = pc.fill_null(pc.index_in(pa.array(terms.split(b" "), pa.binary()), q.known), -1).to_numpy()
                at, item, weight = item_entries(q, code[code >= 0])
                most = np.frombuffer(top, "<u4")[code >= 0].astype(np.int64)
                bound = np.zeros(n_items, np.int64)
                np.add.at(bound, item, weight * most[at])
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), cluster)), pa.array(bound[some])], ["item", "cluster", "bound"])

    return index.rows.select("cluster", "terms", "top").mapInArrow(work, "item int, cluster bigint, bound bigint")


def visited(index: Index, batch: Batch, visits: DataFrame, least: dict[int, int], k: int) -> DataFrame:
    """(item, doc_id, score): of each visit the k best documents that reach the item's least score."""
    shared = index.rows.sparkSession.sparkContext.broadcast((batch, least))
    n_docs, n_words = index.n_docs, index.n_words
    # At most VISITS rows.
    asked = F.broadcast(visits.groupBy("cluster").agg(F.collect_list("item").alias("items")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = shared.value
        kind = np.float64 if q.exact else np.int64
        for b in batches:
            for terms, df, place, tf, ids, n, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code = pc.fill_null(pc.index_in(pa.array(terms.split(b" "), pa.binary()), q.known), -1).to_numpy()
                row = {i: r for r, i in enumerate(items)}
                rows = np.full(max(items) + 1, -1)
                rows[list(row)] = list(row.values())
                own = np.flatnonzero(code >= 0)
                run = np.frombuffer(df, "<u4").astype(np.int64)
                at = ragged((np.cumsum(run) - run)[own], run[own])
                m = length_part(np.frombuffer(n, "<i8"), n_docs, n_words)
                spot = np.frombuffer(place, "<u2")[at].astype(np.int64)
                part = np.zeros((len(own), len(m)), kind)
                part[np.repeat(np.arange(len(own)), run[own]), spot] = contribution(np.frombuffer(tf, "<u4")[at].astype(np.int64), m[spot])
                use, item, weight = item_entries(q, code[own])
                asks = (item <= max(items)) & (rows[np.minimum(item, max(items))] >= 0)
                wanted = np.zeros((len(items), len(own)), kind)
                wanted[rows[item[asks]], use[asks]] = weight[asks]
                score = (wanted @ part).astype(np.int64)
                reach = np.array([floor.get(i, 1) for i in items])
                who, doc = np.nonzero(score >= reach[:, None])
                worth = score[who, doc]
                key = np.array([2**63 - 1 if x is None else x for x in ids], np.int64)[doc]
                by = np.lexsort((key, -worth, who))
                who, doc, worth = who[by], doc[by], worth[by]
                begins = np.flatnonzero(np.r_[True, np.diff(who) != 0]) if len(who) else np.zeros(0, np.int64)
                nth = np.arange(len(who)) - np.repeat(begins, np.diff(np.r_[begins, len(who)]))
                keep = nth < k
                names = pa.array(ids, pa.int64()).take(pa.array(doc[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(items, np.int32)[who[keep]]), names, pa.array(worth[keep])], ["item", "doc_id", "score"])

    return index.rows.join(asked, "cluster").select("terms", "df", "place", "tf", "ids", "n", "items").mapInArrow(work, "item int, doc_id bigint, score bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with their rank; each task keeps k of an item before rows are shuffled."""
    by = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search_batch(index: Index, own: list[Counter[bytes]], k: int) -> tuple[DataFrame, int]:
    """(item, doc_id, score, rank) of the items in hand, and how many clusters were visited for them."""
    spark = index.rows.sparkSession
    batch = weighed(index, own)
    bounds = cut(cluster_bounds(index, batch, len(own)))
    least: dict[int, int] = {}
    cursor: dict[int, tuple[int, int]] = {}
    tops, budget, total = None, FIRST, 0
    by = W.partitionBy("item").orderBy(F.desc("bound"), "cluster")
    while True:
        # A row an item: where it stands and what it needs.
        state = spark.createDataFrame([(i, least.get(i, 1), *cursor.get(i, (2**63 - 1, -1))) for i in range(len(own))], "item int, least bigint, last_bound bigint, last_cluster bigint")
        left = bounds.join(F.broadcast(state), "item").where("bound >= least AND (bound < last_bound OR bound = last_bound AND cluster > last_cluster)")
        visits = cut(left.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= min(budget, VISITS // len(own))).select("item", "cluster", "bound"))
        ends = visits.groupBy("item").agg(F.max(F.struct(-F.col("bound"), "cluster")).alias("end"), F.count("*").alias("n")).collect()
        if not ends:
            break
        total += sum(r["n"] for r in ends)
        cursor |= {r["item"]: (-r["end"][0], r["end"][1]) for r in ends}
        found = visited(index, batch, visits, least, k)
        after = cut(best(found if tops is None else found.unionByName(tops.select("item", "doc_id", "score")), k))
        least = {r["item"]: r["score"] for r in after.where(F.col("rank") == k).collect()}
        for done in [visits, *([tops] if tops is not None else [])]:
            discard(done)
        tops, budget = after, budget * FURTHER
    discard(visits)
    discard(bounds)
    empty = spark.createDataFrame([], "item int, doc_id bigint, score bigint, rank int")
    return (tops if tops is not None else empty), total


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    spark = index.rows.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for held in batches_of(items):
        found, _ = search_batch(index, [c for _, c in held], k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, (r, _) in enumerate(held)], f"item int, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build(docs), items)
