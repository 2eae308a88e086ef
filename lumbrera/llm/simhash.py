"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is embedded as the number of set bits in each of its 32 two-bit segments. The Manhattan distance of two such vectors never
exceeds the Hamming distance, so fingerprints within 3 bits lie within Manhattan distance 3. The coordinates are dealt into 6
blocks; two vectors within distance 3 agree on 3 blocks at least, so each vector is put into a grid cell for every choice of 3 blocks and pairs
are looked for within cells: first by Manhattan distance, then exactly by Hamming distance. Equal fingerprints count once. Cells of more than
``CELL`` members are dealt into pairs of sub-cells, so that no task holds a whole large cell. A cell yields a spanning forest of its
links, never all pairs; their connected components are those of all links.

Null or empty texts have the fingerprint zero and are linked like any other. Repeated rows share a fingerprint, so they fall into
one component. A null doc_id gets a fingerprint and the component of its equals; it never names a component. An empty table gives an empty one.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.common import bounded_batches, chunks, cut, strings, unused
from lumbrera.llm.components import components

MAX_BITS = 3
SHINGLE = 3
CELL = 2048
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str) -> int:
    """Bit k is set if it is set in over half of the XXH64 (seed 42) of the 3-word shingles."""
    ws = text.encode().translate(LOWER).split()  # bytes split at \x20 and \x09-\x0D
    if not ws:
        return 0
    data = b" ".join(ws)
    if len(ws) <= SHINGLE:
        return xxhash.xxh64_intdigest(data, 42)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], 42) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a signed 64-bit integer."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 1):
                fp = np.array([fingerprint(t) for t in strings(b.column(1)).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def embedding(fp: F.Column) -> F.Column:
    """The 32 segment popcounts, two bits each."""
    low, shifted = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def masks() -> list[int]:
    """For each choice of 3 of the 6 blocks, the bits of their coordinates, signed."""
    bound = [0, 6, 12, 17, 22, 27, 32]
    block = [((1 << 2 * b) - (1 << 2 * a)) for a, b in zip(bound, bound[1:], strict=False)]
    both = [sum(block[i] for i in c) for c in combinations(range(6), 3)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def links(points: DataFrame) -> DataFrame:
    """(u, v): a spanning forest, per cell, of the pairs of distinct fingerprints ``fp`` within MAX_BITS; ids are ``rep``."""
    c = embedding(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(k).alias("choice"), c.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks())])
    rows = points.select("rep", "fp", F.explode(cells).alias("at")).select("at.choice", "at.cell", "rep", "fp")
    size = rows.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(size, ["choice", "cell"]).withColumn("parts", F.ceil(F.col("n") / CELL).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # A member meets every other part once: pair (i, j) of parts with i <= j.
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j")))
    rows = rows.withColumn("part", part).withColumn("pair", F.explode(pairs))
    keys = ["choice", "cell", "pair"]
    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).select(F.xxhash64(*keys).alias("key"), "rep", "fp")
    return dealt.mapInArrow(forest, "u bigint, v bigint").distinct()


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come cell after cell; a cell has some thousands of rows at most."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush(part: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, rep, fp = (np.concatenate(x) for x in zip(*part, strict=True))
        a, b = within(key, fp)
        keep = spanning(key[a], a, b)
        return pa.RecordBatch.from_arrays([pa.array(rep[a][keep]), pa.array(rep[b][keep])], ["u", "v"])

    for batch in batches:
        cols = tuple(batch.column(i).to_numpy() for i in range(3))
        if not len(cols[0]):
            continue
        edge = np.flatnonzero(np.r_[True, np.diff(cols[0]) != 0])
        last = int(edge[-1])  # the batch's last cell may go on
        if last or (held and held[-1][0][-1] != cols[0][0]):
            if held and held[-1][0][-1] != cols[0][0] and not last:
                yield flush(held)
                held = []
            else:
                yield flush([*held, tuple(c[:last] for c in cols)])
                held, cols = [], tuple(c[last:] for c in cols)
        held.append(cols)
    if held:
        yield flush(held)


def within(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of one cell each within Manhattan and then Hamming distance MAX_BITS."""
    five = np.uint64(0x5555555555555555)
    bits = fp.view(np.uint64)
    c = bits - ((bits >> np.uint64(1)) & five)
    out_a, out_b = [], []
    n, d = len(key), 1
    live = np.arange(n - 1)
    while len(live):
        live = live[live + d < n]
        live = live[key[live] == key[live + d]]
        a, b = live, live + d
        # Per segment the difference is one bit of the xor's parity, or two where the counts are 0 and 2.
        x = c[a] ^ c[b]
        l1 = np.bitwise_count(x & five).astype(np.int64) + 2 * np.bitwise_count((x >> np.uint64(1)) & five & ~x).astype(np.int64)
        near = l1 <= MAX_BITS
        a, b = a[near], b[near]
        near = np.bitwise_count(bits[a] ^ bits[b]) <= MAX_BITS
        out_a.append(a[near])
        out_b.append(b[near])
        d += 1
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def spanning(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs, taken in turn, join two trees."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            root[y] = x
            keep[k] = True
    return keep


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable over links."""
    fps = cut(fingerprints(docs, id_col, text_col))
    points = cut(fps.groupBy("fp").agg(F.min(id_col).cast("bigint").alias("rep")))
    found = cut(components(links(points.where("rep IS NOT NULL"))))
    root = points.join(found, points["rep"] == found["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(root, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each component keeps the smallest doc_id. Rows that repeat a doc_id stay or go together; rows without a doc_id stay."""
    found = near_duplicates(docs, id_col, text_col)
    name = unused(docs, "_gone")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
