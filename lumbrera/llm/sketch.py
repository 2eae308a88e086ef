"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every shingle hash below a fixed fraction of the hash range. Sketches of the same fraction can be merged by union, and the
overlap of two estimates the resemblance and the containment of their documents whatever their sizes. A document with
shingles but none below the threshold has an empty sketch, of which nothing is known; its smallest hash is kept beside it, marked by ``~``. It
tells equal documents, and stands for the resemblance of two such (1 if equal, else 0); their containment is unknown (null), as is that
of such a one and a longer one, whose resemblance counts as 0. Merging keeps the smaller of two such hashes, and drops it once there is a sketch, so that the merged
fingerprint is always that of both documents' shingles together.

Words are maximal runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters; a shingle is five of them, fewer words being
one shingle. Null or empty texts, and texts without words, have the empty fingerprint; two empty ones are alike (1), an empty and
another one are not (0). The next document is taken in ascending doc_id order (null first, equal ids by text), the first one
following the last; a lone document is followed by itself. Repeated rows are documents of their own. Empty tables give empty ones.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.common import bounded_batches, chunks, in_order, strings

SHINGLE = 5
#: One shingle hash of so many is kept.
SCALE = 8
#: Hex digits of a hash.
DIGITS = 12
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH3 (64 bits) of the text's shingles, in order."""
    ws = text.encode().translate(FOLD).split()
    if not ws:
        return np.zeros(0, np.uint64)
    data = b" ".join(ws)
    digest = xxhash.xxh3_64_intdigest
    if len(ws) <= size:
        return np.array([digest(data)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.array([digest(data[a:b]) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


class Sketch(NamedTuple):
    """The kept hashes, ascending, as numbers of 4 * DIGITS bits; and the smallest hash of a text that has shingles and none kept."""

    kept: np.ndarray
    least: int | None = None


def sketch(text: str, scale: int = SCALE) -> Sketch:
    h = shingle_hashes(text)
    kept = h[h < np.uint64(2**64 // scale)]
    if len(h) and not len(kept):
        return Sketch(kept, int(h.min()) >> (64 - 4 * DIGITS))
    return Sketch(np.unique(kept >> np.uint64(64 - (scale - 1).bit_length() - 4 * DIGITS)))


def to_text(s: Sketch) -> str:
    if s.least is not None:
        return f"~{s.least:0{DIGITS}x}"
    return s.kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def from_text(s: str) -> Sketch:
    if s.startswith("~"):
        return Sketch(np.zeros(0, np.uint64), int(s[1:], 16))
    raw = np.frombuffer(bytes.fromhex(s), np.uint8).reshape(-1, DIGITS // 2)
    return Sketch(np.pad(raw, ((0, 0), (8 - DIGITS // 2, 0))).reshape(-1).view(">u8").astype(np.uint64))


def merge(a: str, b: str) -> str:
    """The fingerprint of the shingles of two documents together."""
    x, y = from_text(a), from_text(b)
    kept = np.union1d(x.kept, y.kept)
    least = [v for v in (x.least, y.least) if v is not None]
    return to_text(Sketch(kept, min(least) if least and not len(kept) else None))


def overlap(a: Sketch, b: Sketch) -> tuple[float, float | None]:
    """Estimated resemblance, and containment of the smaller in the larger (null where nothing is known of it)."""
    if a.least is not None or b.least is not None:
        if a.least == b.least:
            return 1.0, 1.0
        empty = any(s.least is None and not len(s.kept) for s in (a, b))
        return 0.0, 0.0 if empty else None
    if not len(a.kept) or not len(b.kept):
        return (1.0, 1.0) if len(a.kept) == len(b.kept) else (0.0, 0.0)
    both = len(np.intersect1d(a.kept, b.kept, assume_unique=True))
    return both / (len(a.kept) + len(b.kept) - both), both / min(len(a.kept), len(b.kept))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next document's first, or all of them."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(sketch(t)) for t in strings(b.column(1)).to_pylist()], pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    Documents are dealt into shards by ascending doc_id, one shuffle of the texts; each shard also gets the first document of the
    next one, so that every task finds the next documents by itself.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    dealt, splits = in_order(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("_text")), "doc_id", "_text")
    # One row a shard.
    firsts = sorted((r[0], None if r[2] else r[1]) for r in dealt.groupBy("_shard").agg(F.min("doc_id"), F.max(F.isnull("doc_id"))).collect())
    kind = docs.schema[id_col].dataType.simpleString()
    guests = spark.createDataFrame([(s, first, firsts[k - 1][0]) for k, (s, first) in enumerate(firsts)], f"_own int, _first {kind}, _to int")
    sent = F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.array(F.struct(F.col("_shard"), F.lit(0).alias("_guest")), F.struct(F.col("_to").alias("_shard"), F.lit(1).alias("_guest")))).otherwise(F.array(F.struct(F.col("_shard"), F.lit(0).alias("_guest"))))
    rows = dealt.join(F.broadcast(guests), F.col("_shard") == F.col("_own")).select("doc_id", "_text", F.explode(sent).alias("_at")).select("doc_id", "_text", "_at._shard", "_at._guest")
    rows = rows.repartitionById(max(1, len(splits) - 1), "_shard").sortWithinPartitions("_guest", F.col("doc_id").asc_nulls_first(), "_text").select("doc_id", "_guest", "_text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        over = False
        for whole in batches:
            for b in chunks(whole, 2):
                out = []
                for at, guest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if over:
                        break
                    own = sketch(text)
                    if held is not None:
                        out.append(row(*held, text, own))
                    over = bool(guest)
                    held = (at, text, own)
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = [b.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def row(at: object, text: str, own: Sketch, following: str, after: Sketch) -> tuple:
        new = edited(text, following)
        mark = sketch(new)
        (near, part), (near_next, part_next) = overlap(own, mark), overlap(own, after)
        return at, len(text), hashlib.sha256(new.encode()).hexdigest(), to_text(own), to_text(mark), near, near_next, part, part_next

    return rows.mapInArrow(work, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double")
