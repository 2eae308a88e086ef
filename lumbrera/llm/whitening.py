"""Whitening of embeddings from exact covariances: digit-slice GEMM.

1. An entry c becomes the integer x = floor(64 * c) + 1000000 (kept within +-2**62). The fit list is each distinct vector x once.
2. n and the sums S of the fit list are exact. The centred integers t = n * x - S are split into signed limbs of LIMB bits. A product of two limb
   matrices over at most ROWS rows stays below 2**53, so the BLAS product in doubles is exact whatever its order; limb products are
   recombined as big integers, and tasks' sums merged as digits in decimal columns. sum(t * t') / n**3 is then the covariance, each
   entry rounded once.
3. Eigenvectors of that matrix (as large as the dimension squared, on the driver); the sign is that which makes an entry of the largest size positive.
4. Each row is projected; the covariance of what comes out is measured over the fit list.

Rows whose vector is null, or holds null or not finite entries, are left out. Shorter vectors are filled up with entries of 0 to the length
of the longest. Repeated rows and rows without a vec_id are rows of their own. A component without variance (also all of a fit list of one)
has a null ``whitened`` and ``explained`` of 0, and is not part of ``identity_error``, which is 0 if there is no other. ``deviation`` is null where it is no
64-bit number. Only two columns are read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.common import bounded_batches, cut

SCALE, SHIFT, REACH = 64, 1_000_000, 1 << 62
#: ROWS * 2 ** (2 * (LIMB - 1)) <= 2 ** 53.
LIMB, ROWS = 20, 1 << 13
#: Bits of a digit of the merged sums.
DIGIT = 60
COMPONENTS = 16


class Sums(NamedTuple):
    """Of the fit list: how many vectors, and their sums by dimension."""

    n: int
    total: list[int]


class Model(NamedTuple):
    sums: Sums
    #: Eigenvalues, falling, and unit eigenvectors as columns; shares of the trace.
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def integers(vector: Column) -> Column:
    """x of each entry."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(REACH))), F.lit(float(REACH)))) + SHIFT)


def usable(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.cast(pa.large_list(pa.int64())).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def centred(x: np.ndarray, s: Sums) -> np.ndarray:
    """n * x - S, as 64-bit numbers where they fit and as big integers otherwise."""
    far = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * s.n + max(map(abs, s.total), default=0)
    if far < REACH:
        return x * s.n - np.array(s.total, np.int64)
    return x.astype(object) * s.n - np.array(s.total, object)


def limbs(t: np.ndarray) -> list[np.ndarray]:
    """Signed limbs, the lowest first, as doubles: t = sum(limb[k] << (LIMB * k))."""
    out, half = [], 1 << (LIMB - 1)
    while True:
        low = ((t + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        t = (t - low) >> LIMB
        if not np.any(t):
            return out


def gram(t: np.ndarray) -> np.ndarray:
    """t' * t exactly, as big integers, for at most ROWS rows."""
    parts = limbs(t)
    total = np.zeros((t.shape[1], t.shape[1]), object)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            one = (a.T @ parts[j]).astype(np.int64)
            both = one if i == j else one + one.T
            total += both.astype(object) << (LIMB * (i + j))
    return total


def digits(values: np.ndarray) -> list[list[int]]:
    """Signed digits of DIGIT bits, three for each big integer; the highest takes what is left."""
    low, rest = values & ((1 << DIGIT) - 1), values >> DIGIT
    return [low.tolist(), (rest & ((1 << DIGIT) - 1)).tolist(), (rest >> DIGIT).tolist()]


def merged(found: DataFrame) -> dict[int, int]:
    """Sums by place of the digits of all tasks: one row for each place comes to the driver."""
    rows = found.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("low", "mid", "high")]).collect()
    return {r["place"]: int(r["low"]) + (int(r["mid"]) << DIGIT) + (int(r["high"]) << (2 * DIGIT)) for r in rows}


def digit_batch(values: np.ndarray) -> pa.RecordBatch:
    kind = pa.decimal128(38, 0)
    low, mid, high = digits(values)
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), *[pa.array(d, kind) for d in (low, mid, high)]], ["place", "low", "mid", "high"])


PLACED = "place bigint, low decimal(38,0), mid decimal(38,0), high decimal(38,0)"


def sums(fit: DataFrame, width: int) -> Sums:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, object)
        for b in batches:
            x = matrix(b.column(0), width)
            total[0] += len(x)
            # Halves, so that no 64-bit sum overflows.
            total[1:] += ((x >> 31).sum(axis=0).astype(object) << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
        yield digit_batch(total)

    found = merged(fit.mapInArrow(work, PLACED))
    return Sums(found.get(0, 0), [found.get(k + 1, 0) for k in range(width)])


def covariance(fit: DataFrame, s: Sums) -> np.ndarray:
    """sum(t * t') / n**3 of the fit list, each entry rounded once."""
    width = len(s.total)
    upper = np.triu_indices(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for b in batches:
            x = matrix(b.column(0), width)
            for at in range(0, len(x), ROWS):
                total += gram(centred(x[at : at + ROWS], s))
        yield digit_batch(total[upper])

    found = merged(fit.mapInArrow(work, PLACED))
    v = np.zeros((width, width))
    for k, (i, j) in enumerate(zip(*upper, strict=True)):
        v[i, j] = v[j, i] = found.get(k, 0) / s.n**3  # integers: one rounding
    return v


def fit_model(fit: DataFrame, width: int, most: int = COMPONENTS) -> Model:
    """The components of distinct vectors x."""
    s = sums(fit, width)
    v = covariance(fit, s)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    live = values > width * np.finfo(float).eps * max(trace, 0.0)
    values = np.where(live, values, 0.0)
    return Model(s, values, vectors, values / trace if trace > 0 else np.zeros(len(values)))


def projected(t: np.ndarray, m: Model) -> np.ndarray:
    """Whitened values; not a number where a component has no variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = ((t / m.sums.n).astype(np.float64) @ m.vectors) / np.sqrt(m.values)
    out[:, m.values == 0] = np.nan
    return out


def identity_error(fit: DataFrame, m: Model) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|, by partial means and centred products, which are then moved to the common mean."""
    live = int((m.values > 0).sum())
    if not live:
        return 0.0
    width = len(m.sums.total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(live), np.zeros((live, live))
        for b in batches:
            w = projected(centred(matrix(b.column(0), width), m.sums), m)[:, :live]
            if not len(w):
                continue
            own = w.mean(axis=0)
            gap, k = own - mean, len(w)
            products += (w - own).T @ (w - own) + np.outer(gap, gap) * (n * k / (n + k))
            mean, n = mean + gap * (k / (n + k)), n + k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "products"])

    parts = cut(fit.mapInArrow(work, "n bigint, mean array<double>, products array<double>").where("n > 0"))
    # Means first, then each task's products moved to the common mean.
    whole = [F.sum(F.col("n") * F.get("mean", F.lit(i))).alias(f"m{i}") for i in range(live)]
    mean = [x / m.sums.n for x in parts.agg(*whole).first()]
    moved = [F.get("products", F.lit(i * live + j)) + F.col("n") * (F.get("mean", F.lit(i)) - mean[i]) * (F.get("mean", F.lit(j)) - mean[j]) for i in range(live) for j in range(i, live)]
    cov = parts.agg(*[F.sum(c).alias(f"c{k}") for k, c in enumerate(moved)]).first()
    want = [float(i == j) for i in range(live) for j in range(i, live)]
    return max(abs(c / m.sums.n - one) for c, one in zip(cov, want, strict=True))


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that remain, all x of one length, and that length."""
    left = rows.where(usable(F.col(vector_col)))
    width = left.agg(F.max(F.size(vector_col))).first()[0] or 0
    x = integers(F.col(vector_col))
    x = F.concat(x, F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(width) - F.size(vector_col)))
    return left.select(F.col(id_col).alias("vec_id"), x.alias("x")), width


def whiten(rows: DataFrame, m: Model, error: float) -> DataFrame:
    """A row for each of ``prepared`` and each component."""
    bounded_batches(rows.sparkSession)
    width, k = len(m.sums.total), len(m.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = centred(matrix(b.column(1), width), m.sums)
            w = projected(t, m)
            big = t.dtype == object or (width and width * float(np.abs(t).max(initial=0)) ** 2 >= 2.0**62)
            far = (t.astype(object) ** 2).sum(axis=1).tolist() if big else (t * t).sum(axis=1).tolist()
            far = [x if x < 2**63 else None for x in far]
            every = np.repeat(np.arange(b.num_rows), k)
            cols = [b.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(len(every), m.sums.n, np.int64)), pa.array(far, pa.int64()).take(pa.array(every)),
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(m.explained, b.num_rows)), pa.array(np.full(len(every), error))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def digest(rows: DataFrame) -> DataFrame:
    """Each remaining vector's whitened components, with n, deviation, explained and identity_error."""
    bounded_batches(rows.sparkSession)
    ready, width = prepared(rows)
    if not width:  # no row, or none with an entry
        return whiten(ready.where(F.lit(False)), Model(Sums(0, []), *[np.zeros((0, 0))] * 3), 0.0)
    fit = cut(ready.select("x").distinct())
    m = fit_model(fit, width)
    return whiten(ready, m, identity_error(fit, m))
