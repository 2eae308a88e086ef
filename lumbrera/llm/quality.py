"""Document quality: random Fourier features of document statistics, ridge scores and isotonic calibration.

Statistics of a text (shares of character classes, word and line shape, repetition) are standardised, mapped to random Fourier features
that approximate a Gaussian kernel, and fitted by ridge regression: partitions sum their normal equations, which the driver adds
up and solves. Raw scores of a part of the labelled rows that the ridge has not seen are calibrated by isotonic regression.

Labelled rows are those with a label whose crc32(doc_id as text) mod 5 is not 0; of them, rows with 4 calibrate and the others fit. If
there are more than ``FIT_ROWS`` of them, a fixed hash of doc_id picks about that many: the documented bound of the training sample.
Inputs of a score are statistics of the text alone.

Null texts count as empty; empty texts get the score of their (all zero) statistics. Null labels and null doc_ids never train; a null
doc_id is not held out and is scored. Repeated rows are scored alike; if a doc_id has several labels its lowest is used, and if it has
several texts the smallest statistics of them. With
no labelled rows, or one class only, every score is that class's share (1 if there is none). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.common import bounded_batches, chunks, cut, strings

FIT_ROWS = 60_000
FEATURES = 384
RIDGE = 1e-4
GAMMA = 0.03
BINS = 2048
THRESHOLD = 0.3
SEED = 20240601

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 full stop or comma, 6 other punctuation, 7 non-ASCII.
CLASS = np.array([4 if b == 10 else 3 if b in (32, 9, 13) else 2 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 0 if 97 <= b <= 122 else 7 if b > 127 else 5 if b in (44, 46) else 6 for b in range(256)], np.uint8)
NAMES = ["log_bytes", "lower", "upper", "digit", "space", "line_feed", "stop", "punct", "non_ascii", "word_len", "word_len_sd", "types", "top_word", "bigram_types", "log_lines", "line_repeat", "line_len_sd", "short_lines", "punct_kinds", "log_words", "caps_words", "marked_words", "rare_shape", "entropy"]


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    data = np.frombuffer(raw, np.uint8)
    full = np.bincount(data, minlength=256)
    share = np.bincount(CLASS, weights=full, minlength=8) / n
    ws = raw.split()
    k = max(1, len(ws))
    sizes = np.fromiter(map(len, ws), np.float64, len(ws)) if ws else np.zeros(1)
    types = set(ws)
    counts: dict[bytes, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    m = max(1, len(lines))
    lens = np.fromiter(map(len, lines), np.float64, len(lines)) if lines else np.zeros(1)
    p = full[full > 0] / n
    return [
        np.log1p(n), *share.tolist(), sizes.mean(), sizes.std(), len(types) / k, max(counts.values(), default=0) / k, len(set(zip(ws, ws[1:], strict=False))) / k,
        np.log1p(len(lines)), 1 - len(set(lines)) / m, lens.std() / (1 + lens.mean()), float((lens < 40).mean()), float((full[33:48] > 0).sum() + (full[58:65] > 0).sum()), np.log1p(len(ws)),
        sum(map(bytes.isupper, ws)) / k, sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".," for w in ws) / k, float((sizes > 20).mean()), float(-(p * np.log2(p)).sum()),
    ]


def stats_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the array of statistics."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 1):
                x = [statistics(t) for t in strings(b.column(1)).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], [id_col, "x"])

    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, x array<double>")


class Model:
    """Standardisation, random features, weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), FEATURES)) * np.sqrt(2 * GAMMA)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + len(mean) + 1)
        self.at, self.to = np.array([0.0, 1.0]), np.array([1.0, 1.0])

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random features, the statistics themselves and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the score keeps the order of rows that calibration levels."""
        r = self.raw(x)
        return np.clip(0.999 * np.interp(r, self.at, self.to) + 0.001 / (1 + np.exp(-4 * np.clip(r, -20, 20))), 0, 1)


def isotonic(value: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending bins; the blocks' mean values and levels."""
    blocks: list[list[float]] = []
    for v, g, t in zip(value, good, total, strict=True):
        blocks.append([v * t, g, t])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            v, g, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + g, blocks[-1][2] + t]
    x = np.array([b[0] / b[2] for b in blocks])
    return x, np.array([b[1] / b[2] for b in blocks])


def rest(id_col: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (rest() != 0)).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * fit_rows / n)))
    # At most about FIT_ROWS labels, 16 bytes each, are sent to the executors, so no text is shuffled for training.
    known = F.broadcast(cut(known))
    rows = cut(stats_table(docs.select("doc_id", "text").join(known, "doc_id")).groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id").withColumn("part", rest()))
    train = rows.where("part <> 4")
    size = len(NAMES)
    moments = train.select(F.count("*"), F.avg("y"), *[F.avg(F.col("x")[i]) for i in range(size)], *[F.stddev_pop(F.col("x")[i]) for i in range(size)]).first()
    total, share = moments[0], moments[1]
    if not total:
        return Model(np.zeros(size), np.ones(size))
    mean, sd = np.array(moments[2 : 2 + size]), np.array(moments[2 + size :])
    model = Model(mean, np.where(sd > 1e-9, sd, 1.0))
    model.to = np.array([share, share])
    if share in (0.0, 1.0):
        return model
    d = len(model.beta)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, c = np.zeros((d, d)), np.zeros(d)
        for b in batches:
            for k in range(0, len(b), 2048):
                z = model.features(np.stack(b["x"].iloc[k : k + 2048]))
                a += z.T @ z
                c += z.T @ b["y"].iloc[k : k + 2048].to_numpy()
        yield pd.DataFrame({"a": [a.ravel().tobytes()], "c": [c.tobytes()]})

    # One matrix from each of a few partitions.
    a, c = np.zeros((d, d)), np.zeros(d)
    for r in train.coalesce(6).mapInPandas(sums, "a binary, c binary").toLocalIterator():
        a += np.frombuffer(r["a"]).reshape(d, d)
        c += np.frombuffer(r["c"])
    model.beta = np.linalg.solve(a + RIDGE * total * np.eye(d) / 10, c)

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"r": model.raw(np.stack(b["x"])), "y": b["y"]})

    held = rows.where("part = 4").mapInPandas(raw, "r double, y double")
    grid = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "r")) * (BINS / 3))
    bins = held.groupBy(grid.alias("bin")).agg(F.avg("r").alias("r"), F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()  # BINS + 1 rows at most
    if bins:
        model.at, model.to = isotonic(np.array([b["r"] for b in bins]), np.array([b["good"] for b in bins]), np.array([float(b["n"]) for b in bins]))
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """All columns of the documents, with the score and the prediction under names that the documents may not have yet."""
    if {score_col.lower(), predicted_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {score_col} or {predicted_col}: give other names")
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            x = np.array([statistics(v or "") for v in t], np.float64).reshape(len(t), len(NAMES))
            yield pd.Series(held.value.score(x))

    out = docs.withColumn(score_col, score(F.col(text_col)))
    return out.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", F.coalesce(rest() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
