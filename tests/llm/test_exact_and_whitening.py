"""Stateful exact deduplication and whitening against brute force."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbrera.llm import exact_dedup, whitening


def stored(spark, rows, schema, path, files=1, mode="append"):
    spark.createDataFrame(rows, schema).repartition(files).write.mode(mode).parquet(path)


def by_hand(rows):
    """doc_id, keep_id and group_size of every row, as sorted tuples."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    first = lambda k: (k is not None, k or 0)
    return sorted(((k, max(ks, key=first), len(ks), hashlib.sha256(t.encode()).hexdigest()) for t, ks in groups.items() for k in ks), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=repr)


ROWS = [(k, f"text {k % 7}" if k % 3 else None) for k in range(40)] + [(40, ""), (41, "x" * 1_000_000), (42, "x" * 1_000_000), (43, "x" * 999_999 + "y"), (None, "text 1"), (None, "no id"), (None, "no id"), (5, "text 5"), (5, "text 5"), (44, "Text 1"), (45, " text 1"), (46, "é"), (47, "é")]


def test_equal_texts(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    stored(spark, ROWS, "doc_id bigint, text string", path, 5)
    out = exact_dedup.digest_documents(spark, path)
    assert got(out) == by_hand(ROWS)
    # One row of each group stays, also where rows share the doc_id or have none.
    assert out.where("kept").count() == len({t or "" for _, t in ROWS})
    assert out.where("kept AND NOT doc_id <=> keep_id").isEmpty()


def test_state_goes_on_over_batches_and_runs(spark, tmp_path):
    path, state = f"file://{tmp_path}/docs", f"file://{tmp_path}/state"
    stored(spark, ROWS[:30], "doc_id bigint, text string", path, 6)
    exact_dedup.advance(spark, path, state, batch_bytes=1)  # a file a batch
    assert exact_dedup.held(spark, state).agg(F.sum("n")).first()[0] == 30
    stored(spark, ROWS[30:], "doc_id bigint, text string", path, 3)
    for _ in range(2):  # the second time there is nothing new
        exact_dedup.advance(spark, path, state, batch_bytes=1)
        held = exact_dedup.held(spark, state)
        assert held.agg(F.sum("n")).first()[0] == len(ROWS) and held.count() == len({t or "" for _, t in ROWS})
    assert sorted(((r["id"], r["keep"], r["n"]) for r in exact_dedup.classes(spark, path, state).collect()), key=repr) == sorted((r[:3] for r in by_hand(ROWS)), key=repr)


@pytest.mark.parametrize("bound", [0, 1000])
def test_bytes_are_compared_where_digests_are_equal(spark, tmp_path, monkeypatch, bound):
    """A digest that texts of one length share."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", bound)
    path, state = f"file://{tmp_path}/docs", f"file://{tmp_path}/state"
    stored(spark, ROWS, "doc_id bigint, text string", path, 4)
    weak = lambda t: F.length(t).cast("string").cast("binary")
    exact_dedup.advance(spark, path, state, digest=weak)
    found = exact_dedup.classes(spark, path, state, digest=weak)
    assert sorted(((r["id"], r["keep"], r["n"]) for r in found.collect()), key=repr) == sorted((r[:3] for r in by_hand(ROWS)), key=repr)
    assert found.where("kept").count() == len({t or "" for _, t in ROWS})


def test_hot_group_and_other_columns(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    df = df.select("*", F.lit(1).alias("digest"), F.lit("x").alias("place"), F.lit(2).alias("_metadata"), F.lit(3).alias("n"), F.lit(4).alias("keep"))
    df.repartition(4).write.parquet(path)
    out = exact_dedup.digest_documents(spark, path)
    assert out.where("group_size = 1000 AND keep_id = 2997").count() == 1000 and out.where("group_size = 1 AND kept").count() == 2000


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    stored(spark, [], "doc_id bigint, text string", path)
    assert exact_dedup.digest_documents(spark, path).collect() == []


VECTORS = "vec_id bigint, embedding array<float>, label int"


def exact(rows):
    """n, S and the covariance of the fit list by fractions, and x of each row that remains."""
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    xs = [(k, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))])) for k, v in kept]
    fit = sorted({x for _, x in xs})
    n, s = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    cov = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3) for j in range(width)] for i in range(width)]
    return xs, n, s, np.array([[float(c) for c in row] for row in cov])


def held_against(spark, rows):
    xs, n, s, cov = exact(rows)
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], VECTORS).repartition(3)
    out = whitening.digest(df).toPandas()
    k = min(16, len(s))
    assert len(out) == len(xs) * k
    values, vectors = (a[..., ::-1][..., :k] for a in np.linalg.eigh(cov))
    values = np.where(values > len(s) * np.finfo(float).eps * np.trace(cov), values, 0)
    far = sorted((key, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))) for key, x in xs)
    first = out[out.component == 1].sort_values(["vec_id", "deviation"])
    assert [(a, b) for a, b in zip(first.vec_id, first.deviation, strict=True)] == far and set(out.n) == {n}
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-4
    live = out[out.component <= (values > 0).sum()]
    assert not live.whitened.isna().any() and out[out.component > (values > 0).sum()].whitened.isna().all()
    for c, part in live.groupby("component"):
        assert np.allclose(part.explained, values[c - 1] / np.trace(cov), rtol=1e-9)
        want = {key: (np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)]) @ vectors[:, c - 1]) / values[c - 1] ** 0.5 for key, x in xs}
        found = dict(zip(part.vec_id, part.whitened, strict=True))
        sign = np.sign(sum(found[key] * want[key] for key in want))
        assert max(abs(found[key] * sign - want[key]) for key in want) < 1e-6
    return out


def test_whitening_equals_fractions(spark):
    r = np.random.default_rng(4)
    mixed = (r.normal(size=(300, 20)) * np.linspace(1, 3, 20)) @ r.normal(size=(20, 20))
    rows = [(k, v.tolist()) for k, v in enumerate(mixed)]
    rows += [(1000 + k, rows[0][1]) for k in range(150)]  # copies count once in the fit list
    rows += [(2000, None), (2001, [*rows[0][1][:-1], None]), (2002, [*rows[0][1][:-1], float("nan")]), (2003, [*rows[0][1][:-1], float("inf")]), (2004, rows[5][1][:7]), (2005, [])]
    held_against(spark, rows)


def test_whitening_of_large_and_far_values(spark):
    r = np.random.default_rng(5)
    held_against(spark, [(k, v.tolist()) for k, v in enumerate(r.normal(size=(80, 5)) * 1e3 + 2e5)])
    # Far from 64 bits: the deviation has no number, the rest stands.
    big = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(r.normal(size=(40, 3)) * 1e25)], VECTORS)
    out = whitening.digest(big).toPandas()
    assert len(out) == 120 and out.deviation.isna().all() and out.whitened.notna().all() and out.identity_error.iloc[0] < 1e-4


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, [0.5, 1.0]), (2, [1.5, 1.0]), (3, [2.5, 1.0])], [(1, None)], [(1, []), (2, [])]])
def test_whitening_of_few_rows(spark, rows):
    out = whitening.digest(spark.createDataFrame([(k, v, 0) for k, v in rows], VECTORS)).collect()
    kept = [v for _, v in rows if v is not None]
    assert len(out) == len(kept) * max(map(len, kept), default=0)
    assert all((r["whitened"] is None) == (r["explained"] == 0) for r in out)


def test_limbs_are_exact():
    r = np.random.default_rng(6)
    for bits in (5, 19, 20, 38, 59):
        t = r.integers(-(1 << bits), 1 << bits, size=(500, 6))
        want = t.astype(object).T @ t.astype(object)
        assert (whitening.gram(t) == want).all() and (whitening.gram(t.astype(object) << 40) == want * 2**80).all()
        low, mid, high = (np.array(d, object) for d in whitening.digits(want.ravel()))
        assert (low + (mid << 60) + (high << 120) == want.ravel()).all()
