"""The clustered index against scores counted out by hand."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbrera.llm import bisection, ranked_search

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def by_hand(docs, items, k=20):
    """item_id, rank, doc_id and score by the contract's formula, in whole numbers."""
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_words = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in own:
            m = 75 + 25 * c.total() * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -score) for rank, (score, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def corpus(n, seed=3, topics=6):
    """Documents of several topics, with common words, copies and ties."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        own = r.randrange(topics)
        out.append((k, " ".join(f"t{own}x{r.randrange(60)}" if r.random() < 0.6 else f"c{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randrange(5, 120)))))
    return out + [(n + k, out[k % 5][1]) for k in range(n // 3)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranked_search, "CLUSTER", 8)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 1500)
    monkeypatch.setattr(ranked_search, "LEAF_DOCS", 16)
    monkeypatch.setattr(ranked_search, "FIRST", 2)


def test_equals_scores_by_hand(spark, small, monkeypatch):
    docs, r = corpus(240), random.Random(8)
    items = [(k, " ".join(r.choice(docs)[1].split()[:20] + ["Unknown"])) for k in range(12)] + [(90, "c1"), (91, "c1 c1 C1 c2")]
    d, i = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    assert rows(ranked_search.digest(d, i)) == by_hand(docs, items)
    # In batches of a few items, and with sums in whole numbers.
    monkeypatch.setattr(ranked_search, "BATCH_ITEMS", 5)
    weighed = ranked_search.weighed
    monkeypatch.setattr(ranked_search, "weighed", lambda *a: weighed(*a)._replace(exact=False))
    assert rows(ranked_search.digest(d, i)) == by_hand(docs, items)


def test_odd_rows(spark, small):
    docs = [(1, None), (2, ""), (3, "..., --"), (4, "one Two"), (5, "ONE two"), (5, "one two"), (None, "one two"), (None, "é ÉÉ É"), (6, "x " * 200_000 + "one"), (7, "y" * 1_000_000), (8, "日本 one\x00two_three"), (9, "one`two@three")]
    items = [(1, "one"), (2, None), (3, "!!"), (4, "É"), (1, "two two"), (None, "one two"), (5, "y" * 1_000_000), (6, "three x"), (7, " ".join(f"w{k}" for k in range(30_000)) + " one")]
    extra = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit(1), "terms": F.lit("x"), "leaf": F.lit(2), "block": F.lit(3)})
    assert rows(ranked_search.digest(extra, spark.createDataFrame(items, ITEMS))) == by_hand(docs, items)


@pytest.mark.parametrize(("docs", "items"), [([], []), ([], [(1, "one")]), ([(1, "one")], []), ([(1, None)], [(1, "one")]), ([(1, "one")], [(1, "one")])])
def test_few_rows(spark, docs, items):
    assert rows(ranked_search.digest(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == by_hand(docs, items)


def test_stops_before_all_clusters(spark, small):
    """Items of one topic leave the clusters of the others alone, and the index holds every document once."""
    docs = [(d, t) for d, t in corpus(400, topics=8)]
    index = ranked_search.build(spark.createDataFrame(docs, DOCS))
    assert sorted(x for r in index.rows.select("ids").collect() for x in r["ids"]) == sorted(d for d, _ in docs)
    items = [(k, " ".join(f"t{k}x{j}" for j in range(25))) for k in range(8)]
    found, visits = ranked_search.search_batch(index, [Counter(t.encode().split()) for _, t in items], 5)
    got = sorted(((r["item"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=repr)
    assert got == by_hand(docs, items, 5)
    assert visits < 0.6 * index.rows.count() * len(items)


def test_bisection_brings_topics_together():
    r = np.random.default_rng(1)
    topic = r.integers(0, 4, 512)
    words = [np.unique(np.r_[topic[k] * 50 + r.integers(0, 50, 12), 200 + r.integers(0, 30, 6)]) for k in range(512)]
    lengths = np.array([len(w) for w in words])
    docs = bisection.Docs(np.cumsum(lengths) - lengths, lengths, np.concatenate(words))
    order = bisection.order(docs, 230, 64)
    assert sorted(order) == list(range(512))
    purity = np.mean([np.bincount(topic[order[k : k + 64]]).max() / 64 for k in range(0, 512, 64)])
    assert purity > 0.7
    nodes = bisection.tree(docs, 230, 2)
    leaf = bisection.leaves(nodes, lengths, docs.terms)
    assert np.mean([np.bincount(leaf[topic == t]).max() / (topic == t).sum() for t in range(4)]) > 0.7
    assert bisection.leaves(nodes, np.array([0, 2]), np.array([230, 230])).tolist() == [0, 0]
