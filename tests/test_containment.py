"""Containment joins against every pair."""

import random
import re

import pytest

from lumbrera.operators import agencies, containment, dedup
from lumbrera.plans import identity

PLANS_WITHOUT = re.compile("NestedLoop|Cartesian")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(params=[100_000, 7])
def key_rows(request, monkeypatch):
    """As it is, and so that most keys are split over parts."""
    monkeypatch.setattr(containment, "KEY_ROWS", request.param)
    return request.param


def test_subsets(spark, key_rows):
    r = random.Random(2)
    word = lambda: f"w{int(r.paretovariate(0.8)) % 40}"  # noqa: E731  some words are in most sets
    small = [(k, sorted({word() for _ in range(r.randrange(0, 4))})) for k in range(60)] + [(98, ["w1", None]), (99, ["nowhere", "w1"])]
    large = [(k, [word() for _ in range(r.randrange(0, 12))]) for k in range(200)] + [(900, [None, "w1"])]
    found = containment.subset_pairs(spark.createDataFrame(small, "small_id int, elements array<string>"), spark.createDataFrame(large, "large_id int, elements array<string>"))
    want = sorted((a, b) for a, x in small for b, y in large if any(x) and {e for e in x if e} <= set(y))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 200
    assert not PLANS_WITHOUT.search(plan(found))


def like(pattern, text):
    return re.search("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower()), text.lower(), re.S) is not None


def test_patterns(spark, key_rows):
    r = random.Random(3)
    texts = [(k, "https://press.example.eu/" + r.choice(["ip", "mex", "Speech"]) + r.choice("_-/") + str(r.randrange(20, 25)) + r.choice("_-/") + str(r.randrange(40))) for k in range(150)]
    texts += [(500, None), (501, ""), (502, "a\\b%c_d"), (503, "É é"), (504, "x" * 5000 + "ip_24_7")]
    patterns = [(k, f"{r.choice(['IP', 'mex', 'SPEECH'])}_{r.randrange(20, 26)}_{r.randrange(45)}") for k in range(80)]
    patterns += [(200, None), (201, ""), (202, "_%"), (203, "p"), (204, "b%c"), (205, "\\b"), (206, "é_É"), (207, "press"), (208, "ip_24_7"), (209, "ip_24_7"), (210, "2_%4")]
    found = containment.holding(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(patterns, "pattern_id int, pattern string"))
    want = sorted((p, t) for p, x in patterns for t, y in texts if x and y is not None and re.search("[^_%]", x) and like(x, y))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 300
    assert not PLANS_WITHOUT.search(plan(found))


@pytest.mark.parametrize(("texts", "patterns"), [([], [(1, "abc")]), ([(1, "abc")], []), ([], []), ([(1, "abc")], [(1, "_")])])
def test_empty_tables(spark, texts, patterns):
    assert containment.holding(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(patterns, "pattern_id int, pattern string")).collect() == []


def test_press_duplicates(spark):
    old = [(1, "https://ec.europa.eu/presscorner/detail/en/ip_24_1234", None, None), (2, "https://dma.example/x", "https://ec.europa.eu/presscorner/detail/en/ip_24_1234", None), (3, "https://a.example/1", None, "ec:MEX-23-9"), (4, "https://b.example", "https://b.example", ""), (5, "", "", None)]
    new = [(10, "IP/24/1234", None), (11, None, "https://b.example"), (12, "mex/23/9", ""), (13, "IP/24/12345", None), (14, "", ""), (15, None, None), (16, "IP/24/123", "https://none.example")]
    found = dedup.press_duplicates(spark.createDataFrame(new, "id int, press_ref string, press_url string"), spark.createDataFrame(old, "id int, url string, canonical_url string, external_id string"))
    assert sorted(map(tuple, found.collect())) == [(10, 1, "presscorner"), (11, 4, "presscorner"), (12, 3, "presscorner"), (16, 1, "presscorner")]


def test_press_query_has_no_loop(spark):
    assert not PLANS_WITHOUT.search(plan(identity.press_duplicates(spark, "/root/testdata/sf0.001")))


def test_persons(spark, key_rows):
    r = random.Random(4)
    firsts, middles, lasts = ["Maria", "maría", "José", "Ann", "Li"], ["", "J.", "del", "Carmen", "Dr."], ["Soto", "Núñez", "O'Neil", "Kim", "x"]
    entities = [f"{r.choice(firsts)} {r.choice(middles)} {r.choice(lasts)}" for _ in range(60)] + ["Cher", "", None, "Dr.", "J K"]
    authors = [f"{r.choice(middles)} {r.choice(firsts)} {r.choice(middles)} {r.choice(middles)} {r.choice(lasts)}{r.choice(['', ', LL.M.'])}" for _ in range(200)] + ["CHER", "Cher Bono", None, "", "J Q K", "j k"]
    found = agencies.person_pairs(spark.createDataFrame([(x,) for x in entities], "entity string"), spark.createDataFrame([(x,) for x in authors], "author string"))
    both = spark.createDataFrame(sorted({(a, b) for a in entities for b in authors if a is not None and b is not None}), "entity string, author string")
    want = both.where(agencies.same_person(both["entity"], both["author"]))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found.where("entity = 'Cher'").collect()[0]["author"] == "CHER" and not PLANS_WITHOUT.search(plan(found))
