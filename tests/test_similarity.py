import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import similarity as sim

CASES = [
    (["1", "2"], ["1", "2"]), (["1", "2"], ["2", "3"]), ([], ["1"]), (["1"], []), ([], []),
    (["1", "1", "2"], ["1"]), (["5"], ["6"]), (["A", "B", "B"], ["B", "B", "C"]), (None, ["1"]), (["1"], None),
]


def expected(name, a, b):
    if a is None or b is None:
        return None
    x, y = set(a), set(b)
    both = len(x & y)
    if name == "list_overlap":
        return bool(a and b and both / len(a) >= 0.5)
    if name == "numeric_overlap":
        return both / len(x) if x else 0.0
    if name == "iou":
        return both / len(x | y) if a else 0.0
    if name == "iou_min":
        return both / min(len(x), len(y)) if a and b else 0.0
    low = sum(min(a.count(k), b.count(k)) for k in x | y)
    high = sum(max(a.count(k), b.count(k)) for k in x | y)
    return low / high if high else 0.0


@pytest.mark.parametrize("name", ["list_overlap", "numeric_overlap", "iou", "iou_min", "multiset_jaccard"])
def test_arrays(spark, name):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES)], "i int, a array<string>, b array<string>")
    f = (lambda a, b: sim.list_overlap(a, b, 0.5)) if name == "list_overlap" else getattr(sim, name)
    for r in df.select("a", "b", f(F.col("a"), F.col("b")).alias("v")).collect():
        assert r.v == expected(name, r.a, r.b), (name, r)


def test_ngram_jaccard(spark):
    rows = [("", ""), ("a", ""), ("a", "a"), ("ab", "ba"), ("main st", "main street"), (None, "x")]

    def grams(s):
        return set(s) | {s[i : i + 2] for i in range(len(s) - 1)}

    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", sim.ngram_jaccard(F.col("a"), F.col("b")).alias("v")).collect():
        want = None if r.a is None else (len(grams(r.a) & grams(r.b)) / len(grams(r.a) | grams(r.b)) if grams(r.a) | grams(r.b) else 0.0)
        assert r.v == want


def test_jaro_known_values():
    assert math.isclose(sim.jaro_of(b"MARTHA", b"MARHTA"), 17 / 18)
    assert math.isclose(sim.jaro_of(b"DIXON", b"DICKSONX"), 23 / 30)
    assert math.isclose(sim.jaro_winkler_of(b"MARTHA", b"MARHTA"), 17 / 18 + 0.3 / 18)
    assert sim.jaro_of(b"", b"") == 1.0 and sim.jaro_of(b"a", b"") == 0.0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=12), st.binary(max_size=12))
def test_jaro_bounds(a, b):
    j, w = sim.jaro_of(a, b), sim.jaro_winkler_of(a, b)
    assert 0 <= j <= w <= 1
    assert j == 1 or a != b
