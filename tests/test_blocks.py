"""Matching by blocks against matching by postings, and its arrays against the plain measures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.functions import similarity
from waymark.operators import blocks as bl
from waymark.operators import index as ix
from waymark.operators import match as mt
from waymark.plans import registry

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"street{i}" for i in range(12))
#: Odd inputs: null, empty, no number, a number twice, many numbers, texts of over 64 bytes, accents, other alphabets.
ODD = [None, "", "main street", "12 12 main st", "1 2 3 4 5 6 main st 12", f"7 {LONG} 1001", "12 rué émile 75", "12 улица мира 75", "5 a", "12", "12/14 main st springfield 75"]


@pytest.fixture(scope="module")
def tables(spark):
    inputs = spark.createDataFrame(list(enumerate(ODD, 1)), "address_id int, address string")
    labels = ["12 Main St Springfield 75", "14 Main St Springfield 75", "12 Rué Émile 75", "12 улица мира 75", f"7 {LONG} 1001", f"7 {LONG} x 1001", "5 A", "12 12 Main St", "12, Main St", "1 2 3 main st"] + [f"{i % 9 + 5} main st springfield {70 + i % 7}" for i in range(60)]
    rows = [(i, t, "S" if i % 2 else None, "75", "V", 0.0, 0.0) for i, t in enumerate(labels, 1)]
    addresses = spark.createDataFrame(rows, "addr_id int, ADDRESS_LABEL string, LOCALITY_NAME string, POSTCODE string, STATE string, LATITUDE float, LONGITUDE float")
    near = spark.createDataFrame([("S", "V", "75", f"{x} V 75", x != "S") for x in "ST"], "suburb_name string, state_name string, postcode string, neighbour_suburb_state_postcode string, neighbouring_suburb_correction boolean")
    return inputs, ix.addresses_with_detail(addresses).cache(), near


def both(tables, how, cap, monkeypatch, top_n=2, near=False):
    monkeypatch.setattr(bl, "SLICE", 7)
    inputs, detail, neighbours = tables
    spec = mt.replace(mt.CATALOGUE[how], cap=cap, prefilter_n=5)
    extra = neighbours if near else None
    plain = lambda df: sorted(map(str, df.select("address_id", "address_id2", "address_matched", F.round("similarity", 12).alias("s"), *(mt.NEAR if near else [])).collect()))
    index = mt.INDEX[spec.phrases]
    return plain(bl.match(inputs, detail, index, spec, top_n, extra)), plain(mt.match(inputs, detail, registry._postings(detail, index, cap), spec, top_n, extra))


# no table is broadcast by what its files seem to hold, and no pair is moved.
def test_bigram_union_equals_postings(tables, monkeypatch):
    mine, theirs = both(tables, "bigram_union", 50, monkeypatch)
    assert mine == theirs


def test_plan_neither_broadcasts_addresses_nor_moves_pairs(spark):
    plan = registry.QUERIES["match_bigram_union"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "grams" not in plan
    # All that is broadcast are the blocks of more than a slice, once a side.
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("n_slice1") > 0


def test_jaro_of_arrays():
    draw = random.Random(4)
    texts = ["".join(draw.choice("ABC 12") for _ in range(draw.choice([0, 1, 2, 5, 30, 63, 64, 65, 90]))) for _ in range(120)] + ["MARTHA", "MARHTA", "É1", "É 1"]
    made, (i, j) = bl.Texts(pa.array(texts), pa.array(texts[::-1])), (g.ravel() for g in np.indices((len(texts),) * 2))
    pairs = [(texts[x].encode(), texts[::-1][y].encode()) for x, y in zip(i, j)]
    some = np.array([bool(a and b) for a, b in pairs])  # addresses in blocks have a number
    assert made.jaro(i, j)[some].tolist() == [similarity.jaro_of(*p) for p, s in zip(pairs, some) if s]
    assert made.jaro_winkler(i, j)[some].tolist() == [similarity.jaro_winkler_of(*p) for p, s in zip(pairs, some) if s]


def test_pairs_in_small_chunks(monkeypatch):
    monkeypatch.setattr(bl, "PAIRS", 5)
    draw = np.random.default_rng(2)
    for most in (3, 30):
        ra, ka, rb, kb = draw.integers(0, 20, 60), draw.integers(0, most, 60), draw.integers(0, 9, 40), draw.integers(0, most, 40)
        found = [(x, y) for i, j in bl._joined(ra, ka, rb, kb, 9) for x, y in zip(i.tolist(), j.tolist())]
        assert found == sorted({(x, y) for x, k in zip(ra.tolist(), ka.tolist()) for y, l in zip(rb.tolist(), kb.tolist()) if k == l})


# what a lambda reads is computed once, not once an element.
def test_soundex_of_each_token_once(spark):
    from waymark.functions import phrases

    one = spark.createDataFrame([(["12", "MAIN", "ST", "X", "75"],)], "t array<string>")
    want = ["12 M500", "M500 S300", "S300 X000", "X000 75", "12 S300"]
    assert one.select(phrases.sounds(F.col("t")).alias("p")).first().p == want
    # The codes of a phrase come from a variable, so the expression holds soundex once.
    assert phrases.sounds(F.col("t"))._jc.toString().count("soundex") == 1


def test_soundex_equals_postings(tables, monkeypatch):
    mine, theirs = both(tables, "soundex", 50, monkeypatch)
    assert mine == theirs


# trigrams meet by phrases, and a numeric that both have is asked for first.
@pytest.mark.parametrize("how, cap", [("trigram", 40), ("trigram_contained", 60), ("trigram_contained_rare", 40)])
def test_trigrams_equal_postings(tables, monkeypatch, how, cap):
    mine, theirs = both(tables, how, cap, monkeypatch)
    assert mine == theirs


def test_frequent_trigrams_are_counted_by_phrases(tables):
    table = ix.trigram_phrases(ix.phrase_table(tables[1], "standard"))
    counted = table.groupBy("trigramphrase").count().where("count >= 10")
    assert sorted(ix.frequent_phrases(tables[1], "trigram", 10).collect()) == sorted(counted.collect())


# neighbours are joined to the chosen addresses alone; places without any are left out before that.
def test_winkler_with_neighbours_equals_postings(tables, monkeypatch):
    mine, theirs = both(tables, "winkler", 50, monkeypatch, near=True)
    assert mine == theirs


# an input goes to as few blocks as find all its addresses, the smallest ones, and rows aren't copied to slices without partners.
def test_an_input_asks_the_smallest_blocks(spark):
    numerics = spark.createDataFrame([(["7", "8", "9"],), (["9"],), (["7", "7", "8"],), (["9", "8", "9", "9"],), (["1", "2", "3", "4"],), (None,)], "n array<string>")
    asked = lambda how, large: [r.b for r in numerics.select(bl._asked(F.col("n"), mt.CATALOGUE[how], large).alias("b")).collect()]
    assert asked("winkler", ["8", "7"]) == [["9", "8"], ["9"], ["8"], ["9"], ["1", "2", "3"], None]
    assert asked("standard", []) == [["7", "8", "9"], ["9"], ["7", "8"], ["9", "8"], ["1", "2", "3", "4"], None]
    assert asked("trigram_contained", ["9", "8"]) == [["7"], ["9"], ["7"], [], [], None]


@pytest.mark.parametrize("how", ["standard", "winkler", "trigram"])
def test_large_blocks_equal_postings(tables, monkeypatch, how):
    monkeypatch.setattr(bl, "TRIGRAM", 1)
    monkeypatch.setattr(bl, "TOLD", 3)
    mine, theirs = both(tables, how, 60, monkeypatch)
    assert mine == theirs


def test_rows_of_blocks_without_partners_are_not_moved(spark):
    large = spark.createDataFrame([("75", 0, 2), ("76", 3, 2)], "block string, n_slice1 int, n_slice2 int")
    rows = spark.createDataFrame([(1, "75"), (2, "76"), (3, "77")], "address_id2 int, block string")
    found = bl._sliced(rows, large, "address_id2", "slice2", "slice1").groupBy("address_id2").count().collect()
    assert sorted(map(tuple, found)) == [(2, 3), (3, 1)]


# where all numerics are asked for, an input goes to the block of its rarest one, not of its first.
def test_contained_asks_the_rarest_block(spark):
    numerics = spark.createDataFrame([(["75", "12"],), (["75", "1000"],), (["1000"],)], "n array<string>")
    asked = numerics.select(bl._asked(F.col("n"), mt.CATALOGUE["trigram_contained"], ["1000", "75"]).alias("b"))
    assert [r.b for r in asked.collect()] == [["12"], ["1000"], ["1000"]]


# inputs are cleaned where they were dealt to, not before, where their few files are few tasks.
def test_inputs_are_cleaned_after_dealing(spark):
    plan = registry.QUERIES["match_trigram"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert not any("Filter" in line and "regexp_replace" in line for line in plan.splitlines())
