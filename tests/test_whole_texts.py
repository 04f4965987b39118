"""The measures of the similarity queries against brute force on whole texts: what stands far behind the start counts."""

import random
from collections import Counter

import pytest

from waymark.plans import registry

DRAWN = random.Random(3)
WORDS = "rue main st élan 12 12a lot north 東京 a😀b".split()
DOCUMENTS = [(d, " ".join(DRAWN.choices(WORDS, k=n))) for d, n in ((2, 3), (7, 90), (41, 130), (1000, 400))]
# The last two differ only behind 300 equal words.
DOCUMENTS += [(50, "same " * 300 + "main st 12"), (51, "same " * 300 + "north lot"), (60, ""), (61, None)]
BENCHMARK = [(5, "x " * 70 + "main st 12"), (90, " ".join(DRAWN.choices(WORDS, k=80))), (91, "MAIN st"), (92, None)]


def naive_jaro(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, taken, mine = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == ch and j not in taken), None)
        if j is not None:
            taken.add(j)
            mine.append(ch)
    if not mine:
        return 0.0
    m, crossed = len(mine), sum(x != b[j] for x, j in zip(mine, sorted(taken))) // 2
    return (m / len(a) + m / len(b) + (m - crossed) / m) / 3


def winkler(a, b):
    jaro, same = naive_jaro(a, b), 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def grams(s):
    return set(s) | {s[i : i + 2] for i in range(len(s) - 1)}


def of_words(f):
    return lambda x, y: f(x.lower().split(" "), y.lower().split(" "))


EXPECTED = {
    "sim_list_overlap": of_words(lambda a, b: len({*a} & {*b}) / len(a) >= 0.5),
    "sim_numeric_overlap": of_words(lambda a, b: len({*a} & {*b}) / len({*a})),
    "sim_numeric_overlap2": of_words(lambda a, b: len({*a} & {*b}) / len({*a} | {*b})),
    "sim_iou": of_words(lambda a, b: len({*a} & {*b}) / len({*a} | {*b})),
    "sim_iou_min": of_words(lambda a, b: len({*a} & {*b}) / min(len({*a}), len({*b}))),
    "sim_multiset_jaccard": of_words(lambda a, b: (Counter(a) & Counter(b)).total() / (Counter(a) | Counter(b)).total()),
    "sim_ngram_jaccard": lambda x, y: len(grams(x) & grams(y)) / len(grams(x) | grams(y)),
    "sim_jaro": lambda x, y: round(naive_jaro(x.encode(), y.encode()), 6),
    "sim_jaro_winkler": lambda x, y: round(winkler(x.encode(), y.encode()), 6),
}


@pytest.mark.parametrize("name", EXPECTED)
def test_whole_texts(spark, name):
    pairs = spark.createDataFrame([(d, i, x, y) for d, x in DOCUMENTS for i, y in BENCHMARK], "doc_id bigint, item_id bigint, x string, y string")
    got = {(r.doc_id, r.item_id): r.value for r in registry.similar(name, pairs).collect()}
    assert len(got) == len(DOCUMENTS) * len(BENCHMARK)
    for d, x in DOCUMENTS:
        for i, y in BENCHMARK:
            want = None if x is None or y is None else EXPECTED[name](x, y)
            assert got[d, i] == pytest.approx(want, abs=1.1e-6 if "jaro" in name else 1e-12), (d, i)


def test_every_input_has_its_pair(spark):
    """One row an input: the queries leave no input out and pair it once."""
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/customer.parquet").count()
    for name in EXPECTED:
        assert registry.QUERIES[name](spark, folder).select("address_id").distinct().count() == n
