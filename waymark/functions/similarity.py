"""Similarity of token arrays and strings.

All but the Jaro measures are built-in expressions. A null argument makes a null result; empty arrays make 0 or false.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(c: Column) -> Column:
    return F.size(c).cast("double")


def list_overlap(a: Column, b: Column, threshold: float) -> Column:
    """Whether the distinct common tokens are at least ``threshold`` of the length of ``a``, copies counted."""
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) == 0) | (F.size(b) == 0), False).otherwise(_n(F.array_intersect(a, b)) / _n(a) >= threshold)


def _ratio(a: Column, b: Column, below: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) == 0) | (below == 0), 0.0).otherwise(_n(F.array_intersect(a, b)) / below)


def numeric_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of ``a`` that ``b`` has."""
    return _ratio(a, b, _n(F.array_distinct(a)))


def iou(a: Column, b: Column) -> Column:
    """Common over all distinct tokens."""
    return _ratio(a, b, _n(F.array_union(a, b)))


#: The same measure under the name of numeric tokens.
numeric_overlap2 = iou


def iou_min(a: Column, b: Column) -> Column:
    """Common distinct tokens over those of the smaller side."""
    return _ratio(a, b, F.least(_n(F.array_distinct(a)), _n(F.array_distinct(b))))


def numbered(c: Column) -> Column:
    """Each token with the number of its copy, sorted, so that common tokens of two multisets are common ones of two sets."""
    s = F.array_sort(c)
    return F.transform(s, lambda x, i: F.concat(x, F.lit("\0"), (F.lit(2) + i - F.array_position(s, x)).cast("string")))


def jaccard_of_sets(x: Column, y: Column) -> Column:
    """Of arrays without copies."""
    common = _n(F.array_intersect(x, y))
    every = _n(x) + _n(y) - common
    return F.when(x.isNull() | y.isNull(), None).when(every == 0, 0.0).otherwise(common / every)


def share_of_first(x: Column, y: Column) -> Column:
    """Of arrays without copies, the share of ``x`` that ``y`` has."""
    return F.when(x.isNull() | y.isNull(), None).when(F.size(x) == 0, 0.0).otherwise(_n(F.array_intersect(x, y)) / _n(x))


def share_of_smaller(x: Column, y: Column) -> Column:
    """Of arrays without copies, what they have in common over the size of the smaller one."""
    return F.when(x.isNull() | y.isNull(), None).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(_n(F.array_intersect(x, y)) / F.least(_n(x), _n(y)))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over the sum of the greater ones."""
    return jaccard_of_sets(numbered(a), numbered(b))


def grams(c: Column) -> Column:
    """The distinct characters and pairs of characters of a string, in a time that grows with its length."""
    ones = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    n = F.greatest(F.size(ones) - 1, F.lit(0))
    return F.array_union(ones, F.zip_with(F.slice(ones, F.lit(1), n), F.slice(ones, F.lit(2), n), lambda x, y: F.concat(x, y)))


def ngram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct characters and pairs of characters."""
    return jaccard_of_sets(grams(a), grams(b))


@lru_cache(maxsize=8)
def _places(text: bytes) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, ch in enumerate(text):
        found.setdefault(ch, []).append(i)
    return found


def jaro_of(a: bytes, b: bytes) -> float:
    """Jaro similarity: matching bytes within half the longer string, and transpositions among them."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    # A byte takes the first free equal one in reach. Reach moves on with the byte, so what is passed is never free again, and
    # the matches are the same from either side: from the shorter one, a place in the longer one is found by bisection.
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    reach = max(0, len(many) // 2 - 1)
    where, nexts, mine, theirs = _places(many), {}, [], []
    for i, ch in enumerate(few):
        if (at := where.get(ch)) is None:
            continue
        k = bisect_left(at, i - reach, nexts.get(ch, 0))
        if k < len(at) and at[k] <= i + reach:
            theirs.append(at[k])
            mine.append(ch)
            k += 1
        nexts[ch] = k
    m = len(mine)
    if not m:
        return 0.0
    crossed = sum(x != many[j] for x, j in zip(mine, sorted(theirs))) // 2
    return (m / len(a) + m / len(b) + (m - crossed) / m) / 3


def jaro_winkler_of(a: bytes, b: bytes) -> float:
    """Jaro similarity raised for a common prefix of up to four bytes, where it is over 0.7."""
    jaro = jaro_of(a, b)
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _pairwise(f):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a, b):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = f(pair[0].encode(), pair[1].encode())
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return apply


def jaro(a: Column, b: Column) -> Column:
    """Of the UTF-8 bytes of both strings."""
    return F.pandas_udf(_pairwise(jaro_of), "double")(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairwise(jaro_winkler_of), "double")(a, b)


def soundex(c: Column) -> Column:
    return F.soundex(c)
