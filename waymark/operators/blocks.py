"""Matching of whole tables: inputs and addresses meet in blocks of one numeric token, where they are compared.

A filter on numerics asks for a common token, so no pair is missed; pairs never leave their block, only the best of an input do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from waymark.functions import phrases, similarity, text
from waymark.operators import index as ix
from waymark.operators import match as mt

#: Rows of a side that meet at once; larger blocks are cut into slices of which each meets each, so smaller slices copy rows more often.
SLICE = 40_000
#: By how many times slices are smaller where trigrams, which take more memory than phrases, are made of their rows.
TRIGRAM = 3
#: Blocks whose sizes inputs are told, the largest first.
TOLD = 1000
#: Pairs that are held at once.
PAIRS = 1_000_000


# --- trigrams, as in functions/phrases.py, once a phrase ---------------------------------------------


def _grams(word: str) -> list[str]:
    return [word[p : p + 3] for p in range(phrases.POSITIONS)]


@lru_cache(maxsize=20_000)
def _of_input(phrase: str) -> tuple[str, ...]:
    a, b = ([g for g in _grams(w) if len(g.encode()) >= 2] for w in phrase.split(" "))
    return tuple({f"{x} {y}" for x in a for y in b})


@lru_cache(maxsize=20_000)
def _of_reference(phrase: str) -> tuple[str, ...]:
    a, b = map(_grams, phrase.split(" ")[:2])
    return tuple({g for x in a for y in b if len(g := f"{x} {y}") >= 5})


# --- arrays ------------------------------------------------------------------------------------------


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row and the value of each element of a column of arrays."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists).cast(pa.string())


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers for the values of both, and the values by number."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    codes = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(a)], codes[len(a) :], both.dictionary


def _lengths(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)


def _copies(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The number of the copy, from 0, of each value within its row."""
    order = np.lexsort((codes, rows))
    r, c, at = rows[order], codes[order], np.arange(len(rows))
    first = np.ones(len(rows), bool)
    first[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    out = np.empty(len(rows), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def _text_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the characters and pairs of characters of texts."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    inside = rows[1:] == rows[:-1]
    pairs = ((points[:-1] + 1) << 21 | points[1:])[inside]
    return np.concatenate([rows, rows[:-1][inside]]), np.concatenate([points, pairs])


class Sets:
    """The sets of two sides: sizes, and the tokens that both sides have as bits."""

    def __init__(self, rows_a, codes_a, n_a, rows_b, codes_b, n_b):
        width = int(max(codes_a.max(initial=0), codes_b.max(initial=0))) + 1
        (ra, ca), (rb, cb) = (np.divmod(np.unique(r * width + c), width) for r, c in ((rows_a, codes_a), (rows_b, codes_b)))
        self.size_a, self.size_b = _lengths(ra, n_a), _lengths(rb, n_b)
        shared = (np.bincount(ca, minlength=width) > 0) & (np.bincount(cb, minlength=width) > 0)
        self.a, self.b = self._bits(ra, ca, n_a, shared), self._bits(rb, cb, n_b, shared)

    @staticmethod
    def _bits(rows, codes, n, shared) -> np.ndarray:
        place, words = np.cumsum(shared) - 1, (int(shared.sum()) + 63) // 64
        rows, at = rows[shared[codes]], place[codes[shared[codes]]]
        out = np.zeros(words * n, np.uint64)
        np.add.at(out, (at >> 6) * n + rows, np.uint64(1) << (at & 63).astype(np.uint64))
        return out.reshape(words, n)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int32)
        for a, b in zip(self.a, self.b):
            out += np.bitwise_count(a[i] & b[j])
        return out

    def jaccard(self, i, j):
        common = self.common(i, j).astype(float)
        every = self.size_a[i] + self.size_b[j] - common
        return np.where(every == 0, 0.0, common / np.maximum(every, 1))

    def share_of_first(self, i, j):
        size = self.size_a[i]
        return np.where(size == 0, 0.0, self.common(i, j) / np.maximum(size, 1))

    def share_of_smaller(self, i, j):
        least = np.minimum(self.size_a[i], self.size_b[j])
        return np.where(least == 0, 0.0, self.common(i, j) / np.maximum(least, 1))


class Bytes:
    """The bytes of short texts: by place, and the places of each byte as bits."""

    PLACES = 64

    def __init__(self, texts: list[bytes], lut: np.ndarray):
        n = len(texts)
        self.texts, self.size = texts, np.array([len(t) for t in texts], np.int64)
        short = np.where(self.size <= self.PLACES, self.size, 0)
        data = lut[np.frombuffer(b"".join(t for t in texts if len(t) <= self.PLACES), np.uint8)]
        rows = np.repeat(np.arange(n), short)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(short) - short, short)
        self.by_place = np.zeros((self.PLACES, n), np.int64)
        self.by_place[at, rows] = data
        self.masks = np.zeros((int(lut.max()) + 1) * n, np.uint64)
        np.add.at(self.masks, data * n + rows, np.uint64(1) << at.astype(np.uint64))


def _windows(place: int) -> np.ndarray:
    """By reach, the places within reach of one as bits."""
    return np.array([sum(1 << p for p in range(max(0, place - r), min(63, place + r) + 1)) for r in range(32)], np.uint64)


WINDOWS = [_windows(p) for p in range(64)]


def _jaro_short(few: Bytes, many: Bytes, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As similarity.jaro_of, for many pairs at once; ``few`` is the shorter side of each."""
    one, size, width = np.uint64(1), few.size[x], len(many.size)
    reach = np.maximum(0, many.size[y] // 2 - 1)
    used, mine = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
    for k in range(int(size.max(initial=0))):
        free = many.masks[few.by_place[k][x] * width + y] & WINDOWS[k][reach] & ~used
        low = free & (~free + one)
        used |= low
        mine |= (low != 0).astype(np.uint64) << np.uint64(k)
    m, crossed = np.bitwise_count(used).astype(np.int64), np.zeros(len(x), np.int64)
    for _ in range(int(m.max(initial=0))):
        a, b = mine & (~mine + one), used & (~used + one)
        p, q = (np.minimum(np.bitwise_count(v - one), 63).astype(np.int64) for v in (a, b))
        crossed += (few.by_place[p, x] != many.by_place[q, y]) & (a != 0)
        mine, used = mine ^ a, used ^ b
    some = np.maximum(m, 1)
    value = (m / np.maximum(size, 1) + m / np.maximum(many.size[y], 1) + (m - crossed // 2) / some) / 3
    return np.where(m > 0, value, 0.0)


class Texts:
    """The texts of two sides, for the Jaro measures."""

    def __init__(self, a: pa.Array, b: pa.Array):
        sides = [[t.encode() for t in side.to_pylist()] for side in (a, b)]
        lut = np.zeros(256, np.int64)
        seen = sorted(set().union(*map(set, sides[0] + sides[1])))
        lut[seen] = np.arange(1, len(seen) + 1)  # 0 is no byte
        self.a, self.b = (Bytes(side, lut) for side in sides)

    def jaro(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, (a, b) = np.zeros(len(i)), (self.a, self.b)
        for start in range(0, len(i), 50_000):
            x, y, part = i[start : start + 50_000], j[start : start + 50_000], out[start : start + 50_000]
            n, m = a.size[x], b.size[y]
            long = (n > Bytes.PLACES) | (m > Bytes.PLACES)
            first, second = ~long & (n <= m), ~long & (n > m)
            part[first] = _jaro_short(a, b, x[first], y[first])
            part[second] = _jaro_short(b, a, y[second], x[second])
            for k in np.flatnonzero(long):
                part[k] = similarity.jaro_of(a.texts[x[k]], b.texts[y[k]])
        return out

    def jaro_winkler(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        jaro = self.jaro(i, j)
        prefix, same = np.zeros(len(i)), np.ones(len(i), bool)
        heads_a, heads_b = (np.array([list(t[:4]) + [fill] * (4 - len(t[:4])) for t in side.texts], np.int64).reshape(-1, 4) for side, fill in ((self.a, -1), (self.b, -2)))
        for k in range(4):
            same &= heads_a[i, k] == heads_b[j, k]
            prefix += same
        return np.where(jaro <= 0.7, jaro, jaro + prefix * 0.1 * (1 - jaro))


class Block:
    """Two slices, with what the measures need of them, each made when it is first asked for."""

    def __init__(self, left: pa.Table, right: pa.Table):
        self.left, self.right, self.made = left, right, {}
        self.n, self.m = left.num_rows, right.num_rows

    def __getattr__(self, name):
        if name not in ("numerics", "copies", "alpha", "grams", "text"):
            raise AttributeError(name)
        if name not in self.made:
            self.made[name] = getattr(self, f"_{name}")()
        return self.made[name]

    def _sides(self, name):
        (ra, va), (rb, vb) = _flat(self.left[name]), _flat(self.right[name])
        ca, cb, _ = _codes(va, vb)
        return ra, ca, rb, cb

    def _numerics(self) -> Sets:
        ra, ca, rb, cb = self._sides("numerics")
        self.number = _lengths(ra, self.n)
        return Sets(ra, ca, self.n, rb, cb, self.m)

    def _copies(self) -> Sets:
        ra, ca, rb, cb = self._sides("numerics")
        (xa, xb), width = (_copies(ra, ca), _copies(rb, cb)), int(max(ca.max(initial=0), cb.max(initial=0))) + 1
        return Sets(ra, xa * width + ca, self.n, rb, xb * width + cb, self.m)

    def _alpha(self) -> Sets:
        ra, ca, rb, cb = self._sides("alpha")
        self.none_a, self.none_b = (side["alpha"].is_null().to_numpy() for side in (self.left, self.right))
        return Sets(ra, ca, self.n, rb, cb, self.m)

    def _grams(self) -> Sets:
        (ra, va), (rb, vb) = (_text_grams(side["text"].combine_chunks()) for side in (self.left, self.right))
        _, codes = np.unique(np.concatenate([va, vb]), return_inverse=True)
        return Sets(ra, codes[: len(va)], self.n, rb, codes[len(va) :], self.m)

    def _text(self) -> Texts:
        return Texts(self.left["text"], self.right["text"])


def _tokens(b: Block, i, j):
    share = b.alpha.share_of_smaller(i, j)
    return np.where(b.none_a[i] | b.none_b[j], np.nan, share * b.numerics.jaccard(i, j))


#: The measures of match.SCORES over the rows i and j of a block's sides; NaN stands for null.
MEASURES = {
    "tokens": _tokens,
    "jaro": lambda b, i, j: b.text.jaro(i, j),
    "jaro_overlap": lambda b, i, j: b.text.jaro(i, j) * b.numerics.share_of_first(i, j),
    "ngram_overlap": lambda b, i, j: b.grams.jaccard(i, j) * b.numerics.share_of_first(i, j),
    "ngram_overlap2": lambda b, i, j: b.grams.jaccard(i, j) * b.numerics.jaccard(i, j),
    "ngram_multiset": lambda b, i, j: b.grams.jaccard(i, j) * b.copies.jaccard(i, j),
    "jaro_winkler": lambda b, i, j: b.text.jaro_winkler(i, j),
}


# --- pairs -------------------------------------------------------------------------------------------


def _joined(rows_a, keys_a, rows_b, keys_b, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct pairs of rows that share a key, by both rows, all of a row of ``a`` at a time. ``m`` is the number of rows of ``b``."""
    by_row, by_key = np.argsort(rows_a, kind="stable"), np.argsort(keys_b, kind="stable")
    rows_a, keys_a, rows_b, keys_b = rows_a[by_row], keys_a[by_row], rows_b[by_key], keys_b[by_key]
    low, high = np.searchsorted(keys_b, keys_a, "left"), np.searchsorted(keys_b, keys_a, "right")
    found = high > low
    rows_a, low, number = rows_a[found], low[found], (high - low)[found]
    ends = np.cumsum(number)
    last = np.append(np.flatnonzero(rows_a[1:] != rows_a[:-1]) + 1, len(rows_a)) if len(rows_a) else np.array([], int)
    start = 0
    while start < len(rows_a):
        done = ends[start - 1] if start else 0
        fits = last[(last > start) & (ends[last - 1] - done <= PAIRS)]
        stop = int(fits[-1]) if len(fits) else int(last[np.searchsorted(last, start, "right")])
        n = number[start:stop]
        at = np.repeat(low[start:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        top = int(rows_a[start])
        code = (np.repeat(rows_a[start:stop], n) - top) * m + rows_b[at]
        area = (int(rows_a[stop - 1]) - top + 1) * m
        if len(code) * 8 > area:
            marked = np.zeros(area, bool)
            marked[code] = True
            code = np.flatnonzero(marked)
        else:
            code = np.unique(code)
        i, j = np.divmod(code, m)
        yield i + top, j
        start = stop


def _rare(rows: np.ndarray, values: pa.Array, frequent: pa.Array) -> tuple[np.ndarray, pa.Array]:
    keep = pc.invert(pc.is_in(values, value_set=frequent))
    return rows[keep.to_numpy(zero_copy_only=False)], values.filter(keep)


def _keys(rows, values, of, frequent):
    """(phrase of each element, rows of phrases, their rare trigrams) of elements that are phrases."""
    coded = values.dictionary_encode()
    found = [of(p) for p in coded.dictionary.to_pylist()]
    trigrams = pa.array([g for f in found for g in f], pa.string())
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), *_rare(np.repeat(np.arange(len(found)), [len(f) for f in found]), trigrams, frequent), len(found)


def _slice(trigrams: bool) -> int:
    return max(1, SLICE // TRIGRAM) if trigrams else SLICE


def candidates(block: Block, trigrams: bool, frequent: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a block that share a phrase that isn't frequent, all of an input at a time."""
    (ra, va), (rb, vb) = _flat(block.left["phrases"]), _flat(block.right["phrases"])
    if not trigrams:
        (ra, va), (rb, vb) = _rare(ra, va, frequent), _rare(rb, vb, frequent)
        ca, cb, _ = _codes(va, vb)
        yield from _joined(ra, ca, rb, cb, block.m)
        return
    # Phrases meet by their trigrams, each once, and rows by their phrases.
    pb, row_b, keys_b, n_b = _keys(rb, vb, _of_reference, frequent)
    step = _slice(True)
    for start in range(0, block.n, step):
        these = (ra >= start) & (ra < start + step)
        if not these.any():
            continue
        pa_, row_a, keys_a, _ = _keys(ra[these], va.filter(pa.array(these)), _of_input, frequent)
        ca, cb, _ = _codes(keys_a, keys_b)
        links = list(_joined(row_a, ca, row_b, cb, n_b))
        if not links:
            continue
        x, y = (np.concatenate(side) for side in zip(*links))
        low, high = np.searchsorted(x, pa_, "left"), np.searchsorted(x, pa_, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield from _joined(np.repeat(ra[these], n), y[at], rb, pb, block.m)


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best of each row, ``i`` sorted; lower ``j`` first where they tie, NaN last."""
    score = np.where(np.isnan(score), -np.inf, score)
    starts = np.append(0, np.flatnonzero(i[1:] != i[:-1]) + 1)
    if n == 1:
        top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, starts), np.diff(np.append(starts, len(i)))))
        return top[np.searchsorted(top, starts)]
    order = np.lexsort((j, -score, i))
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
    return order[rank < n]


def compared(left: pa.Table, right: pa.Table, *, spec: dict, frequent: list[str], schema: pa.Schema) -> pa.Table:
    """The best pairs of a block's two slices."""
    out = []
    if left.num_rows and right.num_rows:
        right = right.sort_by("address_id2")
        block, rare = Block(left, right), pa.array(frequent, pa.string())
        sets, near = block.numerics, right["near"].to_numpy()
        for i, j in candidates(block, spec["trigrams"], rare):
            common, number = sets.common(i, j), block.number[i]
            keep = (number <= 3) & (common == sets.size_a[i]) if spec["overlap"] is None else common / number >= spec["overlap"]
            keep &= common > 0
            if spec["near"] and not spec["first"]:
                keep &= near[j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            by = spec["first"] or spec["score"]
            score = MEASURES[by](block, i, j)
            chosen = _best(i, j, score, spec["n"])
            i, j, score = i[chosen], j[chosen], score[chosen]
            final = score if by == spec["score"] else MEASURES[spec["score"]](block, i, j)
            number = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
            out.append(pa.table([left["address_id1"].take(pa.array(i)), right["address_id2"].take(pa.array(j)), number(score), number(final), pa.array(near[j])], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


# --- tables ------------------------------------------------------------------------------------------


def _sliced(rows: DataFrame, large: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """``rows`` with their slice, once for each slice of the other side; without those of large blocks that the other side has no rows of."""
    slices = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(1))
    cut = rows.join(F.broadcast(large), "block", "left").where(slices(other) > 0)
    return cut.withColumn(own, F.pmod(F.xxhash64(key), slices(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), slices(other) - 1))).drop(f"n_{own}", f"n_{other}")


def _asked(numerics: Column, spec: mt.MatchSpec, large: list[str]) -> Column:
    """The blocks that an input goes to: with ``c`` of its ``n`` different numerics asked for, any ``n - c + 1`` find all addresses, so the smallest do.

    ``large`` are tokens of large blocks, the largest last.
    """
    different = F.array_distinct(numerics)
    if spec.overlap is None:
        number = F.when(F.size(numerics) <= 3, 1).otherwise(0)
    else:
        # What rounding leaves open is asked for in one block more.
        least = F.greatest(F.lit(1), F.ceil(F.size(numerics) * spec.overlap - 1e-9).cast("int"))
        number = F.greatest(F.lit(0), F.size(different) - least + 1)
    if large:
        place = F.array(*map(F.lit, large))
        by_size = F.array_sort(F.transform(different, lambda t: F.struct(F.array_position(place, t).alias("at"), t.alias("token"))))
        different = F.transform(by_size, lambda x: x["token"])
    return F.slice(different, F.lit(1), number)


def _chosen(own: DataFrame, detail: DataFrame, index: str, spec: mt.MatchSpec, top_n: int, neighbours: DataFrame | None) -> DataFrame:
    """(address_id1, address_id2, similarity): the ``top_n`` best addresses of each input; with neighbours, of those whose place has some."""
    trigrams = index == "trigram"
    frequent = [r[0] for r in ix.frequent_phrases(detail, index, spec.cap).select("key").collect()]
    mine = F.array_distinct(F.array_compact((phrases.bigrams if trigrams else spec.phrases)(text.split_tokens(F.col("address")))))
    theirs = F.array_distinct(F.array_compact(ix.GENERATORS["standard" if trigrams else index](text.phrase_tokens(F.col("addr")))))
    kinds = {f for kind in (spec.prefilter, spec.score) if kind for f in mt.SCORES[kind][0]}
    alpha = lambda c: [c.alias("alpha")] if "alpha" in kinds else []
    words = lambda c: [c.alias("text")] if kinds & {"grams", "text"} else []
    blocks = lambda c: F.array_distinct(c).alias("blocks")
    # Exploded in a step of its own, so that what is made of a row is made once.
    # The outer form has no filter that would go below the dealing by id, where the few files of inputs would be few tasks.
    opened = lambda df: df.withColumn("block", F.explode_outer("blocks")).drop("blocks").where(F.col("block").isNotNull())

    near = F.lit(True)
    if neighbours is not None:
        place = neighbours.select(F.col("suburb_name").alias("suburb"), F.col("state_name").alias("STATE"), F.col("postcode").alias("POSTCODE")).distinct().withColumn("known", F.lit(True))
        detail, near = detail.join(place, ["suburb", "STATE", "POSTCODE"], "left"), F.coalesce("known", F.lit(False))
    size = _slice(trigrams)
    known = detail.select(F.explode(F.array_distinct("numeric_tokens")).alias("block")).groupBy("block").count().where(F.col("count") > size)
    told = [r[0] for r in known.orderBy(F.desc("count"), "block").limit(TOLD).select("block").collect()]
    needed = _asked(F.col("input_numerics"), spec, told[::-1])
    left = opened(own.select("address_id1", F.col("input_numerics").alias("numerics"), mine.alias("phrases"), *words(F.col("address")), *alpha(F.col("input_alpha_tokens")), blocks(needed)))
    right = opened(detail.select(F.col("addr_id").alias("address_id2"), F.col("numeric_tokens").alias("numerics"), near.alias("near"), theirs.alias("phrases"), *words(F.col("addr")), *alpha(text.alpha_tokens(F.col("addr"))), blocks(F.col("numeric_tokens"))))

    # Blocks of more than a slice: less than twice the tokens over the slice, so few.
    sizes = left.select("block", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(right.select("block", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = lambda c: F.ceil(F.col(c) / size).cast("int")
    large = sizes.where((F.col("a") > size) | (F.col("b") > size)).select("block", parts("a").alias("n_slice1"), parts("b").alias("n_slice2"))
    left, right = _sliced(left, large, "address_id1", "slice1", "slice2"), _sliced(right, large, "address_id2", "slice2", "slice1")

    first = spec.prefilter if spec.prefilter and (spec.prefilter != spec.score or neighbours is not None) else None
    how = {"trigrams": trigrams, "overlap": spec.overlap, "near": neighbours is not None, "first": first, "score": spec.score, "n": spec.prefilter_n if first else top_n}
    schema = T.StructType([T.StructField("address_id1", left.schema["address_id1"].dataType), T.StructField("address_id2", right.schema["address_id2"].dataType), T.StructField("first_score", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("near", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    do = partial(compared, spec=how, frequent=frequent, schema=to_arrow_schema(schema))
    keys = ["block", "slice1", "slice2"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: do(a, b), schema)

    # A pair of two common numerics comes from two blocks, and has one rank.
    rank = lambda by: F.dense_rank().over(Window.partitionBy("address_id1").orderBy(F.desc(by), "address_id2"))
    if first:
        found = found.withColumn("rank", rank("first_score")).where(F.col("rank") <= spec.prefilter_n)
    if neighbours is not None:
        found = found.where("near")
    return found.withColumn("rank", rank("similarity")).where(F.col("rank") <= top_n).dropDuplicates(["address_id1", "address_id2"]).select("address_id1", "address_id2", "similarity")


def match(inputs: DataFrame, detail: DataFrame, index: str, spec: mt.MatchSpec | str = "standard", top_n: int = 1, neighbours: DataFrame | None = None) -> DataFrame:
    """As match.match with the postings of ``index`` of ``detail``, for inputs that are many: no posting is made, and no pair is moved."""
    spec = mt.CATALOGUE[spec] if isinstance(spec, str) else spec
    if spec.overlap is not None and spec.overlap <= 0:
        raise ValueError("matching by blocks needs a common numeric token: overlap must be above 0")
    own = mt.prepared(inputs, spec)
    chosen = _chosen(own, detail, index, spec, top_n, neighbours)
    if neighbours is not None:
        chosen = mt.best(mt.moved(chosen, detail.hint("merge"), neighbours), "similarity", top_n)
    return mt.named(own, chosen, detail.hint("merge"), spec, neighbours is not None)
