"""Quality rules on repetition: how much of a text stands in duplicated n-grams and lines.

Words are runs of characters other than space and \\t to \\r. Each word gets a 64-bit hash, windows of 2
to 10 words get rolling hashes in numpy, each length's from the length before, and equal hashes in one text count as equal n-grams (two
different ones in a text of a million words have equal hashes with a chance of about 1 in 10 million).
A longer n-gram can only be duplicated where the shorter one is, so longer ones are looked for there.

Verdict: a text is rejected by the base rules (fewer than ``MIN_WORDS`` words, or over half of them in
repeated 3-word windows), or when the characters of words inside later copies of duplicated n-grams of
5 to 10 words, in later copies of lines, or in all places of the most frequent 2 to 4-gram, exceed
shares of the characters of all words.

Of equally frequent n-grams the one whose places cover the most characters counts.

Cases: null and empty texts have no words and fail the base rules; an all-space text as well; rows are
judged one by one, so repeated rows get equal results; ties are settled as said; an empty table gives an
empty one; very long texts are held once and take sorts of their own length; other columns are ignored
by :func:`measure` and passed on by :func:`keep`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import ROLL, SPACES, documents, keep_rows, map_texts, mix, word_hashes

MIN_WORDS = 50
#: The largest share of characters in later copies of duplicated n-grams.
DUPLICATED = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: The largest share of characters in the most frequent n-gram.
TOP = {2: 0.25, 3: 0.25, 4: 0.25}
#: The largest share of characters in later copies of lines.
LINES = 0.35

SYMBOLS = b"#*$%&|<>"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
    "dup_line_chars bigint, dup_ngram_chars array<bigint>, top_ngram_chars array<bigint>"
)


def word_lengths(raw: bytes) -> np.ndarray:
    """Code points of each word of UTF-8 bytes."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_IS_SPACE[b], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if raw.isascii():
        return end - begin
    heads = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=heads[1:])
    return heads[end] - heads[begin]


def _groups(h: np.ndarray):
    """(order, sorted hash equals the one before) of hashes; equal ones stand together in text order."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    return order, s[1:] == s[:-1]


def _covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Marks the words inside the windows of ``n`` words that begin at ``starts``."""
    change = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + n, minlength=n_words + 1)
    return np.cumsum(change[:-1]) > 0


def _top(places: np.ndarray, same: np.ndarray, n: int, before: np.ndarray) -> int:
    """Most characters that the places of one of the most frequent n-grams cover; ``places`` are grouped as in :func:`_groups`."""
    run = np.flatnonzero(np.r_[True, ~same, True])
    size = np.diff(run)
    most = size.max()
    # Rows are n-grams, columns their places in order; where two places overlap, the later one adds what is behind the earlier one.
    at = places[run[:-1][size == most][:, None] + np.arange(most)]
    begin = np.maximum(at[:, 1:], at[:, :-1] + n)
    return int(((before[at[:, 0] + n] - before[at[:, 0]]) + (before[at[:, 1:] + n] - before[begin]).sum(axis=1)).max())


def measures(text: str) -> tuple:
    """The values of ``FIELDS`` for a text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if line in seen and line.strip(SPACES):
            n_dup_lines += 1
            dup_line_chars += int(word_lengths(line).sum())
        else:
            seen.add(line)
    lengths = word_lengths(raw)
    total = int(lengths.sum())
    n_repeat, dup, top = 0, dict.fromkeys(DUPLICATED, 0), dict.fromkeys(TOP, 0)
    if n >= 2:
        h = word_hashes(words)
        before = np.zeros(n + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        at, rolled = np.arange(n), h  # the places that are left, and a hash of the words from there on
        for m in range(2, max(DUPLICATED) + 1):
            inside = at + m <= n
            at = at[inside]
            rolled = rolled[inside] * ROLL + h[at + m - 1]
            order, same = _groups(mix(rolled))
            if not same.any():
                break
            twice = np.zeros(len(order), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            if m == 3:
                n_repeat = int(_covered(at[twice], 3, n).sum())
            if m in TOP:
                top[m] = _top(at[order], same, m, before)
            if m in DUPLICATED:
                dup[m] = int(lengths[_covered(at[order[1:][same]], m, n)].sum())
            at, rolled = at[twice], rolled[twice]
    base_failed = n < MIN_WORDS or 100 * n_repeat > 50 * n
    bad = (
        base_failed
        or any(dup[m] > share * total for m, share in DUPLICATED.items())
        or any(top[m] > share * total for m, share in TOP.items())
        or dup_line_chars > LINES * total
    )
    return n, total, n_symbols, n_dup_lines, n_repeat, base_failed, not bad, dup_line_chars, list(dup.values()), list(top.values())


def measure(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and the measures and verdict of each row's text; columns as in ``FIELDS``."""
    return map_texts(df, id_col, text, FIELDS, _measures)


def _measures():
    return measures


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with all columns."""
    return keep_rows(df, text, _verdict)


def _verdict():
    return lambda t: measures(t)[6]


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure(documents(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ",") for c in ("dup_ngram_chars", "top_ngram_chars")})


QUERIES = {"op2_repetition": op2_repetition}


def _sql() -> str:
    over = " OR ".join([*(f"dup[{i}] > {share}::DOUBLE * word_chars" for i, share in enumerate(DUPLICATED.values(), 1)), *(f"top[{i}] > {share}::DOUBLE * word_chars" for i, share in enumerate(TOP.values(), 1))])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT r, list(upto ORDER BY i) AS p FROM (SELECT r, i, sum(c) OVER (PARTITION BY r ORDER BY i)::BIGINT AS upto FROM (SELECT r, i, CASE WHEN i = 0 THEN 0 ELSE length(w[i]) END AS c FROM (SELECT r, w, unnest(range(0, len(w) + 1)) AS i FROM d))) GROUP BY r),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS o FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
lines AS (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS dup_line_chars FROM l WHERE o > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, m, i, hash(array_to_string(w[i:i + m - 1], ' ')) AS k FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, range(2, {max(DUPLICATED) + 1}) AS s(m))),
c AS (SELECT r, m, i, k, count(*) OVER (PARTITION BY r, m, k) AS n, lag(i) OVER (PARTITION BY r, m, k ORDER BY i) AS before FROM g),
rep AS (SELECT r, sum(least(3, i - coalesce(prev, i - 3)))::BIGINT AS n_repeat_words FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM c WHERE m = 3 AND n > 1) GROUP BY r),
dup AS (SELECT r, m, sum(p[i + m] - p[greatest(i, coalesce(prev + m, 0))])::BIGINT AS v FROM (SELECT r, m, i, lag(i) OVER (PARTITION BY r, m ORDER BY i) AS prev FROM c WHERE m >= {min(DUPLICATED)} AND before IS NOT NULL) JOIN p USING (r) GROUP BY r, m),
top AS (SELECT r, m, max(v) AS v FROM (SELECT r, m, k, n, max(n) OVER (PARTITION BY r, m) AS most, v FROM (SELECT r, m, k, n, sum(p[i + m] - p[greatest(i, coalesce(before + m, 0))])::BIGINT AS v FROM c JOIN p USING (r) WHERE m <= {max(TOP)} AND n > 1 GROUP BY r, m, k, n)) WHERE n = most GROUP BY r, m),
dups AS (SELECT r, list(coalesce(v, 0) ORDER BY m) AS dup FROM (SELECT r, m FROM d, range({min(DUPLICATED)}, {max(DUPLICATED) + 1}) AS s(m)) LEFT JOIN dup USING (r, m) GROUP BY r),
tops AS (SELECT r, list(coalesce(v, 0) ORDER BY m) AS top FROM (SELECT r, m FROM d, range({min(TOP)}, {max(TOP) + 1}) AS s(m)) LEFT JOIN top USING (r, m) GROUP BY r),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, p[len(w) + 1] AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, dup, top
 FROM d JOIN p USING (r) JOIN dups USING (r) JOIN tops USING (r) LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {over} OR dup_line_chars > {LINES}::DOUBLE * word_chars) AS kept, dup_line_chars, array_to_string(dup, ',') AS dup_ngram_chars, array_to_string(top, ',') AS top_ngram_chars FROM b
"""


ORACLE = {"op2_repetition": _sql()}
