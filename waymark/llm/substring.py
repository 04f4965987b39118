"""Removal of word sequences that repeat anywhere in a corpus, with suffix automata of shards of the corpus.

A window is ``width`` consecutive words. Each window has an anchor, its least hash of ``GRAM`` words (the
leftmost if equal), so equal windows have equal anchors. Consecutive windows with the same anchor make a
run, a piece of at most ``2 * width - GRAM`` words; no window stands in it twice.

1. Equal texts are one class. All windows of a class of two or more are repeats; it takes part below with one text, as a
   reference for others.
2. Two equal windows have an anchor and half of the other words in common, on its left or on its right side. These
   halves with the anchor, two keys a run at most, are counted, with sums in each batch first. The runs with a key that occurs twice or more are written as
   rows of numbers, with a digest of the piece. A piece (anchor and digest) that occurs twice has repeats only.
3. Only where an anchor has different pieces left their words are needed: each piece goes once to the shard of its anchor. The shard's
   suffix automaton counts the places of every substring. Its pieces are streamed through it, and where the
   matching statistic reaches ``width`` at a substring of two places or more, the window is a repeat. Anchors of over
   ``HOT`` different pieces have their windows counted one by one instead, so no shard is larger than ``HOT`` pieces.
4. Runs meet their piece's verdict and are gathered by text; the words that repeats cover are removed. Texts that certainly have
   none aren't shuffled.

The reference is the corpus itself, whose automata have no proven bound, so pieces are routed to the one shard that can match them
and the automata aren't broadcast. What is broadcast are bit filters that grow with what they hold up to a bound (32 MB); a false hit, or a full filter, costs work and has no effect on results. Anchors have 64-bit hashes, pieces and
texts 128 bits.

Cases: null and empty texts and texts shorter than a window have nothing removed; a text can repeat itself,
overlaps included; repeated rows are repeats of each other; ids aren't looked at, so rows without one or with the same are
as good as others; an empty table gives an empty one; a very long text is held once with the hashes of its words; other columns are
ignored by :func:`find_repeats` and passed on by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import cut, discard, documents, filter_of, may_hold, mix, python_batches, record, rolling, schemas, texts, word_hashes

WIDTH, GRAM = 35, 8
#: Different pieces that a shard holds at most.
HOT = 1500
#: Pieces that a task remembers as sent; forgetting costs rows, not results.
SEEN = 100_000


class SuffixAutomaton:
    """The substrings of the token sequences added so far, and how many places each has."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[int] = [0]

    def add(self, tokens) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in tokens:
            known = nxt[last].get(c)
            if known is not None:  # the sequence so far is there already, as part of another
                last = known if length[known] == length[last] + 1 else self._clone(last, c, known)
                self.ends[last] += 1
                continue
            state = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            self.ends.append(1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = state
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[state] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = state

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        own = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.ends.append(0)
        link[q] = own
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = own
            p = link[p]
        return own

    def places(self) -> list[int]:
        """By state, the number of places of its substrings."""
        out, link, length = self.ends.copy(), self.link, self.length
        for state in sorted(range(1, len(out)), key=length.__getitem__, reverse=True):
            out[link[state]] += out[state]
        return out

    def matching(self, tokens):
        """For each token, the length of the longest suffix up to it that is a substring here."""
        nxt, link, length = self.next, self.link, self.length
        at = size = 0
        for c in tokens:
            to = nxt[at].get(c)
            while to is None and at:
                at = link[at]
                size = length[at]
                to = nxt[at].get(c)
            if to is None:
                size = 0
            else:
                at, size = to, size + 1
            yield size

    def repeats(self, tokens, places: list[int], width: int):
        """For each token, whether the ``width`` tokens up to it are a substring with two places or more (of :meth:`places`)."""
        nxt, link, length = self.next, self.link, self.length
        at = size = 0
        for c in tokens:
            to = nxt[at].get(c)
            while to is None and at:
                at = link[at]
                size = length[at]
                to = nxt[at].get(c)
            if to is None:
                size = 0
                yield False
                continue
            at, size = to, size + 1
            if size < width:
                yield False
                continue
            while length[link[at]] >= width:  # what is longer than a window is of no interest
                at = link[at]
            size = min(size, length[at])
            yield places[at] > 1


def anchors(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, anchor hash, windows, place of the anchor) of each run; empty for a text without a window."""
    n = len(h) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    g, want = rolling(h, gram), width - gram + 1
    least, span = g, 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end = np.r_[begin[1:], n]
    place = begin + np.lib.stride_tricks.sliding_window_view(g, want)[begin].argmin(axis=1)
    late = end > place + 1
    if late.any():  # the same hash again, where the anchor has left the window
        parts = [(begin[~late], end[~late], place[~late])]
        for b, e in zip(begin[late].tolist(), end[late].tolist()):
            again = b + np.flatnonzero(g[b : e + want - 1] == least[b])
            first = np.r_[b, again[:-1] + 1]
            again, first = again[first < e], first[first < e]
            parts.append((first, np.r_[first[1:], e], again))
        begin, end, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(begin)
        begin, end, place = begin[order], end[order], place[order]
    return begin, g[place], end - begin, place


_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _known.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 12), np.uint64(base))
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1 << 20:
            _known[base] = known
    return known[:n]


class Digests:
    """64-bit hashes of any sequences of a text's words, from their hashes."""

    def __init__(self, h: np.ndarray):
        self.upto = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(_STEP, len(h)), out=self.upto[1:])

    def of(self, begin: np.ndarray, size) -> np.ndarray:
        """Of the sequences of ``size`` words that begin at ``begin``."""
        return mix((self.upto[begin + size] - self.upto[begin]) * _powers(_BACK, len(self.upto))[begin] + np.asarray(size).astype(np.uint64))


def keys_of(digests: Digests, begin, n, place, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of each run: a hash of the anchor with half of a window's other words before it, or after it, 0 if the piece has fewer."""
    half = (width - gram + 1) // 2
    out = []
    for first, whole in ((place - half, place - half >= begin), (place, place + gram + half <= begin + n + width - 1)):
        key = np.zeros(len(begin), np.uint64)
        key[whole] = digests.of(first[whole], gram + half)
        out.append(key)
    return out[0], out[1]


def _keyed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with positions as names, and 128 bits (t1, t2) that tell its texts apart."""
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    at = f"_{df.columns.index(text)}"
    return plain.select("*", F.xxhash64(at).alias("t1"), F.xxhash64(F.lit(7), at).alias("t2"))


def _longs(batch, name: str = "t1") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _parted(rows: DataFrame, held, hit: bool, key: str = "t1") -> DataFrame:
    """The rows whose key may be in the filter, or those whose key certainly isn't."""
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(shared.value, _longs(batch, key)) == hit))

    return rows.mapInArrow(run, rows.schema)


def _representatives(rows: DataFrame, copied) -> DataFrame:
    """(t1, t2, text, known) of each text that may have copies, once; ``known`` if it has some."""
    kind, arrow = schemas("t1 bigint, t2 bigint, text string, n bigint")
    shared = rows.sparkSession.sparkContext.broadcast(copied)

    def run(batches):
        for batch in batches:
            some = batch.filter(pa.array(may_hold(shared.value, _longs(batch))))
            count: dict = {}
            for k, key in enumerate(zip(some.column(0).to_pylist(), some.column(1).to_pylist())):
                count.setdefault(key, [k, 0])[1] += 1
            if count:
                first, n = zip(*count.values())
                once = some.take(pa.array(first))
                yield record(arrow, [*once.columns, list(n)])

    once = rows.mapInArrow(run, kind).groupBy("t1", "t2").agg(F.max("text").alias("text"), F.sum("n").alias("n"))
    return cut(once.select("t1", "t2", "text", (F.col("n") > 1).alias("known")), "representatives")


class _Corpus:
    """Each text once: a pass over the rows without those that may be copies, and over the representatives of these."""

    def __init__(self, rows: DataFrame, representatives: DataFrame, copied, width: int, gram: int):
        self.rows, self.representatives, self.width, self.gram = rows, representatives, width, gram
        self.copied = rows.sparkSession.sparkContext.broadcast(copied)

    def runs(self, fields: str, make) -> DataFrame:
        """``make()``'s function gets, for each text with windows, (t1, t2, known, words, hashes of words, and what :func:`anchors` gives) and gives columns."""""
        kind, arrow = schemas(fields)
        copied, width, gram = self.copied, self.width, self.gram

        def run(batches):
            f = make()
            for batch in batches:
                one = batch.filter(pa.array(_longs(batch, "representative") | ~may_hold(copied.value, _longs(batch))))
                found = []
                for t1, t2, known, t in zip(*(one.column(k).to_pylist() for k in range(4))):
                    words = t.encode().split()
                    if len(words) >= width:
                        h = word_hashes(words)
                        found.append(f(t1, t2, known, words, h, *anchors(h, width, gram)))
                found = [x for x in found if x is not None]
                if found:
                    yield record(arrow, [np.concatenate(c) if isinstance(c[0], np.ndarray) else [v for part in c for v in part] for c in zip(*found)])

        every = self.rows.select("t1", "t2", F.lit(False).alias("known"), "text", F.lit(False).alias("representative"))
        return every.union(self.representatives.select("t1", "t2", "known", "text", F.lit(True).alias("representative"))).mapInArrow(run, kind)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _key_counts(corpus: _Corpus) -> DataFrame:
    """(key) of the keys of runs that occur twice or more."""
    width, gram = corpus.width, corpus.gram

    def make():
        def count(t1, t2, known, words, h, begin, anchor, n, place):
            key, c = np.unique(np.concatenate(keys_of(Digests(h), begin, n, place, width, gram)), return_counts=True)
            return (_signed(key[key != 0]), c[key != 0])

        return count

    return corpus.runs("key bigint, places bigint", make).groupBy("key").agg(F.sum("places").alias("places")).where("places > 1").select("key")


def _hits(repeated, h, begin, anchor, n, place, width, gram):
    """The runs with a key that may occur twice: (begin, anchor, n, digest of the piece, digests of the text)."""
    digests = Digests(h)
    left, right = keys_of(digests, begin, n, place, width, gram)
    hit = (may_hold(repeated, left) & (left != 0)) | (may_hold(repeated, right) & (right != 0))
    begin, anchor, n = begin[hit], anchor[hit], n[hit]
    return begin, anchor, n, digests.of(begin, n + width - 1), digests


def _runs(corpus: _Corpus, repeated) -> DataFrame:
    """(t1, t2, known, start, windows, anchor, digest) of the runs that may have repeats."""
    width, gram, shared = corpus.width, corpus.gram, corpus.rows.sparkSession.sparkContext.broadcast(repeated)

    def make():
        def one(t1, t2, known, words, h, *runs):
            begin, anchor, n, digest, _ = _hits(shared.value, h, *runs, width, gram)
            if not len(begin):
                return None
            same = lambda v, kind: np.full(len(begin), v, kind)
            return same(t1, np.int64), same(t2, np.int64), same(known, bool), begin.astype(np.int32), n.astype(np.int32), _signed(anchor), _signed(digest)

        return one

    return corpus.runs("t1 bigint, t2 bigint, known boolean, start int, windows int, anchor bigint, digest bigint", make)


#: What tells a run apart from others of the same piece; :func:`_owner` is the same in numpy.
OWNER = "anchor ^ digest ^ t1 ^ shiftleft(cast(start as bigint), 36)"


def _owner(anchor, digest, t1, start):
    return _signed(anchor) ^ _signed(digest) ^ np.int64(t1) ^ (start.astype(np.int64) << 36)


def _parts(corpus: _Corpus, repeated, mixed, hot, owners) -> DataFrame:
    """What is looked at closely of anchors with different pieces, in two kinds of rows.

    (anchor, digest, body) of each piece, from the run that owns it (a few others may come too); of anchors with very many pieces
    (anchor, digest, t1, t2, known, start) of each window.
    """
    width, gram, shared = corpus.width, corpus.gram, corpus.rows.sparkSession.sparkContext.broadcast((repeated, mixed, hot, owners))

    def make():
        repeated, mixed, hot, owners = shared.value
        seen: set = set()

        def sent(anchor, digest):
            """Whether each piece has gone out before, as runs that share a bit with an owner come too."""
            if len(seen) > SEEN:
                seen.clear()
            new = list(zip(anchor.tolist(), digest.tolist()))
            out = np.array([k in seen for k in new], bool)
            seen.update(new)
            return out

        def one(t1, t2, known, words, h, *runs):
            begin, anchor, n, digest, digests = _hits(repeated, h, *runs, width, gram)
            single = may_hold(hot, anchor) if hot else np.zeros(len(anchor), bool)
            own = may_hold(mixed, anchor) & ~single & may_hold(owners, _owner(anchor, digest, t1, begin))
            own = np.flatnonzero(own)
            own = own[~sent(anchor[own], digest[own])]
            bodies = [b" ".join(words[a : a + k + width - 1]) for a, k in zip(begin[own].tolist(), n[own].tolist())]
            start = np.concatenate([np.arange(a, a + k) for a, k in zip(begin[single].tolist(), n[single].tolist())]) if single.any() else begin[:0]
            if not len(bodies) and not len(start):
                return None
            windows = digests.of(start, width)
            of = np.repeat(anchor[single], n[single])
            none, alone = [None] * len(bodies), [None] * len(start)
            filled = lambda v: [*none, *[v] * len(start)]
            return [*_signed(anchor[own]).tolist(), *_signed(of).tolist()], [*_signed(digest[own]).tolist(), *_signed(windows).tolist()], [*bodies, *alone], filled(t1), filled(t2), filled(known), [*none, *start.tolist()]

        return one

    return corpus.runs("anchor bigint, digest bigint, body binary, t1 bigint, t2 bigint, known boolean, start int", make)


def repeated_windows(pieces: list[list], width: int) -> list[int]:
    """A bit set for each of several different token sequences: bit i is set if the window that begins at token i occurs twice or more in all."""
    automaton = SuffixAutomaton()
    for tokens in pieces:
        automaton.add(tokens)
    places, out = automaton.places(), []
    for tokens in pieces:
        out.append(sum(1 << end - width + 1 for end, again in enumerate(automaton.repeats(tokens, places, width)) if again))
    return out


def _verdicts(bodies: DataFrame, width: int) -> DataFrame:
    """(anchor, digest, found) of the pieces with windows that other pieces of their shard have; found is a bit set. One anchor's pieces are held at a time."""
    kind, arrow = schemas("anchor bigint, digest bigint, found bigint")

    def run(batches):
        anchor, group, rows = None, {}, []

        def close():
            if len(group) > 1:
                for digest, bits in zip(group, repeated_windows([body.split() for body in group.values()], width)):
                    if bits:
                        rows.append((anchor, digest, bits))

        for batch in batches:
            for a, digest, body in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor:
                    close()
                    anchor, group = a, {}
                group[digest] = body
            if rows:
                yield record(arrow, list(zip(*rows)))
                rows.clear()
        close()
        if rows:
            yield record(arrow, list(zip(*rows)))

    return bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, kind)


def find_repeats(df: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(t1, t2, spans, whole) of the texts with repeats; t1 and t2 are Spark's xxhash64 of the text with seeds.

    Spans are pairs of start and a bit set of repeated windows from that word on; ``whole`` if all windows of the text are repeats.
    ``width - gram`` is at most 62.
    """
    python_batches(df.sparkSession)
    # A window of so many words takes so many characters at least.
    rows = _keyed(df.select(text), text).select("t1", "t2", F.col("_0").alias("text")).where(F.length("text") >= 2 * width - 1)
    copies = cut(rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t1", "t2"), "copies")
    copied = filter_of(copies, "t1")
    representatives = _representatives(rows, copied)
    corpus = _Corpus(rows, representatives, copied, width, gram)
    counts = cut(_key_counts(corpus), "keys")
    repeated = filter_of(counts, "key")
    discard(counts)
    runs = cut(_runs(corpus, repeated), "runs")
    # Different pieces of an anchor come from their counts; the owner is one run of a piece.
    pieces = cut(runs.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows"), F.min(F.expr(OWNER)).alias("owner")), "pieces")
    mixed = cut(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed")
    many = mixed.where(F.col("kinds") > HOT)
    hot = filter_of(many, "anchor") if many.take(1) else None
    parts = cut(_parts(corpus, repeated, filter_of(mixed, "anchor"), hot, filter_of(pieces, "owner")), "parts")
    found = cut(_verdicts(parts.where("body is not null").select("anchor", "digest", "body"), width), "verdicts")
    full = pieces.where("n > 1").select("anchor", "digest", F.expr("shiftleft(1L, windows) - 1").alias("found"))
    decided = cut(full.union(found).withColumn("key", F.expr("anchor ^ digest")), "decided")
    discard(mixed, pieces, found)
    places = _parted(runs.where("not known").withColumn("t", F.expr("anchor ^ digest")), filter_of(decided, "key"), True, "t").join(decided, ["anchor", "digest"]).select("t1", "t2", "start", "found")
    if hot:
        windows = parts.where("body is null")
        again = windows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "digest")
        places = places.union(windows.where("not known").join(again, ["anchor", "digest"]).select("t1", "t2", "start", F.lit(1).cast("bigint").alias("found")))
    spans = places.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "found")).alias("spans")).withColumn("whole", F.lit(False))
    out = cut(spans.unionByName(copies.withColumns({"spans": F.lit(None).cast(spans.schema["spans"].dataType), "whole": F.lit(True)})), "spans")
    discard(copies, representatives, runs, parts, decided)
    return out


def removed(n_words: int, spans, whole, width: int) -> np.ndarray:
    """Marks the words that repeated windows cover."""
    if whole:
        return np.full(n_words, n_words >= width)
    change = np.zeros(n_words + 1, np.int64)
    for span in spans or ():
        start, bits = span["start"], span["found"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            change[start + low] += 1
            change[start + low + width] -= 1
    return np.cumsum(change[:-1]) > 0


def _met(df: DataFrame, text: str, width: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` without repeats, rows that meet their spans), columns by position."""
    spans = find_repeats(df, text, width, gram)
    held, keyed = filter_of(spans, "t1"), _keyed(df, text)
    names = keyed.columns[:-2]
    met = _parted(keyed, held, True).join(spans, ["t1", "t2"], "left").select(*names, "spans", "whole")
    return _parted(keyed, held, False).select(names), met


def map_repeats(df: DataFrame, fields: str, make, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``id_col`` and ``fields`` of each row; ``make()`` gives a function from (text, words, marks of removed ones) to a tuple."""
    kind, arrow = schemas(f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {fields}")
    clean, met = _met(df.select(F.col(id_col), F.col(text)), text, width, gram)

    def run(batches):
        f = make()
        for batch in batches:
            out = []
            for t, s, whole in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = t.encode().split()
                out.append(f(t, words, removed(len(words), s, whole, width)))
            yield record(arrow, [batch.column(0), *(zip(*out) if out else [[]] * (len(arrow) - 1))])

    return clean.select("*", *(F.lit(None).cast(met.schema[c].dataType).alias(c) for c in ("spans", "whole"))).union(met).mapInArrow(run, kind)


def remove_repeats(df: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``df`` with the repeats cut out of ``text``: what is left of a text is joined by one space; texts without repeats are as they were."""
    clean, met = _met(df, text, width, gram)
    names, at = clean.columns, df.columns.index(text)

    def run(batches):
        for batch in batches:
            new = []
            for t, s, whole in zip(*(batch.column(k).to_pylist() for k in (at, len(names), len(names) + 1))):
                if s or whole:
                    words = np.array((t or "").encode().split(), object)
                    gone = removed(len(words), s, whole, width)
                    t = b" ".join(words[~gone].tolist()).decode() if gone.any() else t
                new.append(t)
            columns = [batch.column(i) if i != at else pa.array(new, batch.schema.field(at).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return clean.union(met.mapInArrow(run, clean.schema)).toDF(*df.columns)


DIGESTS = "n_words bigint, n_removed bigint, kept_sha256 string"


def _digests():
    def one(text, words, gone):
        kept = words if not gone.any() else np.array(words, object)[~gone].tolist()
        return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()

    return one


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_repeats(documents(spark, sf_dir), DIGESTS, _digests)


QUERIES = {"op8_substring_dedup": op8_substring_dedup}

ORACLE = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS win FROM t),
f AS (SELECT r, i, word, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS again FROM x),
g AS (SELECT r, i, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
}
