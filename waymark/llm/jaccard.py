"""Exact similarity join on word n-grams: components of documents whose n-gram sets have a Jaccard similarity of at least a bound.

Texts with equal sets form a class and are joined once. A class's n-grams are ordered rare first, by a
sketch of fixed size of document frequencies, then by hash; any common order gives right results, a
rare-first one gives few candidates. The sketch counts n-grams that repeat among the texts of a piece of a task. Two classes
over the bound share an n-gram among the first ``n - ceil(bound * n) + 1`` of each (prefix filter), so only these are
shuffled and joined, with a length filter and a positional filter. The suffix filter compares bit vectors in which each n-gram
flips one bit: sets differ in as many n-grams at least as the vectors do in bits. Short vectors of one length come first, then longer
ones for what is left. What is left is verified once per pair
with the whole sets.

A group of m near copies has m * m / 2 links; components need a few of them. So all pairs of an n-gram's list are
candidates only if it is short; of longer lists neighbours are verified first, in several orders. Pairs inside a component that
these links make need no verification, as they can't change the components, and in the end only pairs of different components are joined. No list, pair or
candidate is capped. Very frequent n-grams (by the sketch) are salted over several tasks in the first step, and in the
orders after it a list is dealt to groups of about ``DEALT`` rows by hash;
the joins can be split by adaptive execution. The filters of wanted documents grow with what they hold up to a bound; they save work
and have no effect on results.

Hashes have 64 bits; a class is identified by the sum of its hashes and its size.

Cases: a null text, an empty one or one without words has no n-grams and links with nothing; with fewer
words than ``n`` the whole sequence is one; repeated rows are one class and get the same component; equal
doc_ids and ties are ordered by hash; rows without a doc_id take part, but don't name a component; a component
whose rows all lack one has the component null; an empty table gives an empty one; a very long text is
held once with its hashes; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import cut, discard, documents, filter_of, may_hold, mix, python_batches, record, rolling, schemas, texts, word_hashes
from waymark.llm.graph import components

N, PERCENT = 5, 75
SKETCH_BITS = 22
#: A list that is longer than others by so many rows is dealt to several tasks.
SALT_ROWS = 50_000
#: 64-bit words of the suffix filter's vectors.
VECTOR = 8
#: N-grams that a task sorts at once to count those that repeat.
PIECE = 1 << 21
#: Classes of a list of which all pairs are candidates at once.
SHORT = 8
#: Orders of longer lists in which neighbours are candidates, after the first, and how near neighbours are.
ORDERS, NEAR = 2, 3
#: Rows of a long list that an order goes through in one group; longer lists are dealt to several.
DEALT = 256
#: Classes that a task remembers as seen, to send each once; forgetting costs rows, not results.
SEEN = 200_000


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``n`` words, A-Z in lower case; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(h) < n:
        return mix(rolling(h, len(h)) + np.uint64(len(h)))
    return np.unique(rolling(h, n))


def signature(s: np.ndarray) -> int:
    """A class's 64-bit id, as signed."""
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0


def prefix_length(n, percent: int = PERCENT):
    return n - (-(-percent * n // 100)) + 1


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def vector(s: np.ndarray, bits: int = 64 * VECTOR) -> np.ndarray:
    """The suffix filter's vector of a set, ``bits`` a power of 2: each element flips one bit."""
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def wide_vector(s: np.ndarray) -> bytes:
    """A vector of two to four bits an element."""
    return vector(s, max(64 * VECTOR, 1 << (2 * len(s)).bit_length())).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """What two wide vectors differ in; the larger is folded, as its elements' bits are the smaller's and more."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


BITS = [f"b{i}" for i in range(VECTOR)]


def _profiles(df: DataFrame, text: str, id_col: str, n: int) -> DataFrame:
    """A row of each document (id, th, n, sig, vector), and of each task's counts by bucket of the sketch (bucket, docs)."""
    kind, arrow = schemas(f"id {df.schema[id_col].dataType.simpleString()}, th bigint, n bigint, sig bigint, {', '.join(f'{b} bigint' for b in BITS)}, bucket int, docs bigint")

    def run(batches):
        counts, held, size = np.zeros(1 << SKETCH_BITS, np.int32), [], 0

        def count():
            nonlocal held, size
            s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            run = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]) if len(s) else np.zeros(1, np.int64)
            many = np.diff(run)
            often = many > 1
            np.add.at(counts, _bucket(s[run[:-1][often]]), many[often])
            held, size = [], 0

        for batch in batches:
            rows, bits = [], []
            for t in texts(batch.column(2)):
                s = shingles(t, n)
                held.append(s)
                size += len(s)
                rows.append((len(s), signature(s)))
                bits.append(vector(s))
                if size >= PIECE:
                    count()
            if rows:
                none = [None] * len(rows)
                yield record(arrow, [batch.column(0), batch.column(1), *zip(*rows), *np.stack(bits, axis=1), none, none])
        count()
        used = np.flatnonzero(counts)
        for a in range(0, len(used), 10_000):
            part = used[a : a + 10_000]
            none = [None] * len(part)
            yield record(arrow, [none] * (4 + VECTOR) + [part.tolist(), counts[part].tolist()])

    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).mapInArrow(run, kind)


def _prefixes(df: DataFrame, text: str, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(token, salt, sig, n, pos) of each class's first n-grams in the rare-first order."""
    kind, arrow = schemas("token bigint, salt int, sig bigint, n int, pos int")
    shared = df.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        counts, seen = shared.value, set()
        usual = int(np.partition(counts, len(counts) // 2)[len(counts) // 2])
        for batch in batches:
            parts = []
            for t in texts(batch.column(0)):
                s = shingles(t, n)
                if not len(s):
                    continue
                key = (signature(s), len(s))
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                c = counts[_bucket(s)].astype(np.int64)
                k = prefix_length(len(s), percent)
                first = np.argsort(c, kind="stable")[:k]
                salts = 1 + np.maximum(0, c[first] - usual) // max(SALT_ROWS, usual)
                parts.append((s[first].view(np.int64), np.where(salts > 1, 1 + key[0] % salts, 0), key[0], len(s)))
            if parts:
                size = [len(p[0]) for p in parts]
                yield record(
                    arrow,
                    [
                        np.concatenate([p[0] for p in parts]),
                        np.concatenate([p[1] for p in parts]).astype(np.int32),
                        np.repeat(np.array([p[2] for p in parts], np.int64), size),
                        np.repeat(np.array([p[3] for p in parts], np.int32), size),
                        np.concatenate([np.arange(k, dtype=np.int32) for k in size]),
                    ],
                )

    return df.select(text).mapInArrow(run, kind)


def _lists(prefixes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (n_x, sig_x, n_y, sig_y) of the lists of n-grams, and the rows (token, n, sig, pos) of the long lists.

    Of a list of up to ``SHORT`` classes all pairs go through the filters, of a longer one those of near neighbours.
    A task reads its rows in order, a few thousand at a time.
    """
    kind, arrow = schemas("n_x int, sig_x bigint, n_y int, sig_y bigint, token bigint, n int, sig bigint, pos int")

    def listed(a, done, was_long, end):
        """(batches, rows to go on with, how many of these were given, whether their list is long)."""
        token, salt, n, sig, pos = a
        size = len(token)
        begin = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
        length = np.diff(np.r_[begin, size])
        long = (length > SHORT) | (salt[begin] > 0)
        long[0] |= was_long
        stop = size if end or long[-1] else begin[-1]
        run = np.repeat(np.arange(len(begin)), length)
        reach = np.where(long, NEAR, SHORT)[run]
        pairs = []
        for d in range(1, max(NEAR, SHORT)):
            i = np.flatnonzero((run[d:] == run[:-d]) & (reach[d:] >= d))
            i = i[(i + d >= done) & (i + d < stop)]
            if not len(i):
                if d >= NEAR:
                    break
                continue
            j = i + d
            small, large = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
            ok = (100 * small >= percent * large) & ((100 + percent) * (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1).astype(np.int64)) >= percent * (small + large))
            pairs.append(np.stack([n[i][ok], sig[i][ok], n[j][ok], sig[j][ok]]))
        out = []
        if pairs:
            p = np.concatenate(pairs, axis=1)
            swap = (p[0] > p[2]) | (p[0] == p[2]) & (p[1] > p[3])
            p[:, swap] = p[[2, 3, 0, 1]][:, swap]
            p = p[:, np.lexsort(p)]
            p = p[:, np.r_[True, (p[:, 1:] != p[:, :-1]).any(axis=0)]] if p.shape[1] else p
            none = pa.nulls(p.shape[1])
            out.append(record(arrow, [pa.array(p[0]), pa.array(p[1]), pa.array(p[2]), pa.array(p[3]), none, none, none, none]))
        rows = np.flatnonzero(long[run])
        rows = rows[(rows >= done) & (rows < stop)]
        if len(rows):
            none = pa.nulls(len(rows))
            out.append(record(arrow, [none, none, none, none, *(pa.array(x[rows]) for x in (token, n, sig, pos))]))
        keep = max(stop - NEAR, begin[-1]) if long[-1] else stop
        return out, [x[keep:] for x in a], stop - keep, bool(long[-1])

    def run(batches):
        held, carry, done, long = [], None, 0, False

        def flush(end):
            nonlocal held, carry, done, long
            a = [np.concatenate([*([carry[k]] if carry is not None else []), *(h[k] for h in held)]) for k in range(5)]
            held = []
            if not len(a[0]):
                return []
            copy = np.r_[False, np.all([a[k][1:] == a[k][:-1] for k in range(4)], axis=0)]
            a = [x[~copy] for x in a]  # the same class may come from several tasks
            out, carry, done, long = listed(a, done, long, end)
            return out

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
            if len(held) >= 128:
                yield from flush(False)
        if held or carry is not None:
            yield from flush(True)

    ordered = prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "sig")
    return ordered.select("token", "salt", "n", "sig", "pos").mapInArrow(run, kind)


def _sets(df: DataFrame, text: str, id_col: str, n: int, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n, sig, wide, hashes) of the classes in ``pairs``, and perhaps of others."""
    ends = pairs.select("a.*").union(pairs.select("b.*")).distinct()
    keys = ends.join(classes.select("n", "sig", "id"), ["n", "sig"]).select(F.xxhash64("id").alias("key"))
    wanted = df.sparkSession.sparkContext.broadcast(filter_of(keys, "key", 2 * pairs.count()))
    kind, arrow = schemas("n int, sig bigint, wide binary, hashes binary")

    def run(batches):
        held, seen = wanted.value, set()
        for batch in batches:
            hit = may_hold(held, batch.column(0).to_numpy())
            rows = []
            for t in texts(batch.column(1).filter(pa.array(hit))):
                s = shingles(t, n)
                key = (len(s), signature(s))
                if not len(s) or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                rows.append((*key, wide_vector(s), s.tobytes()))
                if len(rows) == 64:
                    yield record(arrow, list(zip(*rows)))
                    rows = []
            if rows:
                yield record(arrow, list(zip(*rows)))

    return cut(df.select(F.xxhash64(id_col).alias("key"), F.col(text).alias("text")).mapInArrow(run, kind), "sets")


def _only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``sets`` for classes in ``pairs``, and perhaps a few others; nothing is shuffled."""
    ends = pairs.select("a.*").union(pairs.select("b.*")).select(F.xxhash64("n", "sig").alias("key"))
    wanted = sets.sparkSession.sparkContext.broadcast(filter_of(ends, "key", 2 * pairs.count()))

    def run(batches):
        for batch in batches:
            hit = may_hold(wanted.value, batch.column(0).to_numpy())
            yield batch.filter(pa.array(hit)).select(["n", "sig", "hashes"])

    return sets.select(F.xxhash64("n", "sig").alias("key"), "n", "sig", "hashes").mapInArrow(run, "n int, sig bigint, hashes binary")


def _compared(pairs: DataFrame, sets: DataFrame, column: str, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough by the whole sets (hashes), or may be by the wide vectors."""
    kind, arrow = schemas("a struct<n:int,sig:bigint>, b struct<n:int,sig:bigint>")
    side = lambda x: sets.select(F.struct("n", "sig").alias(x), F.col(column).alias(f"{x}_set"))

    def run(batches):
        for batch in batches:
            ok = []
            sizes = zip(*(batch.column(k).field("n").to_pylist() for k in (0, 1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for na, nb, x, y in sizes:
                if column == "wide":
                    ok.append((100 + percent) * least_difference(x, y) <= (100 - percent) * (na + nb))
                else:
                    common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                    ok.append((100 + percent) * common >= percent * (na + nb))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(k).cast(arrow.field(k).type) for k in (0, 1)], schema=arrow)

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    return both.mapInArrow(run, kind).distinct()


def _near(x: str, y: str, percent: int):
    """The length and positional filters of rows with columns named ``x`` and ``y`` after their own names."""
    small, large = f"least(n{x}, n{y})", f"greatest(n{x}, n{y})"
    return F.expr(f"100 * {small} >= {percent} * {large}") & F.expr(f"{100 + percent} * (1 + least(n{x} - pos{x} - 1, n{y} - pos{y} - 1)) >= {percent} * (n{x} + n{y})")


def _suffix(x: str, y: str, percent: int):
    """The suffix filter."""
    differ = " + ".join(f"bit_count({b}{x} ^ {b}{y})" for b in BITS)
    return F.expr(f"{100 + percent} * ({differ}) <= {100 - percent} * (n{x} + n{y})")


def _ends(x: str, y: str):
    """The classes of rows ``x`` and ``y``, the lesser first."""
    ends = [F.struct(F.col(f"n{k}").alias("n"), F.col(f"sig{k}").alias("sig")) for k in (x, y)]
    a, b = F.least(*ends), F.greatest(*ends)
    return a.n.alias("n_x"), a.sig.alias("sig_x"), b.n.alias("n_y"), b.sig.alias("sig_y")


def join_classes(df: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, stars): id, th (Spark's xxhash64 of the text), n, sig of ``df``'s rows, and (node, root) of classes that aren't the least of their component."""
    python_batches(df.sparkSession)
    profiles = cut(_profiles(df, text, id_col, n), "profiles")
    rows = profiles.where("bucket is null").select("id", "th", F.col("n").cast("int").alias("n"), "sig", *BITS)
    counts = profiles.where("bucket is not null").groupBy("bucket").agg(F.least(F.sum("docs"), F.lit(1 << 30)).cast("int").alias("docs")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    sketch[counts["bucket"].to_numpy()] = counts["docs"].to_numpy()
    classes = cut(rows.where("n > 0").groupBy("n", "sig").agg(F.min("id").alias("id"), *(F.min(b).alias(b) for b in BITS)), "classes")
    lists = cut(_lists(_prefixes(df, text, n, percent, sketch), percent), "lists")
    vectors = lambda k: classes.select(*(F.col(c).alias(f"{c}{k}") for c in ("n", "sig", *BITS)))
    side = lambda k, *more: [F.col(c).alias(f"{c}{k}") for c in ("n", "sig", *more)]

    def verified(pairs, old=None, filtered=False):
        """Links among candidate pairs (n_x, sig_x, n_y, sig_y), and ``old`` ones."""
        if not filtered:
            pairs = pairs.distinct().join(vectors("_x"), ["n_x", "sig_x"]).join(vectors("_y"), ["n_y", "sig_y"]).where(_suffix("_x", "_y", percent))
        pairs = cut(pairs.select(F.struct(F.col("n_x").alias("n"), F.col("sig_x").alias("sig")).alias("a"), F.struct(F.col("n_y").alias("n"), F.col("sig_y").alias("sig")).alias("b")), "pairs")
        sets = _sets(df, text, id_col, n, classes, pairs)
        close = cut(_compared(pairs, sets, "wide", percent), "close")
        found = _compared(close, _only(sets, close), "hashes", percent)
        links = cut(found if old is None else old.union(found), "links")
        discard(pairs, close, sets, *([] if old is None else [old]))
        return links

    links = verified(lists.where("token is null").select("n_x", "sig_x", "n_y", "sig_y"))
    stars = components(links)
    member = lists.where("token is not null").select("token", "n", "sig", "pos")
    for order in range(ORDERS + 1):
        # Only lists with more than one component are gone through again.
        roots = stars.select("node.*", "root")
        named = cut(member.drop("root").join(roots, ["n", "sig"], "left").withColumn("root", F.coalesce("root", F.struct("n", "sig"))), "named")
        mixed = named.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("rows")).where("r1 != r2").select("token", "rows")
        old, member = member, cut(named.drop("rows").join(mixed, "token"), "mixed")
        discard(named, *([old] if order else [lists]))
        if not member.take(1):
            break
        if order < ORDERS:
            # Each order deals a long list anew, so rows that one order keeps apart may meet in the next; the rest meets in the end.
            group = F.pmod(F.xxhash64("sig", "n", F.lit(order)), F.ceil(F.col("rows") / DEALT))
            window = Window.partitionBy("token", group).orderBy(F.xxhash64("n", "sig", F.lit(order)), "n", "sig")
            close = F.array(*(F.lag(F.struct("n", "sig", "pos", "root"), k).over(window) for k in range(1, NEAR + 1)))
            near = member.select(*side("_x", "pos", "root"), close.alias("near")).select("*", F.explode("near").alias("y"))
            near = near.select("*", *(F.col(f"y.{c}").alias(f"{c}_y") for c in ("n", "sig", "pos", "root")))
            links = verified(near.where("root_x != root_y").where(_near("_x", "_y", percent)).select(*_ends("_x", "_y")), links)
        else:
            full = cut(member.join(classes.drop("id"), ["n", "sig"]), "full")
            x, y = full.select(F.col("token").alias("tx"), *side("_x", "pos", "root", *BITS)), full.select(F.col("token").alias("ty"), *side("_y", "pos", "root", *BITS))
            apart = (F.col("tx") == F.col("ty")) & F.expr("root_x != root_y and (n_x < n_y or n_x = n_y and sig_x < sig_y)")
            pairs = x.join(y, apart & _near("_x", "_y", percent) & _suffix("_x", "_y", percent)).select("n_x", "sig_x", "n_y", "sig_y").distinct()
            links = verified(pairs, links, filtered=True)
            discard(full)
        discard(stars)
        stars = components(links)
    discard(member, links)
    rows = cut(rows.select("id", "th", "n", "sig"), "rows")
    discard(profiles, classes)
    return rows, stars


def similar_components(df: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``id_col``, n_shingles and component_id (the smallest id that links reach) of each row of ``df``."""
    rows, stars = join_classes(df, text, id_col, n, percent)
    classes = rows.where("n > 0").groupBy("n", "sig").agg(F.min("id").alias("id"))
    rooted = classes.join(stars.select("node.*", "root"), ["n", "sig"], "left").select("n", "sig", "id", F.coalesce("root", F.struct("n", "sig")).alias("root"))
    rooted = cut(rooted, "rooted")
    discard(stars)
    best = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(best, "root").select("n", "sig", "component_id")
    return rows.join(named, ["n", "sig"], "left").select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(df: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: that of the smallest id, rows without one last, then of the smallest hash of the text.

    Rows of the same id and text are one document and leave one row. Texts without words link with nothing and stay. Columns may have any names.
    """
    rows, stars = join_classes(df, text, id_col, n, percent)
    rooted = rows.where("n > 0").join(stars.select("node.*", "root"), ["n", "sig"], "left").withColumn("root", F.coalesce("root", F.struct("n", "sig")))
    chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "th")).alias("one"), F.count(F.lit(1)).alias("rows"))
    chosen = cut(chosen.select("one.id", "one.th", "rows"), "chosen")
    # Whether a chosen document has several rows.
    repeated = rows.join(chosen.where("rows > 1"), rows.id.eqNullSafe(chosen.id) & (rows.th == chosen.th), "left_semi").groupBy("id", "th").count().where("count > 1").take(1)
    discard(stars, rows)
    names = [f"_{i}" for i in range(len(df.columns))]
    key, at = names[df.columns.index(id_col)], names[df.columns.index(text)]
    keyed = df.toDF(*names).withColumn("th", F.xxhash64(at))
    kept = keyed.join(chosen, keyed[key].eqNullSafe(chosen.id) & (keyed.th == chosen.th), "left_semi")
    has_words = F.coalesce(F.col(at).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = kept.where(has_words)
    if repeated:
        kept = kept.dropDuplicates([key, "th"])
    return kept.unionByName(keyed.where(~has_words)).select(*names).toDF(*df.columns)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}

ORACLE = {
    "op10_ngram_jaccard": r"""
WITH RECURSIVE low AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM low),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM low UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
best AS (SELECT reach.a AS r, min(low.doc_id) AS component_id FROM reach JOIN low ON low.r = reach.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM low JOIN best USING (r) LEFT JOIN n USING (r)
"""
}
