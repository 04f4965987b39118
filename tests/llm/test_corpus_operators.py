"""Operators that look at the whole corpus, and the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import fixture_rows, frame, jaccard_components, removed_words, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import classifier, graph, jaccard, mixing, repetition, substring

ROWS = fixture_rows()


# op6

def test_classifier(spark):
    rng = random.Random(3)
    good = lambda: " ".join(f"word{rng.randrange(500)}" for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(["#", "$$", "buy", "100%"]) for _ in range(80))
    rows = [(i, good() if i % 2 else bad(), f"host{i % 4}" if i % 5 else None, "p") for i in range(400)] + [(1000, None, "host0", None), (1001, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("p", F.lit("clash")).withColumn("n", F.lit(0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "id bigint, label int")
    out = {r.doc_id: r for r in classifier.classify(df, labels).collect()}
    assert len(out) == len(rows)
    assert sum(out[i].kept == bool(i % 2) for i in range(200, 400)) >= 190
    assert all(0 <= r.p_quality <= 1 for r in out.values())
    none = classifier.classify(df, labels.where("label = 1")).collect()
    assert {round(r.p_text, 6) for r in none} == {classifier.PRIOR}
    assert classifier.classify(df.limit(0), labels).count() == 0


def brute_shrink(rows, keep=classifier.KEEP):
    """(id, p_host, p_path, p_quality, kept) of rows (id, host, path, p), by the formulas."""

    def strength(sites):
        between = sum((s - n * m) ** 2 / n for n, s, m in sites) - sum(m * (1 - m) for _, _, m in sites)
        room = sum((n - 1) * m * (1 - m) for n, _, m in sites)
        return classifier.MOST_WEIGHT if between <= 0 or not room else min(classifier.MOST_WEIGHT, max(1.0, room / between - 1))

    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for _, h, t, p in rows:
        for table, k in ((hosts, h), (paths, (h, t))):
            table[k][0] += 1
            table[k][1] += p
    mean = sum(r[3] for r in rows) / len(rows)
    k1 = strength([(n, s, mean) for n, s in hosts.values()])
    rate = {h: (k1 * mean + s) / (k1 + n) for h, (n, s) in hosts.items()}
    k2 = strength([(n, s, rate[h]) for (h, _), (n, s) in paths.items()])
    out = []
    for i, h, t, p in rows:
        p_host = (k1 * mean + hosts[h][1] - p) / (k1 + hosts[h][0] - 1)
        p_path = (k2 * p_host + paths[h, t][1] - p) / (k2 + paths[h, t][0] - 1)
        odds = p / (1 - p) / (mean / (1 - mean)) * p_path / (1 - p_path)
        out.append((i, round(p_host, 9), round(p_path, 9), round(odds / (1 + odds), 9), odds / (1 + odds) >= keep))
    return Counter(out)


@pytest.mark.parametrize("spread", [0.0, 0.35])
def test_shrinkage(spark, spark_folder, spread):
    """Sites with and without rates of their own, sparse and null ones, against the formulas."""
    rng = random.Random(7)
    base = {h: 0.5 + spread * rng.uniform(-1, 1) for h in ["a", "b", "c", None, *map(str, range(30))]}
    rows = [(i, h, rng.choice(["x", "y", None]), min(0.99, max(0.01, rng.gauss(base[h], 0.1)))) for i in range(800) for h in [rng.choice(list(base)) if i % 3 else "a"]]
    rows += [(900, "alone", "x", 0.9), (901, "a", "x", 0.4), (901, "a", "x", 0.4)]
    spark.createDataFrame(rows, "id bigint, host string, path string, p double").write.parquet(f"{spark_folder}/p{spread}")
    got = classifier.shrink(spark.read.parquet(f"{spark_folder}/p{spread}")).collect()
    assert Counter((r.id, round(r.p_host, 9), round(r.p_path, 9), round(r.p_quality, 9), r.kept) for r in got) == brute_shrink(rows)


@pytest.fixture
def spark_folder(tmp_path):
    return str(tmp_path)


def test_classifier_cases(spark):
    """Labels that repeat and contradict each other, repeated rows, a very long text."""
    rows = [(i, f"plain words number {i} " * 20, "h", "p") for i in range(20)] + [(50, "x " * 100_000, "h", "p"), (51, "same row here", "h", "p"), (51, "same row here", "h", "p")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i % 20, i // 20 % 2) for i in range(60)] + [(7, None), (99, 1)], "id bigint, label int")
    out = classifier.classify(df, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows) and all(0 <= r.p_quality <= 1 for r in out)
    assert len({(r.p_text, r.p_quality, r.kept) for r in out if r.doc_id == 51}) == 1
    again = classifier.classify(df.repartition(5), labels.repartition(3)).collect()
    assert {r.doc_id: round(r.p_quality, 9) for r in again} == {r.doc_id: round(r.p_quality, 9) for r in out}


def test_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) * [1, 10, 0.1]
    y = (x[:, 0] + x[:, 1] / 10 > 0).astype(float)
    w = classifier.fit(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == y).mean() > 0.97


# op8

def check_removed(spark, rows, **how):
    got = Counter(tuple(r) for r in substring.map_repeats(frame(spark, rows, True), substring.DIGESTS, substring._digests, **how).collect())
    assert got == Counter((i, n, k, sha(kept)) for i, n, k, kept in removed_words(rows, how.get("width", substring.WIDTH)))


def test_substring(spark):
    check_removed(spark, [*ROWS, (None, ROWS[10][1]), (None, ROWS[30][1])])


def test_substring_hot(spark, monkeypatch):
    """Anchors of many pieces, cut to windows."""
    monkeypatch.setattr(substring, "HOT", 3)
    check_removed(spark, ROWS)


@pytest.mark.parametrize("seed", range(3))
def test_substring_random(spark, seed):
    rng = random.Random(seed)
    parts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(3, 25))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 6)))) for i in range(40)]
    check_removed(spark, rows, width=12, gram=4)


def test_remove_keeps_columns(spark):
    df = frame(spark, ROWS, True)
    out = substring.remove_repeats(df)
    assert out.columns == df.columns
    want = {}
    for (i, t), (_, _, gone, kept) in zip(ROWS, removed_words(ROWS)):
        want.setdefault(i, []).append(kept.decode() if gone else t)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=4), st.text("ab", max_size=20))
def test_automaton(refs, query):
    a = substring.SuffixAutomaton()
    for r in refs:
        a.add(r)
    for end, size in enumerate(a.matching(query), 1):
        longest = max(n for n in range(end + 1) if any(query[end - n : end] in r for r in refs))
        assert size == longest


# op9

def test_targets():
    t = mixing.targets([10, 10, 10], [5, 2, 1])
    assert sum(t) == pytest.approx(45) and max(t) <= 20 and t[0] == 20
    assert t[1] / t[2] == pytest.approx(2) or t[1] == 20
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 1]) == [0.0, 0.0]


def test_tree():
    s = mixing.split_tree([100, 7, 0, 50], 8)
    assert s.sum(axis=0).tolist() == [100, 7, 0, 50] and set(s.sum(axis=1)) <= {19, 20}
    assert (s == mixing.split_tree([100, 7, 0, 50], 8)).all()


def sourced(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(["a", "b", None, "é", "z"]) if i % 3 else "hot") for i in range(900)]
    rows += [(5000, None, "a"), (5000, None, "a"), (5001, "x y z", "hot"), (5001, "x y z", "hot"), (None, "no id here", "b")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_mix(spark):
    df = sourced(spark)
    plan = mixing.plan(df).collect()
    assert len(plan) == df.count()
    total, taken, target, size = sum(r.size for r in plan), defaultdict(int), {}, {}
    for r in plan:
        assert len(r.draws) <= 2 and all(0 <= d < mixing.SHARDS for d in r.draws)
        taken[r.source] += len(r.draws) * r.size
        target[r.source], size[r.source] = r.target, r.source_size
    assert sum(target.values()) == pytest.approx(1.5 * total)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]))
    assert all(abs(taken[s] - target[s]) <= 30 for s in order)
    again = mixing.plan(df.repartition(3)).collect()
    assert Counter(map(str, plan)) == Counter(map(str, again))
    mixed = mixing.mix(df)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.id for r in plan for _ in r.draws)
    assert Counter(r.shard for r in mixed.collect()) == Counter(d for r in plan for d in r.draws)
    assert mixed.columns == [*df.columns, "shard", "place"]


def test_draws_by_hand(spark):
    """Each shard's draws are the blocks that its quota of the source's permutation says, worked out one by one."""
    df = sourced(spark).where("source is not null")
    plan = mixing.plan(df)
    rows = plan.groupBy("source").count().withColumnRenamed("count", "rows")
    rows = plan.join(rows, "source").withColumn("n", F.expr(f"greatest(1, least({mixing.BLOCKS}, floor(rows / {mixing.BLOCK_ROWS})))"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("th", F.lit(mixing.SEED)), "n")).withColumn("turn", F.xxhash64(F.col("block").cast("int"), F.lit(mixing.SEED + 1))).collect()
    sources, quota = sorted({r.source for r in rows}), {}
    blocks = {s: sorted({(r.turn, r.block) for r in rows if r.source == s}) for s in sources}
    for s in sources:  # whole passes, then blocks while there is room
        own = [r for r in rows if r.source == s]
        passes = int(own[0].target // own[0].source_size)
        room, n = own[0].target - passes * own[0].source_size, 0
        for turn, b in blocks[s]:
            if room <= 0:
                break
            n, room = n + 1, room - sum(r.size for r in own if r.block == b)
        quota[s] = passes * len(blocks[s]) + n
    shares = {s: np.zeros(mixing.SHARDS, int) for s in sources}
    for s in sources:
        place = {b: k for k, (_, b) in enumerate(blocks[s])}
        turns = {}
        for r in rows:
            if r.source == s:
                turns.setdefault(place[r.block], set()).add(tuple(r.draws))
        drawn = {}
        for k, found in turns.items():
            longest = max(found, key=len)
            assert all(f == longest[: len(f)] for f in found) and (len(found) == 1 or k == (quota[s] - 1) % len(turns))
            for p, shard in enumerate(longest):
                drawn[p * len(turns) + k] = shard
        assert sorted(drawn) == list(range(quota[s]))
        order = [drawn[t] for t in range(quota[s])]
        assert order == sorted(order)  # a shard's draws follow each other, so they are disjoint
        shares[s] += np.bincount(order, minlength=mixing.SHARDS)
    totals = sum(shares.values())
    assert totals.sum() == sum(quota.values()) and totals.max() - totals.min() <= 1


def test_mix_follows_the_tree(spark, monkeypatch):
    """With another tree other shards draw, and a tree that draws less makes a smaller mix."""
    df = sourced(spark)
    before = {(r.id, r.th): tuple(r.draws) for r in mixing.plan(df).collect()}
    whole = mixing.split_tree
    first = lambda quotas, shards, *a: np.eye(shards, 1, dtype=np.int64) * np.asarray(quotas, np.int64)
    monkeypatch.setattr(mixing, "split_tree", first)
    one = {(r.id, r.th): tuple(r.draws) for r in mixing.plan(df).collect()}
    assert {d for v in one.values() for d in v} == {0} and one != before
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, *a: whole(quotas, *a) // 2)
    assert sum(len(r.draws) for r in mixing.plan(df).collect()) < sum(map(len, before.values()))


def test_tree_of_groups():
    """Sources drawn group by group have the groups' totals; draws of more than numpy allows keep theirs."""
    top = mixing.split_tree([60, 40], 8)
    inside = mixing.split_tree([10, 20, 30], 8, (1, 2), top[:, 0])
    assert inside.sum(axis=0).tolist() == [10, 20, 30] and (inside.sum(axis=1) == top[:, 0]).all()
    many = mixing.split_tree([3 * 10**9, 10**9, 5], 4)
    assert many.sum(axis=0).tolist() == [3 * 10**9, 10**9, 5] and set(many.sum(axis=1)) <= {1_000_000_001, 1_000_000_002}


def test_mix_cases(spark):
    """Names that clash, sources of size 0, repeated rows that differ elsewhere, a very long text, empty tables."""
    rows = [(i, f"a b c {i}", "s", i, "k") for i in range(300)] + [(i, None if i % 2 else " ", "none", i, "k") for i in range(300, 340)]
    rows += [(400, "twice the same", "s", 1, "k"), (400, "twice the same", "s", 2, "k"), (500, "w " * 200_000, "long", 3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int, k string").toDF("doc_id", "text", "source", "draws", "_key")
    df = df.selectExpr("*", "1 as shard", "2 as place", "3 as _time", "4 as key", "5 as _0", "6 as block", "7 as times")
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "shard", "place"]
    out = mixed.toDF(*(f"c{i}" for i in range(len(mixed.columns)))).collect()
    assert all((r.c5, r.c6, r.c7, r.c8, r.c9, r.c10, r.c11) == (1, 2, 3, 4, 5, 6, 7) for r in out)
    assert not [r for r in out if r.c2 == "none"]  # nothing is taken of a source of size 0
    assert {(r.c0, r.c3) for r in out} <= {(r[0], r[3]) for r in rows} and max(Counter((r.c0, r.c3) for r in out).values()) <= 2
    assert mixing.in_order(mixed).count() == len(out)
    assert mixing.mix(df.limit(0)).count() == 0


def test_write_shards(spark, tmp_path):
    mixed = mixing.mix(sourced(spark))
    mixing.write_shards(mixed, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == mixed.count()


# op10

def check_components(spark, rows, **how):
    got = Counter(tuple(r) for r in jaccard.similar_components(frame(spark, rows, True), **how).collect())
    assert got == jaccard_components(rows, how.get("percent", 75))


def test_jaccard(spark):
    check_components(spark, [*ROWS, (None, "one two"), (None, "only here without id")])


@pytest.mark.parametrize("short, near, orders", [(2, 1, 0), (3, 2, 2)])
def test_jaccard_long_lists(spark, monkeypatch, short, near, orders):
    """With few neighbours at once, most links come from the later steps."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "NEAR", near)
    monkeypatch.setattr(jaccard, "ORDERS", orders)
    rng = random.Random(short)
    base = [[f"b{k}w{i}" for i in range(rng.randrange(20, 60))] for k in range(3)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    check_components(spark, rows)


def test_jaccard_salted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 2)
    check_components(spark, ROWS)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=700), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=600))
def test_vectors_bound_the_difference(common, left, right):
    a, b = (np.array(sorted(common | x), np.uint64) for x in (left, right))
    bound = jaccard.least_difference(jaccard.wide_vector(a), jaccard.wide_vector(b))
    assert bound <= len(set(a.tolist()) ^ set(b.tolist()))
    assert jaccard.least_difference(jaccard.wide_vector(a), jaccard.wide_vector(a)) == 0


def test_keep_one(spark):
    rows = [*ROWS, (None, "one two"), (None, "alone without id"), (None, "alone without id"), (6, "another text of the same id here")]
    df = frame(spark, rows, True)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    # Of each component the smallest id, rows without one last; texts without words stay.
    components = jaccard_components([(k, t) for k, (_, t) in enumerate(rows)])
    groups = defaultdict(list)
    for k, n, c in components:
        if n:
            groups[c].append(rows[k])
    least = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    want = Counter(r[0] for r in least) + Counter(i for i, t in rows if not (t or "").split())
    got = kept.select("doc_id", "text").collect()
    assert Counter(r.doc_id for r in got) == want
    assert Counter(r.text for r in got if r.doc_id == 6) == Counter(["one two three four", "another text of the same id here"])


@pytest.mark.parametrize("links, held", [(1 << 18, 600_000), (60, 600_000), (60, 40), (1 << 18, 1)])
def test_components(spark, monkeypatch, links, held):
    """However few links a task gets and however few nodes it joins up at once."""
    monkeypatch.setattr(graph, "LINKS", links)
    monkeypatch.setattr(graph, "HELD", held)
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_empty(spark):
    none = frame(spark, [])
    assert jaccard.similar_components(none).count() == 0 and substring.remove_repeats(none).count() == 0
    assert mixing.plan(none.withColumn("source", F.lit("a"))).count() == 0


# the pipeline

def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda k: " ".join(f"t{rng.randrange(3000)}" for _ in range(k))
    passage = text(70)
    rows = [(i, text(90) + (" " + passage if i % 4 == 0 else "")) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200 + i, rows[i][1] + " tail") for i in range(8)] + [(300, None), (301, "short"), (302, "a b c " * 40)]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    # Brute force: each stage by its definition.
    kept = [(i, t) for i, t in rows if repetition.measures(t or "")[6]]
    names = {i for i, _, c in jaccard_components(kept) if i == c}
    kept = [(i, t) for i, t in kept if i in names]
    cut = [(i, left.decode() if gone else t) for (i, t), (_, _, gone, left) in zip(kept, removed_words(kept))]
    source = {i: f"s{i % 3}" for i, _ in cut}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) <= names and max(times.values()) <= 2
    from waymark.llm import bytebpe

    own, texts = bytebpe.coder(), dict(cut)
    for r in out:
        ids = own.encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), sha(texts[r.doc_id].encode()))
    size = {i: len(t.split()) for i, t in cut}
    order = sorted(set(source.values()))
    goal = mixing.targets([sum(size[i] for i in size if source[i] == s) for s in order], [5, 2, 1])
    for s, g in zip(order, goal):
        assert abs(sum(n * size[i] for i, n in times.items() if source[i] == s) - g) <= 80
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_cases(spark, tmp_path):
    """Each stage on an empty table, and on rows with nulls, equal ids, empty and long texts, and columns whose names clash with those inside."""
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(k, text(k), "en", f"s{k % 2}", 1) for k in range(12)]
    rows += [(3, text(99), None, None, None), (None, text(98), "en", "s0", 1), (20, text(1), "de", "s1", 2), (21, None, None, "s0", 0), (22, "", "en", "s0", 0), (23, " ".join(f"l{i}" for i in range(30_000)), "en", "s1", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    more = df.selectExpr("*", "1 AS id", "2 AS th", "3 AS t1", "4 AS shard", "5 AS place", "6 AS spans", "7 AS whole", "8 AS _0", "9 AS draws", "10 AS key", "11 AS n", "12 AS sig", "13 AS root")
    for docs in (df.limit(0), more):
        now = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns, name
                out.write.parquet(f"{tmp_path}/{len(docs.columns)}{k}")
                now = spark.read.parquet(f"{tmp_path}/{len(docs.columns)}{k}")
                got = now.collect()
                assert all((r.id, r.th, r.shard, r.place, r.root) == (1, 2, 4, 5, 13) for r in got) if "th" in docs.columns else not got
                if got and name == "quality_rules":
                    assert Counter(r.doc_id for r in got) == Counter([*range(12), 3, None, 20, 23])
                if got and name == "ngram_jaccard":
                    assert Counter(r.doc_id for r in got) == Counter([*range(12), 3, None, 23])
            else:
                assert out.count() == now.count()
