"""Brute-force versions of what the operators compute, on rows (id, text)."""

import hashlib
from collections import Counter, defaultdict


def fixture_rows():
    """Rows with nulls, empty and short texts, copies, near copies, shared passages, ties and a long text."""
    base = [f"w{i % 37}x{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    near = lambda k, n: " ".join(w if (i * 7 + k) % n else f"{w}e{k}" for i, w in enumerate(base))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "One TWO"), (6, "one two three four"), (7, "a b c d e"), (8, "A B C D E")]
    rows += [(20 + k, " ".join(base)) for k in range(5)]
    rows += [(40 + k, near(k, 61)) for k in range(30)]
    rows += [(80 + k, f"begin{k} " + " ".join(f"u{k}v{i}" for i in range(20 + k)) + " " + passage + f" end{k}") for k in range(10)]
    rows += [(100, " ".join(["same"] * 100)), (101, "x y " * 60), (102, "line one here\nline one here\n\n\nline two #*$ <|> 100%\n" * 3)]
    rows += [(110, "Été à l'œuvre, naïve façade. 日本語 テスト 12ab é" + " mot" * 3), (111, "tab\tand\x0bvertical\x0cform\rfeed  nbsp　wide")]
    rows += [(120, " ".join(f"long{i % 5000}q" for i in range(30_000)))]
    rows += [(130, "tail words"), (130, "tail words"), (131, "see cc by 4 and GNU General Public License v3. All rights\nreserved")]
    return rows


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("*", "'src' as source", "'en' as lang", "1L as n_chars", "5L as n_words", "'x' as id", "1 as n", "'k' as token", "2 as sig", "'s' as size", "0 as th", "'p' as block") if extra else df


def shingle_set(t, n=5):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def jaccard_components(rows, percent=75):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(k)
    pairs = {(a, b) for ks in by.values() for b in ks for a in ks if a < b}
    for a, b in pairs:
        common = len(sets[a][1] & sets[b][1])
        if 100 * common >= percent * (len(sets[a][1]) + len(sets[b][1]) - common):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets))


def removed_words(rows, width=35):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k : k + width]) for _, w in docs for k in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()
