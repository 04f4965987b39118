"""Quality classifier: a text classifier's evidence with hierarchical empirical Bayes over hosts and paths.

A logistic regression on a few measures of each text is fitted to at most ``SAMPLE`` labelled rows, those with the
least hashes of their ids; the bound is a parameter. It gives every document a probability p. Sites' rates are
shrunk: a host's rate goes towards the global mean with the weight of ``k1`` documents, a path's towards
its host's rate with that of ``k2``, where k1 and k2 follow from how much rates vary between sites beyond chance
(method of moments), over all documents. A document's own p is left out of its sites' sums. Its posterior has the
odds of p with the global prior odds replaced by its path's.

Sums by host and path are aggregated before the shuffle; what the driver gets are the sample and a few totals.

Cases: null and empty texts have measures of 0; null hosts and paths are sites as others; a site of one document has its
parent's rate; without labels of both kinds the classifier gives every document ``PRIOR``; repeated rows count as often
as they occur and get equal results; labels of a document that repeat with ties count each; an empty table gives an empty one;
very long texts are held once; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import cut, discard, documents, map_texts
from waymark.llm.repetition import measures

SAMPLE = 20_000
PRIOR, KEEP = 0.5, 0.5
MOST_WEIGHT = 1000.0

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "digits", "marks", "capitals", "lines", "endings", "rare_bytes", "distinct", "dup5", "top2", "long_words", "one_letter")
_DIGITS, _MARKS, _CAPITALS = bytes(range(48, 58)), bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), bytes(range(65, 91))


def features(text: str) -> tuple:
    """The values of ``FEATURES``, one double each."""
    n, chars, symbols, dup_lines, repeats, _, _, dup_chars, dup, top = measures(text)
    if not n:
        return (0.0,) * len(FEATURES)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda table: (len(raw) - len(raw.translate(None, table))) / len(raw)
    size = np.fromiter(map(len, words), np.int64, n)
    return (
        float(np.log1p(n)),
        chars / n,
        float(np.sqrt(symbols / len(raw))),
        dup_chars / chars,
        repeats / n,
        share(_DIGITS),
        share(_MARKS),
        share(_CAPITALS),
        float(np.log1p(len(raw) / max(1, len(lines)))),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        1 - len(text.encode("ascii", "ignore")) / len(text),
        float(len(set(words)) / n),
        dup[0] / chars,
        top[0] / chars,
        float((size > 20).mean()),
        float((size == 1).mean()),
    )


def _features():
    return features


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the constant last; of features as they are, fitted on standardized ones."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def measured(df: DataFrame, text: str, id_col: str, host: Column, path: Column) -> DataFrame:
    """(id, host, path, one column of each feature); features come with the row's site, so no join is needed."""
    site = df.select(F.struct(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path")).alias("row"), F.col(text).alias("text"))
    out = map_texts(site, "row", "text", ", ".join(f"{f} double" for f in FEATURES), _features)
    return cut(out.select("row.*", *FEATURES), "features")


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights from at most ``sample`` rows with labels (columns id, label of 0 or 1); None without both kinds."""
    known = rows.join(labels.select("id", F.col("label").cast("double").alias("label")).where("label is not null"), "id")
    got = known.orderBy(F.xxhash64("id"), "id", "label", *FEATURES).limit(sample).select("label", *FEATURES).toArrow()
    y = got["label"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.column_stack([got[f].to_numpy() for f in FEATURES]), y)


def _strength(sites: DataFrame, mean: str) -> float:
    """The weight, in documents, of the parent's rate: from sites' n, s (sum of p) and their parent's rate ``mean``."""
    m = F.col(mean)
    got = sites.agg(F.sum((F.col("s") - F.col("n") * m) ** 2 / F.col("n")).alias("between"), F.sum(m * (1 - m)).alias("chance"), F.sum((F.col("n") - 1) * m * (1 - m)).alias("room")).first()
    # E[(s - n m)^2 / n] = m (1 - m) (1 + (n - 1) / (k + 1)) if rates are Beta with weight k.
    extra = (got["between"] or 0.0) - (got["chance"] or 0.0)
    if extra <= 0 or not got["room"]:
        return MOST_WEIGHT
    return float(min(MOST_WEIGHT, max(1.0, got["room"] / extra - 1)))


def shrink(scored: DataFrame, keep: float = KEEP) -> DataFrame:
    """(id, p, p_host, p_path, p_quality, kept) from a written table (id, host, path, p): the posteriors of sites and documents."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(1 - 1e-6, max(1e-6, (total["s"] or 0.0) / total["n"])) if total["n"] else PRIOR
    k1 = _strength(hosts.withColumn("mean", F.lit(mean)), "mean")
    hosts = hosts.withColumn("rate", (k1 * F.lit(mean) + F.col("s")) / (k1 + F.col("n")))
    named = hosts.select(F.col("host").alias("of"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), "rate")
    sites = cut(paths.join(named, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "sites")
    discard(paths)
    k2 = _strength(sites, "rate")

    site = sites.select(F.col("host").alias("h"), F.col("path").alias("t"), "n", "s", "host_n", "host_s")
    one = scored.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("t")))
    p_host = (k1 * F.lit(mean) + F.col("host_s") - F.col("p")) / (k1 + F.col("host_n") - 1)
    one = one.withColumn("p_host", p_host)
    one = one.withColumn("p_path", (k2 * F.col("p_host") + F.col("s") - F.col("p")) / (k2 + F.col("n") - 1))
    inside = lambda c: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), c))
    odds = lambda c: inside(c) / (1 - inside(c))
    ratio = odds(F.col("p")) / (mean / (1 - mean)) * odds(F.col("p_path"))
    one = one.withColumn("p_quality", ratio / (1 + ratio))
    return one.select("id", "p", "p_host", "p_path", "p_quality", (F.col("p_quality") >= keep).alias("kept"))


def classify(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", host: Column | None = None, path: Column | None = None, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """``id_col``, p_text, p_host, p_path, p_quality and kept (p_quality of at least ``keep``) of each row.

    ``labels`` has columns id and label. Hosts and paths default to the columns source and lang.
    """
    rows = measured(df, text, id_col, F.col("source") if host is None else host, F.col("lang") if path is None else path)
    weights = train(rows, labels, sample)
    if weights is None:
        p = F.lit(PRIOR)
    else:
        logit = sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights)), F.lit(float(weights[-1])))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    scored = cut(rows.select("id", "host", "path", p.alias("p")), "scored")
    discard(rows)
    return shrink(scored, keep).withColumnsRenamed({"id": id_col, "p": "p_text"})


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return classify(documents(spark, sf_dir), labels)


QUERIES = {"op6_site_quality": op6_site_quality}
