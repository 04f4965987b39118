"""Matching: inputs meet the index by their phrases, candidates are filtered, scored and ranked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import phrases, similarity, text


@dataclass(frozen=True)
class MatchSpec:
    """How to match; every matcher is one of these."""

    phrases: Callable[[Column], Column] = phrases.standard
    cap: int = 1000
    clean: Callable[[Column], Column] = text.clean_input
    numerics: Callable[[Column], Column] = text.numeric_tokens_input
    #: Share of input numerics that a candidate must have; None: all of one to three.
    overlap: float | None = 0.2
    score: str = "tokens"
    #: Candidates that go on to the score, the best by this measure; None: all.
    prefilter: str | None = "tokens"
    prefilter_n: int = 50
    keep_unmatched: bool = True


def _hashes(tokens: Column) -> Column:
    """64-bit hashes without copies, which are compared much faster than strings."""
    return F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))


#: What a measure needs of each side: made once an address, not once a pair.
FEATURES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "numerics": lambda address, numerics, alpha: _hashes(numerics),
    "number": lambda address, numerics, alpha: F.size(numerics),
    "copies": lambda address, numerics, alpha: _hashes(similarity.numbered(numerics)),
    "alpha": lambda address, numerics, alpha: _hashes(alpha),
    "grams": lambda address, numerics, alpha: _hashes(similarity.grams(address)),
    "text": lambda address, numerics, alpha: address,
}

#: Scores by name: the features, and the measure of columns given by feature and side.
SCORES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "tokens": (("alpha", "numerics"), lambda of: similarity.share_of_smaller(*of("alpha")) * similarity.jaccard_of_sets(*of("numerics"))),
    "jaro": (("text",), lambda of: similarity.jaro(*of("text"))),
    "jaro_overlap": (("text", "numerics"), lambda of: similarity.jaro(*of("text")) * similarity.share_of_first(*of("numerics"))),
    "ngram_overlap": (("grams", "numerics"), lambda of: similarity.jaccard_of_sets(*of("grams")) * similarity.share_of_first(*of("numerics"))),
    "ngram_overlap2": (("grams", "numerics"), lambda of: similarity.jaccard_of_sets(*of("grams")) * similarity.jaccard_of_sets(*of("numerics"))),
    "ngram_multiset": (("grams", "copies"), lambda of: similarity.jaccard_of_sets(*of("grams")) * similarity.jaccard_of_sets(*of("copies"))),
    "jaro_winkler": (("text",), lambda of: similarity.jaro_winkler(*of("text"))),
}


def _of(feature: str) -> tuple[Column, Column]:
    return F.col(f"a_{feature}"), F.col(f"b_{feature}")


def _score(kind: str) -> Column:
    return SCORES[kind][1](_of)


_LEGACY = MatchSpec(phrases=phrases.bigrams, clean=text.clean_input_unicode, numerics=text.numeric_tokens_legacy, overlap=0.5, score="ngram_overlap", prefilter=None)
_TRIGRAM = replace(_LEGACY, phrases=phrases.trigrams_of_input, cap=10_000)

#: Matchers by name: the current ones, then earlier forms. The index that each needs follows from its phrases.
CATALOGUE: dict[str, MatchSpec] = {
    "standard": MatchSpec(),
    "skipphrase": replace(_LEGACY, phrases=phrases.skips, score="jaro_overlap"),
    "trigram": _TRIGRAM,
    "soundex": replace(_LEGACY, phrases=phrases.sounds, cap=20_000, score="ngram_multiset"),
    "bigram_contained": replace(_LEGACY, overlap=None, score="jaro"),
    "bigram": _LEGACY,
    "bigram_union": replace(_LEGACY, score="ngram_overlap2"),
    "bigram_multiset": replace(_LEGACY, score="ngram_multiset"),
    "numeric_skip_multiset": replace(_LEGACY, phrases=phrases.standard, score="ngram_multiset"),
    "winkler": replace(_LEGACY, phrases=phrases.standard, score="ngram_multiset", prefilter="jaro_winkler"),
    "winkler_matched_only": replace(_LEGACY, phrases=phrases.standard, score="ngram_multiset", prefilter="jaro_winkler", keep_unmatched=False),
    "trigram_contained": replace(_TRIGRAM, overlap=None, score="jaro"),
    "trigram_contained_rare": replace(_TRIGRAM, cap=1000, overlap=None, score="jaro"),
}

#: The index that a matcher reads.
INDEX = {phrases.standard: "standard", phrases.bigrams: "bigram", phrases.skips: "skipphrase", phrases.sounds: "soundex", phrases.trigrams_of_input: "trigram"}


def prepared(inputs: DataFrame, spec: MatchSpec) -> DataFrame:
    """(address_id1, address, input_numerics, input_alpha_tokens) of inputs with address_id and address.

    Inputs are dealt by id first: each makes up to thousands of candidates, so a few files of them must not be a few tasks.
    """
    parts = int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cleaned = inputs.select(F.col("address_id").alias("address_id1"), "address").repartition(parts, "address_id1").select("address_id1", spec.clean(F.col("address")).alias("address"))
    return cleaned.withColumns({"input_numerics": spec.numerics(F.col("address")), "input_alpha_tokens": text.alpha_tokens(F.col("address"))})


def input_phrases(prepared_inputs: DataFrame, spec: MatchSpec) -> DataFrame:
    """(address_id1, key), each once: a phrase that repeats in an input finds nothing more."""
    found = F.array_distinct(F.array_compact(spec.phrases(text.split_tokens(F.col("address")))))
    return prepared_inputs.select("address_id1", F.explode(found).alias("key"))


def candidates(keys: DataFrame, postings: DataFrame) -> DataFrame:
    """(address_id1, address_id2), distinct: the ids that share a phrase with each input. ``postings`` is (key, addr_id).

    Pairs are dealt by address, so that the addresses' features meet them where they are.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = keys.join(postings, "key").select("address_id1", F.col("addr_id").alias("address_id2"))
    return pairs.repartition(parts, "address_id2").distinct()


def compared(pairs: DataFrame, prepared_inputs: DataFrame, detail: DataFrame, spec: MatchSpec) -> DataFrame:
    """Candidates that pass the filter on numerics, with what the scores need of both sides and nothing else."""
    needed = sorted({"numerics", "number"} | {f for kind in (spec.prefilter, spec.score) if kind for f in SCORES[kind][0]})
    sides = lambda x, *columns: [FEATURES[f](*columns).alias(f"{x}_{f}") for f in needed]
    mine = prepared_inputs.select("address_id1", *sides("a", F.col("address"), F.col("input_numerics"), F.col("input_alpha_tokens")))
    theirs = detail.select(F.col("addr_id").alias("address_id2"), *sides("b", F.col("addr"), F.col("numeric_tokens"), text.alpha_tokens(F.col("addr"))))
    a, b = _of("numerics")
    common, number = F.size(F.array_intersect(a, b)), F.col("a_number")
    # All of one to three input numerics, or a share of their number, copies counted.
    enough = number.between(1, 3) & (common == F.size(a)) if spec.overlap is None else (number > 0) & (common / number >= spec.overlap)
    keep = a.isNotNull() & b.isNotNull() & enough
    # By address first, then by input, where the ranking takes place too.
    return pairs.join(theirs, "address_id2").join(mine, "address_id1").where(keep)


def best(scored: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` best rows of each input, the lower id first where they tie."""
    order = Window.partitionBy("address_id1").orderBy(F.desc(by), "address_id2", *(["neighbour"] if "neighbour" in scored.columns else []))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def moved(found: DataFrame, detail: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``found`` once for each neighbour of the address's place, with the address moved there."""
    place = detail.select(F.col("addr_id").alias("address_id2"), F.col("addr").alias("address_matched"), "suburb", F.col("STATE").alias("state"), F.col("POSTCODE").alias("postcode"))
    near = neighbours.select("suburb_name", "state_name", F.col("postcode").alias("near_postcode"), F.col("neighbour_suburb_state_postcode").alias("neighbour"), "neighbouring_suburb_correction")
    found = found.join(place, "address_id2").join(near, (F.col("suburb") == F.col("suburb_name")) & (F.col("state") == F.col("state_name")) & (F.col("postcode") == F.col("near_postcode")))
    return found.withColumn("address_matched_ns", F.replace(F.col("address_matched"), F.concat_ws(" ", "suburb", "state", "postcode"), F.col("neighbour")))


def ranked(found: DataFrame, detail: DataFrame, spec: MatchSpec, top_n: int, neighbours: DataFrame | None = None) -> DataFrame:
    """(address_id1, address_id2, similarity) of the best by the prefilter, then the ``top_n`` best by the score; with neighbours also what they add."""
    first = spec.prefilter and (spec.prefilter != spec.score or neighbours is not None)
    if first:  # a measure that is both prefilter and score needs one ranking
        found = best(found.withColumn("first_score", _score(spec.prefilter)), "first_score", spec.prefilter_n).drop("rank")
    extra = []
    if neighbours is not None:
        found, extra = moved(found, detail, neighbours), NEAR
    score = F.col("first_score") if first and spec.prefilter == spec.score else _score(spec.score)
    tie = ["neighbour"] if extra else []
    return best(found.select("address_id1", "address_id2", score.alias("similarity"), *extra, *tie), "similarity", top_n)


#: Columns that neighbours add: whether the suburb is another one, and the address with its place put in.
NEAR = ["neighbouring_suburb_correction", "address_matched_ns"]

OUTPUT = ["address_id2", "address_matched", "suburb", "postcode", "latitude", "longitude", "similarity", "match_numerics", "match_alpha_tokens"]


def match(inputs: DataFrame, detail: DataFrame, postings: DataFrame, spec: MatchSpec | str = "standard", top_n: int = 1, neighbours: DataFrame | None = None) -> DataFrame:
    """The ``top_n`` best addresses of each input; inputs without one keep a row of nulls.

    ``inputs`` has address_id and address, ``detail`` is the reference table, each id once, ``postings`` (key, addr_id) of phrases below the cap.
    Candidates are pairs of ids with hashed tokens; texts and places are joined to the chosen ones alone.
    """
    spec = CATALOGUE[spec] if isinstance(spec, str) else spec
    own = prepared(inputs, spec)
    found = compared(candidates(input_phrases(own, spec), postings), own, detail, spec)
    return named(own, ranked(found, detail, spec, top_n, neighbours), detail, spec, neighbours is not None)


def named(own: DataFrame, chosen: DataFrame, detail: DataFrame, spec: MatchSpec, near: bool = False) -> DataFrame:
    """The prepared inputs with their chosen addresses (address_id1, address_id2, similarity), texts and places joined to these."""
    extra = NEAR if near else []
    chosen = chosen.select("address_id1", "address_id2", "similarity", *extra)
    known = detail.select(
        F.col("addr_id").alias("address_id2"), F.col("addr").alias("address_matched"), "suburb", F.col("POSTCODE").alias("postcode"), F.col("LATITUDE").alias("latitude"), F.col("LONGITUDE").alias("longitude"),
        F.col("numeric_tokens").alias("match_numerics"), text.alpha_tokens(F.col("addr")).alias("match_alpha_tokens"),
    )
    out = own.join(chosen.join(known, "address_id2"), "address_id1", "left" if spec.keep_unmatched else "inner")
    return out.select(F.col("address_id1").alias("address_id"), F.col("address").alias("input_address"), *OUTPUT, "input_numerics", "input_alpha_tokens", *extra)
