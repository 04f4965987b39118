"""What is done with matches: splitting by a threshold, ordering, one answer each, cascades and accuracy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_matched(results: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) by similarity; null and NaN count as unmatched."""
    good = F.coalesce((F.col("similarity") >= threshold) & ~F.isnan("similarity"), F.lit(False))
    return results.where(good), results.where(~good)


def ordered(results: DataFrame) -> DataFrame:
    """By input, best first; rows without a similarity last."""
    sim = F.when(~F.isnan("similarity"), F.col("similarity"))
    return results.orderBy("address_id", sim.desc_nulls_last())


def one_each(results: DataFrame) -> DataFrame:
    """The best row of each input; rows that tie are told apart by the lower address_id2."""
    sim = F.when(~F.isnan("similarity"), F.col("similarity"))
    order = Window.partitionBy("address_id").orderBy(sim.desc_nulls_last(), *([F.asc_nulls_last("address_id2")] if "address_id2" in results.columns else []))
    return results.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def cascade(inputs: DataFrame, matchers: list[tuple[Callable[[DataFrame], DataFrame], float]], cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each matcher gets what the ones before left below their threshold; the last one's unmatched rows stay.

    ``matchers`` are functions from inputs (address_id, address) to results, with thresholds. ``cut`` may
    write intermediate results, so that they are computed once.
    """
    out, rest, unmatched = None, inputs, None
    for f, threshold in matchers:
        results = f(rest)
        results = cut(results) if cut else results
        matched, unmatched = split_matched(results, threshold)
        out = matched if out is None else out.unionByName(matched)
        left = unmatched.select("address_id").distinct()
        rest = inputs.join(left, "address_id", "left_semi")
    return out.unionByName(unmatched)


def normalised(c):
    """Lower case with single spaces, as answers are compared."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def judged(results: DataFrame, expected: DataFrame) -> DataFrame:
    """address_id, input_address, matched_address, expected_address and correct; ``expected`` has address_id and expected_address."""
    one = one_each(results).select("address_id", "input_address", F.col("address_matched").alias("matched_address"))
    both = expected.join(one, "address_id", "left")
    return both.select("address_id", "input_address", "matched_address", "expected_address", F.coalesce(normalised(F.col("matched_address")) == normalised(F.col("expected_address")), F.lit(False)).alias("correct"))


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: total, matched, unmatched, match_rate."""
    total, good = F.count(F.lit(1)), F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0))
    return rows.agg(total.alias("total"), good.alias("matched"), (total - good).alias("unmatched"), F.when(total > 0, good / total).otherwise(0.0).alias("match_rate"))


def answers_with_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results with correct (equal but for case and spaces at the ends; null where the truth is blank); NaN becomes null."""
    blank = F.trim("correct_match") == ""
    same = F.upper(F.trim("address_matched")) == F.upper(F.trim("correct_match"))
    sim = F.when(~F.isnan("similarity"), F.col("similarity"))
    return results.join(truth.select("address_id", "correct_match"), "address_id", "left").withColumn("similarity", sim).withColumn("correct", F.when(F.col("correct_match").isNull() | blank, None).otherwise(F.coalesce(same, F.lit(False))))
