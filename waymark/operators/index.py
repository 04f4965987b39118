"""Building the tables that addresses are matched against: the reference table, phrases and inverted indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import phrases, text

#: Phrases of cleaned reference tokens by the name of an index.
GENERATORS: dict[str, Callable[[Column], Column]] = {
    "bigram": phrases.bigrams,
    "standard": phrases.standard,
    "skipphrase": phrases.skips,
    "soundex": phrases.sounds,
}


def addresses_with_detail(addresses: DataFrame, normalise: bool = False, per_row: bool = True) -> DataFrame:
    """The reference table, from addr_id, ADDRESS_LABEL, LOCALITY_NAME, POSTCODE, STATE, LATITUDE and LONGITUDE.

    Addresses without a numeric token are left out. ``normalise`` cleans labels as inputs are cleaned. The
    tokens come from the row itself; ``per_row=False`` joins the details by addr_id instead, so that an id that
    repeats multiplies.
    """
    clean = (text.clean_input if normalise else text.clean_reference)(F.col("ADDRESS_LABEL"))
    found = addresses.withColumn("addr", clean).withColumn("numeric_tokens", text.numeric_tokens_reference(F.col("addr"))).where(F.size("numeric_tokens") > 0)
    detail = ["ADDRESS_LABEL", F.col("LOCALITY_NAME").alias("suburb"), "POSTCODE", "LATITUDE", "LONGITUDE", "STATE"]
    if not per_row:
        # Rows of one id and address are one group with the tokens of all.
        found = found.groupBy("addr_id", "addr").agg(F.flatten(F.collect_list("numeric_tokens")).alias("numeric_tokens")).join(addresses, "addr_id", "left")
    return found.select("addr_id", "addr", "numeric_tokens", *detail)


def phrase_table(detail: DataFrame, how: str = "standard") -> DataFrame:
    """(addr_id, tokenphrase), a row for each phrase, copies kept."""
    tokens = detail.select("addr_id", text.phrase_tokens(F.col("addr")).alias("tokens"))
    return tokens.select("addr_id", F.explode(GENERATORS[how](F.col("tokens"))).alias("tokenphrase")).where("tokenphrase is not null")


def invert(table: DataFrame, key: str = "tokenphrase") -> DataFrame:
    """(key, addr_ids, frequency): the ids of each phrase, copies kept, and their number."""
    return table.groupBy(key).agg(F.collect_list("addr_id").alias("addr_ids"), F.count(F.lit(1)).alias("frequency"))


def trigram_phrases(table: DataFrame, distinct_per_phrase: bool = False) -> DataFrame:
    """(addr_id, trigramphrase) from a phrase table: trigrams of both words of each phrase."""
    rows = table.distinct() if distinct_per_phrase else table
    return rows.select("addr_id", F.explode(phrases.trigrams_of_phrase(F.col("tokenphrase"))).alias("trigramphrase"))


def merge_postings(index: DataFrame, key: str) -> DataFrame:
    """Posting lists with the same key joined, frequencies summed."""
    return index.groupBy(key).agg(F.flatten(F.collect_list("addr_ids")).alias("addr_ids"), F.sum("frequency").alias("frequency"))


def capped_postings(table: DataFrame, key: str, cap: int) -> DataFrame:
    """(key, addr_id) of the phrases that occur fewer than ``cap`` times.

    The posting lists' rows one by one: no list is ever built. What is looked for are the frequent phrases, of which there are
    few (less than rows / cap), so that where they are small they are broadcast, and rows aren't shuffled to be thrown away.
    """
    frequent = table.groupBy(key).agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= cap).select(key)
    return table.join(frequent, key, "left_anti")


def frequent_phrases(detail: DataFrame, how: str, cap: int) -> DataFrame:
    """(key, frequency) of the phrases that occur ``cap`` times or more, less than rows / cap of them. Trigrams are counted by the phrases that they are made of."""
    counts = phrase_table(detail, "standard" if how == "trigram" else how).groupBy(F.col("tokenphrase").alias("key")).agg(F.count(F.lit(1)).alias("frequency"))
    if how == "trigram":
        counts = counts.select(F.explode(phrases.trigrams_of_phrase(F.col("key"))).alias("key"), "frequency").groupBy("key").agg(F.sum("frequency").alias("frequency"))
    return counts.where(F.col("frequency") >= cap)
