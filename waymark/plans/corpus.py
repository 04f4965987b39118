"""Addresses and inputs derived from the star schema, in Spark and as SQL, for queries, tests and benchmarks.

An address has a number, a street of two made-up words, a nation as suburb, a region as state and a postcode.
Inputs are the same addresses with one of six kinds of noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word(key: str) -> str:
    return f"translate(substr(md5(CAST({key} AS STRING)), 1, 6), '0123456789', 'ghijklmnop')"


_W1, _W2 = _word("c_custkey % 97"), _word("500 + c_custkey % 89")
_STREET = f"CASE WHEN c_custkey % 11 = 0 THEN replace({_W1}, 'e', 'é') ELSE {_W1} END"

PARTS = f"c_custkey, CAST(c_custkey % 300 + 1 AS STRING) AS num, {_STREET} AS w1, {_W2} AS w2, n_name, n_nationkey, r_name, CAST(1000 + n_nationkey AS STRING) AS code"
LABEL = "num || ' ' || w1 || ' ' || w2 || ' st ' || n_name || ' ' || r_name || ' ' || code"
ADDRESS = [
    "CAST(c_custkey AS INT) AS addr_id",
    f"{LABEL} AS ADDRESS_LABEL",
    "CAST(NULL AS STRING) AS ADDRESS_SITE_NAME",
    "n_name AS LOCALITY_NAME",
    "code AS POSTCODE",
    "r_name AS STATE",
    "CAST(CAST(c_custkey * 37 % 18000 AS DOUBLE) / 100 - 90 AS FLOAT) AS LATITUDE",
    "CAST(CAST(c_custkey * 101 % 36000 AS DOUBLE) / 100 - 180 AS FLOAT) AS LONGITUDE",
]
NOISE = f"""CASE c_custkey % 6
 WHEN 0 THEN lower({LABEL})
 WHEN 1 THEN replace({LABEL}, ' st ', ', ')
 WHEN 2 THEN num || ' ' || w1 || ' ' || w2 || ' st'
 WHEN 3 THEN num || ' ' || translate(w1, 'ab', 'ba') || ' ' || w2 || ' st ' || n_name || ' ' || r_name
 WHEN 4 THEN replace({LABEL}, ' ', ' - ')
 ELSE CAST(c_custkey % 300 + 1001 AS STRING) || ' ' || w1 || ' ' || w2 || ' st ' || n_name || ' ' || code END"""
INPUT = ["CAST(c_custkey + 1 AS INT) AS address_id", f"{NOISE} AS address"]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.selectExpr(*_split(PARTS))


def _split(columns: str) -> list[str]:
    """Columns of a list at its commas outside parentheses."""
    out, depth, part = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by id, as a large address file would be over many tasks; the table that they are made from is one small file."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _parts(spark, sf_dir).repartition(parts, "c_custkey").selectExpr(*ADDRESS)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).selectExpr(*INPUT)


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's nations of the same region, itself included, as neighbouring suburbs."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    a = n.join(r, n.n_regionkey == r.r_regionkey).select("n_regionkey", F.col("n_name").alias("suburb_name"), F.col("r_name").alias("state_name"), (1000 + F.col("n_nationkey")).cast("string").alias("postcode"))
    b = a.select("n_regionkey", F.concat_ws(" ", "suburb_name", "state_name", "postcode").alias("neighbour_suburb_state_postcode"), F.col("suburb_name").alias("other"))
    return a.join(b, "n_regionkey").select("suburb_name", "state_name", "postcode", "neighbour_suburb_state_postcode", (F.col("other") != F.col("suburb_name")).alias("neighbouring_suburb_correction"))


# The same as SQL: common table expressions that queries put before their own.

PARTS_SQL = f"parts AS (SELECT {PARTS} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
ADDRESSES_SQL = f"{PARTS_SQL},\naddresses AS (SELECT {', '.join(ADDRESS)} FROM parts)"
INPUTS_SQL = f"inputs AS (SELECT {', '.join(INPUT)} FROM parts)"
NEIGHBOURS_SQL = """near_a AS (SELECT n_regionkey, n_name AS suburb_name, r_name AS state_name, CAST(1000 + n_nationkey AS STRING) AS postcode FROM nation JOIN region ON n_regionkey = r_regionkey),
neighbours AS (SELECT a.suburb_name, a.state_name, a.postcode, b.suburb_name || ' ' || b.state_name || ' ' || b.postcode AS neighbour, b.suburb_name <> a.suburb_name AS correction FROM near_a a JOIN near_a b ON a.n_regionkey = b.n_regionkey)"""
