"""The corpus pipeline: its stages in order, and ``run`` that applies them to documents.

Each stage takes documents with the columns doc_id, text and source, and any others by any names, and all but the last give the same columns.

Cases: texts that are null, empty or have few words don't pass the quality rules; very long texts are judged and cleaned in whole; rows
without an id are documents as others; rows of the same id and text are one document, of which one row stays, equal ids with different texts are
different documents; of a group of near duplicates the smallest id stays, rows without one last; a null source is a source; an empty table gives an
empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bytebpe, jaccard, mixing, repetition, substring
from waymark.llm.common import cut, discard, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules on repetition keep."""
    return repetition.keep(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of words that repeat; n_chars follows the text."""
    out = substring.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards."""
    mixed = mixing.in_order(mixing.mix(docs))
    names = [f"_{i}" for i in range(len(mixed.columns))]
    return mixed.toDF(*names).select(names[:-2]).toDF(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of byte-level BPE ids and the digests of ids and decoded bytes."""
    return bytebpe.encode_documents(docs, finish=bytebpe.digests, fields=bytebpe.DIGESTS)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The stages can't be expressed in SQL; a test holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
