"""Mixing sources to target weights: block quotas, split among output shards by hypergeometric draws.

A source's documents are dealt to blocks by hash, about ``BLOCK_ROWS`` to a block and at most ``BLOCKS`` blocks
to a source. Its quota is a number of block draws: whole passes over all its blocks, and in one more pass the blocks that fit
what is left of its target. A binary tree splits these exact quotas among the output shards: each node
deals its draws to its two halves by a multivariate hypergeometric draw, so that every shard has its exact
share of all draws and the sources' shares vary as if drawn without replacement. The tree is first drawn for groups of sources,
then for the sources of each group given the group's shares, which is the same distribution; so the driver holds ``GROUPS`` numbers
a shard, however many sources there are. A shard draws the next blocks of each source's seeded permutation, as many as its
quota says, so the blocks of a pass are disjoint among shards. A document is taken once for each draw of its block; of the last
block of a source, which fits in part, documents are taken largest first while they fit. Rows are shuffled within a
shard by a seeded hash. Everything follows from hashes and a seed, so reruns agree.

No task holds more than one block's sizes, the blocks of one source or the sources of one group, and the driver no list of sources.

Cases: a null text has size 0; sources are ordered by code point, null last, and a null source is a source
as others; of a source of size 0, and so of target 0, nothing is taken, while texts of size 0 in other sources go with their block;
repeated rows are separate rows, and rows that tie are ordered by
hash; an empty table gives an empty one; texts are never cut; other columns are passed on by :func:`mix`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from waymark.llm.common import cut, discard, documents, record, schemas

WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2
BLOCK_ROWS, BLOCKS = 64, 4096
SHARDS, SEED, GROUPS = 16, 20_240, 256
#: numpy draws from fewer than 10**9 at once; more are drawn in equal parts.
AT_ONCE = 500_000_000

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, ceiling: float = CEILING) -> list[float]:
    """``share`` of all sizes dealt by weight; a source stops at ``ceiling`` times its size, and what is over is dealt again."""
    out = [0.0] * len(sizes)
    left, free = share * sum(sizes), list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > ceiling * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(ceiling * sizes[i])
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def _draw(rng, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` of ``counts`` without replacement."""
    parts, left = int(counts.sum()) // AT_ONCE + 1, int(counts.sum())
    out = np.zeros_like(counts)
    for j in range(parts):
        own = counts * (j + 1) // parts - counts * j // parts
        size = int(own.sum())
        if size:
            k = n * size // left
            out += rng.multivariate_hypergeometric(own, k, method="marginals")
            n, left = n - k, left - size
    return out


def split_tree(quotas, shards: int, seed=(SEED,), totals=None) -> np.ndarray:
    """(shards, sources): how many of each source's draws each shard gets. A shard's draws are ``totals``, or all the same, but for rounding."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(counts, first, n):
        if n == 1:
            out[first] = counts
            return
        half = n // 2
        left_total = int(counts.sum()) * half // n if totals is None else int(np.sum(totals[first : first + half]))
        left = _draw(np.random.default_rng([*seed, first, n]), counts, left_total)
        split(left, first, half)
        split(counts - left, first + half, n - half)

    if len(quotas):
        split(np.asarray(quotas, np.int64), 0, shards)
    return out


def _fit(table: pa.Table) -> pa.Table:
    """Marks documents of a block, largest first, while they fit into ``room``; one more if that comes nearer."""
    size, th = table["size"].to_numpy(), table["th"].to_numpy()
    room, taken = table["room"][0].as_py(), np.zeros(len(size), np.int32)
    for i in np.lexsort((th, -size)):
        if size[i] <= room:
            taken[i] = 1
            room -= size[i]
    left = np.flatnonzero((taken == 0) & (size > 0))
    if len(left):
        i = left[np.lexsort((th[left], size[left]))[0]]
        taken[i] = size[i] < 2 * room
    return table.select(["id", "th", "source", "size", "block"]).append_column("more", pa.array(taken))


def _sources(rows: DataFrame, weights, share: float, ceiling: float) -> DataFrame:
    """(source, rank, source_size, target, whole, rest, blocks) of each source; targets as in :func:`targets`, without a list of sources."""
    spark = rows.sparkSession
    order = F.asc_nulls_last("source")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    dealt = sums.repartitionByRange(order).sortWithinPartitions(order)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "sums")
    before, first = 0, []
    for r in sorted(dealt.groupBy("part").count().collect()):  # a row for each partition
        first.append((r["part"], before))
        before += r["count"]
    first = spark.createDataFrame(first, "part int, first bigint")
    rank = F.col("first") + F.col("at")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    ranked = cut(dealt.join(F.broadcast(first), "part").select("source", "source_size", "rows", rank.alias("rank"), weight.alias("weight")), "ranked")
    most = F.col("source_size") * float(ceiling)
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    goal, stopped = share * (total["size"] or 0), 0
    level = goal / total["weight"] if total["weight"] else 0.0
    while True:  # what is over at sources that stop goes to the others, until no more stop
        full = F.col("weight") * level > most
        r = ranked.agg(F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)).alias("size"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if r["n"] == stopped or not r["weight"]:
            break
        stopped, level = r["n"], (goal - r["size"]) / r["weight"]
    target = F.least(F.col("weight") * level, most)
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("int")
    blocks = F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.floor(F.col("rows") / BLOCK_ROWS))).cast("int")
    out = ranked.select("source", "rank", "source_size", target.alias("target"), whole.alias("whole"), (target - whole * F.col("source_size")).alias("rest"), blocks.alias("blocks"))
    out = cut(out, "sources")
    discard(dealt, ranked)
    return out


def _shares(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, n, ends) from (source, rank, n, quota): of a source's draws, those before ``ends[i]`` go to the shards up to i."""
    group = F.pmod(F.xxhash64("rank", F.lit(seed)), F.lit(GROUPS)).cast("int")
    quotas = cut(quotas.select("*", group.alias("of")), "quotas")
    totals = {r["of"]: r["quota"] for r in quotas.groupBy("of").agg(F.sum("quota").alias("quota")).collect()}  # GROUPS rows at most
    named = sorted(totals)
    top = dict(zip(named, split_tree([totals[g] for g in named], shards, (seed,)).T.tolist()))
    kind, arrow = schemas("source string, n int, ends array<bigint>")

    def split(key, table):
        table = table.sort_by("rank")
        g = key[0].as_py()
        ends = np.cumsum(split_tree(table["quota"].to_numpy(), shards, (seed, g + 1), top[g]), axis=0).T
        return pa.Table.from_batches([record(arrow, [table["source"].combine_chunks(), table["n"].combine_chunks(), ends.tolist()])])

    out = cut(quotas.groupBy("of").applyInArrow(split, kind), "shares")
    discard(quotas)
    return out


def plan(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(id, th, source, size, source_size, target, draws) of each row: a written table.

    ``draws`` has the output shard of each time that the mix takes the row. ``th`` is Spark's xxhash64 of id, text and source.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = cut(df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text, source).alias("th"), F.col(source).cast("string").alias("source"), words.alias("size")), "sizes")
    sources = _sources(rows, weights, share, ceiling)

    def joined(left, right, on):
        """Left rows with the columns of ``right``; null sources are equal."""
        other = right.withColumnsRenamed({c: f"{c}_" for c in on})
        same = left["source"].eqNullSafe(other["source_"])
        return left.join(other, same & (left["block"] == other["block_"]) if "block" in on else same).drop(*(f"{c}_" for c in on))

    dealt = joined(rows, sources.select("source", "blocks"), ["source"]).withColumn("block", F.pmod(F.xxhash64("th", F.lit(seed)), "blocks").cast("int")).drop("blocks")
    table = joined(dealt.groupBy("source", "block").agg(F.sum("size").alias("block_size")), sources, ["source"])
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    table = table.withColumn("place", F.row_number().over(order) - 1).withColumn("upto", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # What is left of the rest when the block's turn comes. Blocks with room are the first of the permutation.
    table = cut(table.withColumn("room", F.col("rest") - F.col("upto") + F.col("block_size")).drop("upto", "blocks"), "blocks")
    with_room = F.col("room") > 0
    quotas = table.groupBy("source").agg(F.first("rank").alias("rank"), F.count(F.lit(1)).cast("int").alias("n"), (F.first("whole") * F.count(F.lit(1)) + F.count(F.when(with_room, 1))).alias("quota"))
    shares = _shares(quotas, shards, seed)
    # A block's turns in the passes over its source, and the shard whose quota each falls to, if any.
    turns = F.expr("transform(filter(transform(sequence(0, whole), p -> p * n + place), t -> t < element_at(ends, -1)), t -> size(filter(ends, e -> e <= t)))")
    table = cut(joined(table, shares, ["source"]).select("source", "block", "source_size", "target", "whole", "room", (with_room & (F.col("block_size") > F.col("room"))).alias("edge"), turns.alias("draws")), "draws")
    kind = T.StructType([dealt.schema[c] for c in ("id", "th", "source", "size", "block")] + [T.StructField("more", T.IntegerType())])
    edge = joined(dealt, table.where("edge").select("source", "block", "room"), ["source", "block"]).groupBy("source", "block").applyInArrow(_fit, kind)
    rest = joined(dealt, table.where("not edge").select("source", "block"), ["source", "block"]).withColumn("more", F.lit(1))
    out = joined(rest.unionByName(edge), table, ["source", "block"])
    drawn = F.slice("draws", F.lit(1), F.least(F.size("draws"), F.col("whole") + F.col("more")))
    out = cut(out.select("id", "th", "source", "size", "source_size", "target", drawn.alias("draws")), "plan")
    discard(rows, sources, shares, table)
    return out


def mix(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The rows of the mix: those of ``df`` as often as they are drawn, with the columns shard and place added at the end (place orders a shard).

    Columns of ``df`` may have any names, these two included.
    """
    names = [f"_{i}" for i in range(len(df.columns))]
    key = F.xxhash64(*(names[df.columns.index(c)] for c in (id_col, text, source)))
    keyed = df.toDF(*names).withColumn("key", key)
    taken = plan(df, text, id_col, source, seed=seed, **how).where(F.size("draws") > 0).select(F.col("th").alias("key"), "draws")
    on = ["key"]
    if taken.groupBy("key").count().where("count > 1").take(1):  # repeated rows: each has draws of its own
        taken = taken.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.size("draws").desc(), "draws")))
        keyed = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(*names), *names[:1])))
        on = ["key", "copy"]
    rows = keyed.join(taken, on).select(*names, "key", F.posexplode("draws").alias("time", "shard"))
    return rows.select(*names, "shard", F.xxhash64("key", "time", F.lit(seed)).alias("place")).toDF(*df.columns, "shard", "place")


def in_order(mixed: DataFrame) -> DataFrame:
    """A mix's rows with those of a part of a shard together, in their order: the local shuffle. The last two columns are shard and place."""
    names = [f"_{i}" for i in range(len(mixed.columns))]
    shard, place = names[-2:]
    # A shard has many parts, by the first bits of its order, so it need not fit in one task.
    part = F.shiftrightunsigned(place, 54)
    return mixed.toDF(*names).repartition(shard, part).sortWithinPartitions(shard, place).toDF(*mixed.columns)


def write_shards(mixed: DataFrame, path: str) -> None:
    """Writes a mix as Parquet, one folder per shard, each file in the shard's order."""
    in_order(mixed).write.partitionBy("shard").parquet(path)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = plan(documents(spark, sf_dir))
    return drawn.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.array_join("draws", ",").alias("shards"))


QUERIES = {"op9_source_mix": op9_source_mix}
