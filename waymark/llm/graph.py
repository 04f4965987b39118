"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import cut, discard

#: Links that go to a task, and nodes that it joins up at once.
LINKS, HELD = 1 << 18, 600_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a, b of one orderable type) that isn't its component's smallest; a table of :func:`cut`.

    Links are dealt to as many tasks as they need, ``LINKS`` to a task, and each task makes its links into stars of their smallest nodes. Then alternate
    large-star and small-star steps go on until all components are stars; the number of rounds grows with the logarithm of the longest path
    that is left. Each round's edges are written to the shared folder; mins are aggregated before the shuffle, and joins on a star's center can be split.
    Empty links give an empty table; repeated links and links of a node with itself count once or not at all.
    """
    tasks = -(-max(1, links.count()) // LINKS)
    edges = cut(_joined_up(links.where("a != b").select("a", "b").repartition(tasks)).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = cut(small, "edges")
        discard(edges)
        edges = after
    named = edges.withColumnsRenamed({"a": "node", "b": "root"})
    named.cut_path = edges.cut_path
    return named


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two links up, or links both up and down."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").take(1)


def _joined_up(edges: DataFrame) -> DataFrame:
    """Links (a, b) with the same components: stars of the links of each task."""

    def run(batches):
        parent: dict = {}

        def find(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def stars(schema):
            rows = [(x, find(x)) for x in list(parent)]
            rows = [r for r in rows if r[0] != r[1]]
            parent.clear()
            for k in range(0, len(rows), 4096):
                a, b = ([_value(x) for x in side] for side in zip(*rows[k : k + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(a, schema.field(0).type), pa.array(b, schema.field(1).type)], schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(*(map(_key, batch.column(k).to_pylist()) for k in (0, 1))):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > HELD:
                yield from stars(schema)
        if parent:
            yield from stars(schema)

    return edges.mapInArrow(run, edges.schema)


class _Struct(tuple):
    """A struct's values in the order of its fields, which is how Spark compares structs."""

    names: tuple = ()


def _key(v):
    if isinstance(v, dict):
        k = _Struct(v.values())
        k.names = tuple(v)
        return k
    return v


def _value(k):
    return dict(zip(k.names, k)) if isinstance(k, _Struct) else k
