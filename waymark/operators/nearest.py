"""Reverse geocoding: the nearest reference point by Euclidean distance in degrees, exactly, by descent through a pyramid of grid cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from waymark.sources.tables import written

#: A cell has ``2**STEP`` cells of the next level a side.
STEP = 3
#: Cells of a level that are broadcast, by its depth: so many at most, as 64 cells make the first level and 4096 the second.
SMALL = 2


def nearest(queries: DataFrame, points: DataFrame) -> DataFrame:
    """query_id, addr_id and distance, for each query (query_id, latitude, longitude).

    ``points`` has addr_id, latitude and longitude. Occupied cells of every level are listed once, each with one of its points. From the whole
    box downwards a query keeps the cells that may hold a point as near as the nearest of these points, so it
    meets few cells, wherever it is and however uneven the points are; the points of the finest cells that are left decide.
    Points with equal coordinates are one, with the lowest addr_id, which also wins among equally near points.
    Queries or points without coordinates don't take part; no points give no rows.
    """
    spark = queries.sparkSession
    q = queries.where("latitude is not null and longitude is not null").select("query_id", F.col("latitude").cast("double").alias("qy"), F.col("longitude").cast("double").alias("qx"))
    p = points.where("latitude is not null and longitude is not null").select("addr_id", F.col("latitude").cast("double").alias("py"), F.col("longitude").cast("double").alias("px"))
    p = written(p.groupBy("px", "py").agg(F.min("addr_id").alias("addr_id")), "points")
    left, right, low, high, n = p.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count(F.lit(1))).first()
    if not n:
        schema = T.StructType([q.schema["query_id"], p.schema["addr_id"], T.StructField("distance", T.DoubleType())])
        return spark.createDataFrame([], schema)
    levels = math.ceil(math.log2(n) / 2 / STEP) + 1
    finest = max(right - left, high - low, 1e-6) * (1 + 1e-9) / 2 ** (STEP * levels)
    cell = lambda c, least: F.floor((F.col(c) - least) / finest).cast("bigint")
    points_in = p.withColumns({"x": cell("px", left), "y": cell("py", low)})
    each = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    at = lambda c, up: F.expr(f"shiftright({c}, {STEP} * {up})")
    pyramid = points_in.select("px", "py", "x", "y", each).groupBy("level", at("x", "level").alias("x"), at("y", "level").alias("y")).agg(F.min(F.struct("px", "py")).alias("one"))
    pyramid = written(pyramid, "pyramid")
    apart = lambda x, y: (F.col("qx") - x) ** 2 + (F.col("qy") - y) ** 2
    state = q.withColumns({"x": F.lit(0).cast("bigint"), "y": F.lit(0).cast("bigint")})
    for level in reversed(range(levels)):
        size = finest * 2 ** (STEP * level)
        below = pyramid.where(F.col("level") == level).select(at("x", 1).alias("x"), at("y", 1).alias("y"), F.col("x").alias("nx"), F.col("y").alias("ny"), "one")
        if levels - level <= SMALL:
            below = F.broadcast(below)
        gap = lambda c, least, k: F.greatest(least + F.col(k) * size - F.col(c), F.col(c) - least - (F.col(k) + 1) * size, F.lit(0.0)) ** 2  # noqa: B023, E731
        pairs = state.join(below, ["x", "y"]).withColumns({"least": gap("qx", left, "nx") + gap("qy", low, "ny"), "most": apart(F.col("one.px"), F.col("one.py"))})
        best = F.min("most").over(Window.partitionBy("query_id", "qx", "qy"))
        # Borders of cells are rounded, so a hair's breadth is allowed.
        state = pairs.withColumn("best", best).where(F.col("least") <= F.col("best") * (1 + 1e-6) + 1e-12).select("query_id", "qx", "qy", F.col("nx").alias("x"), F.col("ny").alias("y"))
    near = state.join(points_in, ["x", "y"]).groupBy("query_id").agg(F.min(F.struct(apart(F.col("px"), F.col("py")).alias("d2"), "addr_id")).alias("best"))
    return near.select("query_id", F.col("best.addr_id").alias("addr_id"), F.sqrt("best.d2").alias("distance"))
