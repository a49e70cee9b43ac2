"""Polygon tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions.geometry import ring_edges, with_shape, wkt_edges


def areas_from_wkt(rows: DataFrame, key: str) -> DataFrame:
    """(area, wkt, edges, bbox, centroid) from polygon texts; ``key`` becomes the area id."""
    base = rows.select(F.col(key).alias("area"), "wkt")
    return with_shape(base, wkt_edges(F.col("wkt")))


def areas_from_rings(rows: DataFrame, key: str) -> DataFrame:
    """Same from vertex arrays; the text is rebuilt from the ring."""
    vertex = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    closed = F.concat("ring", F.slice("ring", 1, 1))
    wkt = F.concat(F.lit("POLYGON(("), F.array_join(F.transform(closed, vertex), ","), F.lit("))"))
    base = rows.select(F.col(key).alias("area"), wkt.alias("wkt"), "ring")
    return with_shape(base, ring_edges(F.col("ring"))).drop("ring")


def number_areas(rows: DataFrame, order: str) -> DataFrame:
    """Give polygons the ids 1, 2, ... in the order of a column (polygon tables are small)."""
    window = Window.partitionBy(F.lit(0)).orderBy(order)
    return rows.withColumn("area", F.row_number().over(window))
