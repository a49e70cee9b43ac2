"""Planar geometry on vertex arrays, as column expressions.

Polygons travel as ``edges``: an array of struct<x1,y1,x2,y2> over all rings. Even-odd
counting over all rings handles holes and multi-polygons alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ring_edges(points: Column) -> Column:
    """Edges of a ring; a missing closing vertex is supplied. Linear in the vertex count."""
    turned = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))

    def edge(p: Column, q: Column) -> Column:
        return F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
        )

    edges = F.zip_with(points, turned, edge)
    return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def ring_edges(ring: Column) -> Column:
    """Edges from an array of struct<x,y>."""
    return _ring_edges(ring)


def wkt_edges(wkt: Column) -> Column:
    """Edges of every ring of a POLYGON or MULTIPOLYGON text."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def vertex(text: Column) -> Column:
        parts = F.split(F.trim(text), r"\s+")
        return F.struct(
            F.get(parts, 0).cast("double").alias("x"), F.get(parts, 1).cast("double").alias("y")
        )

    return F.flatten(
        F.transform(rings, lambda r: _ring_edges(F.transform(F.split(r, ","), vertex)))
    )


def crossings(x: Column, y: Column, edges: Column) -> Column:
    """Number of edges that a ray from the point to the east crosses."""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return spans & (x < at)

    return F.size(F.filter(edges, crosses))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd test: is the point inside the polygon."""
    return crossings(x, y, edges) % 2 == 1


def distance_to(x: Column, y: Column, edges: Column) -> Column:
    """Distance from a point to a polygon; zero inside."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length2 = dx * dx + dy * dy
        t = ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.nullif(length2, F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
        px, py = e["x1"] + t * dx - x, e["y1"] + t * dy - y
        return F.sqrt(px * px + py * py)

    return F.when(inside(x, y, edges), F.lit(0.0)).otherwise(
        F.array_min(F.transform(edges, to_edge))
    )


def with_shape(areas: DataFrame, edges: Column, key: str = "area") -> DataFrame:
    """One row per area with edges, bounding box and area centroid (shoelace sums).

    Edges become rows once and are summed per area, so later joins read plain columns and
    never re-evaluate the parsing.
    """
    tall = areas.select("*", F.explode(edges).alias("_e"))
    x1, y1, x2, y2 = (F.col(f"_e.{c}") for c in ("x1", "y1", "x2", "y2"))
    cross = x1 * y2 - x2 * y1
    rest = [F.first(c).alias(c) for c in areas.columns if c != key]
    packed = tall.groupBy(key).agg(
        *rest,
        F.collect_list("_e").alias("edges"),
        F.struct(
            F.min(x1).alias("xmin"), F.min(y1).alias("ymin"),
            F.max(x1).alias("xmax"), F.max(y1).alias("ymax"),
        ).alias("bbox"),
        F.sum(cross).alias("_a"),
        F.sum((x1 + x2) * cross).alias("_sx"),
        F.sum((y1 + y2) * cross).alias("_sy"),
    )
    area3 = F.nullif(F.col("_a") * 3.0, F.lit(0.0))
    middle = F.struct((F.col("_sx") / area3).alias("x"), (F.col("_sy") / area3).alias("y"))
    return packed.withColumn("centroid", middle).drop("_a", "_sx", "_sy")
