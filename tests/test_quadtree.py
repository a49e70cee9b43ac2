"""Quadtree covers against the test on all edges, and tasks that share the work."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.functions import geometry
from cellcast.operators import quadtree, spatial
from cellcast.sources.polygons import areas_from_rings, areas_from_wkt


def star(n, x, y, small, large, seed):
    """A ring of n vertices with jagged radius."""
    rng = random.Random(seed)
    turn = [2 * math.pi * k / n for k in range(n)]
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t in turn if (r := rng.uniform(small, large))]


def text(*rings):
    return "POLYGON(" + ",".join("(" + ",".join(f"{x!r} {y!r}" for x, y in (*r, r[0])) + ")" for r in rings) + ")"


def by_all_edges(points, areas):
    shapes = F.broadcast(areas.select("area", "edges"))
    both = points.withColumn("_k", F.lit(1)).join(shapes.withColumn("_k", F.lit(1)), "_k")
    return sorted((r["p"], r["area"]) for r in both.filter(geometry.inside(F.col("lon"), F.col("lat"), F.col("edges"))).collect())


@pytest.mark.parametrize("size", [1.0, 0.3, 25.0])
def test_equal_to_all_edges(spark, monkeypatch, size):
    monkeypatch.setattr(quadtree, "MOST", 4)
    rings = [
        (1, text(star(700, 0.4, -0.7, 0.2, 3.1, 1), star(90, 0.4, -0.7, 0.05, 0.15, 2))),
        (2, text(star(40, 30.0, 60.0, 0.01, 0.02, 3))),
        (3, text(star(300, 2.5, 0.5, 1.0, 2.0, 4))),
        (4, text([(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)])),
        (5, "MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0),(1 1,1 3,3 3,3 1,1 1)),((6 0,8 0,7 2,6 0)))"),
        (6, text([(-170.0, -80.0), (170.0, -80.0), (0.0, 85.0)])),
    ]
    areas = areas_from_wkt(spark.createDataFrame(rings, "k int, wkt string"), "k")
    rng = random.Random(9)
    spots = [(rng.uniform(-4, 6), rng.uniform(-4, 4)) for _ in range(4000)]
    spots += [(30 + rng.uniform(-0.02, 0.02), 60 + rng.uniform(-0.02, 0.02)) for _ in range(300)]
    # Corners of quads, heights of vertices and places on edges.
    spots += [(x / 8, y / 8) for x in range(-10, 40) for y in range(-10, 34)]
    spots += [(rng.uniform(-4, 4), y) for _, y in star(700, 0.4, -0.7, 0.2, 3.1, 1)]
    points = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "p int, lon double, lat double")
    got = sorted((r["p"], r["area"]) for r in spatial.points_in_areas(points, areas, size).collect())
    assert got == by_all_edges(points, areas) and len({a for _, a in got}) == 6


def test_rows_that_match_nothing(spark):
    points = spark.createDataFrame(
        [(1, 0.5, 0.5), (2, None, 0.5), (3, 0.5, None), (4, float("nan"), 0.5), (5, 9.0, 9.0), (1, 0.5, 0.5)], "p int, lon double, lat double"
    )
    square = spark.createDataFrame([(1, "POLYGON((0 0,1 0,1 1,0 1,0 0))"), (2, "POLYGON((0 0,1 0,nan 1,0 1,0 0))")], "k int, wkt string")
    areas = areas_from_wkt(square, "k")
    both = areas.unionByName(areas.limit(1).select(F.lit(3).alias("area"), "wkt", F.lit(None).cast(areas.schema["edges"].dataType).alias("edges"), "bbox", "centroid"))
    assert [(r["p"], r["area"]) for r in spatial.points_in_areas(points, both).collect()] == [(1, 1), (1, 1)]
    assert spatial.points_in_areas(points, areas.filter("area > 9")).count() == 0


def test_many_vertices_and_crowded_degree(spark):
    """A ring of 100,000 vertices and 400,000 points in one degree: few edges a test, no task far above the others."""
    n = 100_000
    turn = np.arange(n) * (2 * math.pi / n)
    far = 0.35 + 0.05 * np.sin(turn * 37) + 0.01 * np.sin(turn * 991)
    ring = [{"x": float(0.5 + r * math.cos(t)), "y": float(0.5 + r * math.sin(t))} for t, r in zip(turn, far)]
    rows = spark.createDataFrame([(1, ring)], "k int, ring array<struct<x:double,y:double>>")
    areas = areas_from_rings(rows, "k")
    held = quadtree.cover(areas).agg(
        F.count("*").alias("quads"), F.max(F.size("_edges") + F.size("_heights")).alias("most"),
        F.sum(F.size("_edges")).alias("edges"), F.sum(F.when(F.size("_edges") == 0, 1)).alias("inner"),
    ).first()
    assert held["most"] <= quadtree.MOST and held["edges"] < 4 * n and held["inner"] > 1000
    points = spark.range(400_000).select(
        (F.col("id") % 1000 / 1000.0 + 0.0003).alias("lon"), ((F.floor(F.col("id") / 1000) + 0.5) / 400.0).alias("lat")
    )
    hits = spatial.points_in_areas(points, areas)
    angle = F.atan2(F.col("lat") - 0.5, F.col("lon") - 0.5)
    reach = 0.35 + 0.05 * F.sin(angle * 37) + 0.01 * F.sin(angle * 991)
    away = F.sqrt(F.pow(F.col("lon") - 0.5, 2) + F.pow(F.col("lat") - 0.5, 2))
    want, got = points.filter(away < reach).count(), hits.count()
    assert abs(want - got) < 20
    # The deal of points to quads: with 16 partitions none holds twice the median.
    level = F.lit(10)
    side = 1.0 / F.pow(F.lit(2.0), level)
    keys = points.select(F.floor(F.col("lon") / side).alias("x"), F.floor(F.col("lat") / side).alias("y"), F.pmod(F.xxhash64("lon", "lat"), F.lit(16)).alias("s"))
    sizes = sorted(r["count"] for r in keys.groupBy(F.pmod(F.hash("x", "y", "s"), F.lit(16))).count().collect())
    assert sizes[-1] < 2 * sizes[8]
