"""Spatial joins against brute force."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellcast.functions import geometry
from cellcast.operators import grid, spatial
from cellcast.sources import catalog
from cellcast.sources.polygons import areas_from_wkt


def brute(targets, points):
    out = {}
    for t, x, y in targets:
        out[t] = min((((px - x) ** 2 + (py - y) ** 2) ** 0.5, p) for p, px, py in points)
    return out


def nearest(spark, targets, points, **options):
    t = spark.createDataFrame(targets, "t int, x double, y double")
    p = spark.createDataFrame(points, "p int, px double, py double")
    out = spatial.nearest_join(t, p, ("x", "y"), ("px", "py"), "p", **options).collect()
    return {r["t"]: (r["distance"], r["p"]) for r in out}


@pytest.mark.parametrize("finest", [20.0, 1.0, 0.1])
def test_nearest_join_is_exact(spark, finest):
    rnd = random.Random(1)
    # A third of the points sit in one tiny cluster, the targets are anywhere.
    points = [(i, 10 + rnd.random() / 100, 10 + rnd.random() / 100) for i in range(100)]
    points += [(100 + i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(200)]
    targets = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(60)]
    targets += [(60 + i, 10 + rnd.random() / 100, 10.0) for i in range(20)]
    got = nearest(spark, targets, points, finest=finest)
    want = brute(targets, points)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_nearest_join_ties_and_corners(spark):
    points = [(1, 180.0, 90.0), (2, -180.0, -90.0), (3, 0.0, 0.0), (4, 2.0, 0.0), (5, 0.0, 0.0)]
    targets = [(1, 1.0, 0.0), (2, 180.0, 90.0), (3, -179.0, -89.0), (4, 0.0, 0.0)]
    got = nearest(spark, targets, points)
    assert {k: v[1] for k, v in got.items()} == {1: 3, 2: 1, 3: 2, 4: 3}


def test_nearest_join_within_groups(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "k int, x double, y double")
    p = spark.createDataFrame([(1, 7, 5.0, 5.0), (2, 8, 1.0, 1.0)], "k int, p int, px double, py double")
    out = spatial.nearest_join(t, p, ("x", "y"), ("px", "py"), "p", by=["k"]).collect()
    assert {r["k"]: r["p"] for r in out} == {1: 7, 2: 8}


WKT = "MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0),(1 1,1 3,3 3,3 1,1 1)),((6 0,8 0,7 2,6 0)))"


def test_polygons_with_holes_and_parts(spark):
    areas = areas_from_wkt(spark.createDataFrame([(1, WKT)], "k int, wkt string"), "k")
    pts = [(0.5, 0.5, True), (2.0, 2.0, False), (7.0, 0.5, True), (5.0, 1.0, False), (3.5, 2.0, True)]
    df = spark.createDataFrame(pts, "lon double, lat double, want boolean")
    got = {(r["lon"], r["lat"]) for r in spatial.points_in_areas(df, areas).collect()}
    assert got == {(x, y) for x, y, w in pts if w}
    row = areas.first()
    assert row["bbox"].asDict() == {"xmin": 0.0, "ymin": 0.0, "xmax": 8.0, "ymax": 4.0}


def test_centroid_of_square(spark):
    df = spark.createDataFrame([(1, "POLYGON((1 1, 3 1, 3 5, 1 5, 1 1))")], "k int, wkt string")
    c = areas_from_wkt(df, "k").first()["centroid"]
    assert (c["x"], c["y"]) == pytest.approx((2.0, 3.0))


def test_distance_to_polygon(spark):
    areas = areas_from_wkt(
        spark.createDataFrame([(1, "POLYGON((0 0,2 0,2 2,0 2,0 0))")], "k int, wkt string"), "k"
    )
    pts = [(1.0, 1.0, 0.0), (3.0, 1.0, 1.0), (5.0, 6.0, 5.0)]
    df = spark.createDataFrame(pts, "x double, y double, want double").withColumn("area", F.lit(1))
    out = df.join(areas, "area").withColumn("d", geometry.distance_to(F.col("x"), F.col("y"), F.col("edges")))
    assert all(r["d"] == pytest.approx(r["want"]) for r in out.collect())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    west=st.integers(-20, 20), south=st.integers(-20, 20), width=st.integers(1, 10), height=st.integers(1, 10)
)
def test_bbox_keeps_edge_cells(spark, west, south, width, height):
    res = 1.0
    lats, lons = [30 - i for i in range(61)], [-30 + i for i in range(61)]
    bbox = (west + 0.3, south + 0.3, west + width + 0.3, south + height + 0.3)
    cells = spark.createDataFrame([(float(a), float(o)) for a in lats for o in lons], "lat double, lon double")
    got = {(r["lat"], r["lon"]) for r in grid.subset_bbox(cells, res, bbox).collect()}
    i1 = max(i for i, a in enumerate(lats) if bbox[3] <= a + 0.5)
    i2 = min(i for i, a in enumerate(lats) if bbox[1] >= a - 0.5)
    j1 = max(j for j, o in enumerate(lons) if bbox[0] >= o - 0.5)
    j2 = min(j for j, o in enumerate(lons) if bbox[2] <= o + 0.5)
    assert got == {(float(a), float(o)) for a in lats[i1:i2 + 1] for o in lons[j1:j2 + 1]}


def test_bilinear_reproduces_a_plane(spark):
    rows = [(10.0 - i, 20.0 + j, 3.0 * i + 2.0 * j) for i in range(6) for j in range(6)]
    cells = spark.createDataFrame(rows, "lat double, lon double, value double")
    out = grid.regrid_bilinear(cells, 1.0, 0.5, [], top=10.5, left=19.5).collect()
    assert len(out) == 144
    for r in out:
        i, j = 10.0 - r["lat"], r["lon"] - 20.0
        if 0 <= i <= 5 and 0 <= j <= 5:
            assert r["value"] == pytest.approx(3 * i + 2 * j)


def test_average_ignores_missing(spark):
    rows = [(9.75, 20.25, 1.0), (9.75, 20.75, None), (9.25, 20.25, 3.0)]
    cells = spark.createDataFrame(rows, "lat double, lon double, value double")
    out = grid.regrid_average(cells, 1.0, [], top=10.0, left=20.0).collect()
    assert [(r["row"], r["col"], r["value"]) for r in out] == [(0, 0, 2.0)]


def test_rectilinear_regrid_equals_full_search(spark):
    rnd = random.Random(3)
    lats = sorted(rnd.uniform(0, 10) for _ in range(12))
    lons = sorted(rnd.uniform(0, 10) for _ in range(9))
    cells = spark.createDataFrame(
        [(a, o, 100 * i + j) for i, a in enumerate(lats) for j, o in enumerate(lons)],
        "lat double, lon double, value int",
    )
    tl = [(0.5 + k,) for k in range(10)]
    out = grid.regrid_rectilinear(
        cells, spark.createDataFrame(tl, "lat double"), spark.createDataFrame(tl, "lon double")
    ).collect()
    assert len(out) == 100
    for r in out:
        best = min(
            ((r["lat"] - a) ** 2 + (r["lon"] - o) ** 2, 100 * i + j)
            for i, a in enumerate(lats) for j, o in enumerate(lons)
        )
        assert r["value"] == best[1]


def test_satellite_tiles_cover_the_globe(spark):
    tiles = catalog.satellite_tiles(spark)
    assert tiles.count() == 460
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-180, 180), rnd.uniform(-89.9, 89.9)) for i in range(300)]
    df = spark.createDataFrame(pts, "i int, lon double, lat double")
    h, v = catalog.tile_of(F.col("lon"), F.col("lat"))
    joined = df.withColumn("h", h).withColumn("v", v).join(tiles, ["h", "v"], "left")
    box = (
        F.col("lon").between(F.col("tile_box.xmin") - 1e-6, F.col("tile_box.xmax") + 1e-6)
        & F.col("lat").between(F.col("tile_box.ymin") - 1e-6, F.col("tile_box.ymax") + 1e-6)
    )
    assert joined.filter(box).count() == 300


def test_tile_box_of_a_polar_tile(spark):
    row = catalog.satellite_tiles(spark).filter("h = 14 and v = 0").first()["tile_box"]
    assert row["xmin"] == -180.0 and row["ymin"] == 80.0
    assert row["xmax"] == pytest.approx(-172.7151, abs=0.1)
    assert row["ymax"] == pytest.approx(80.4083, abs=0.01)


def test_growing_buffer_rings(spark):
    areas = areas_from_wkt(
        spark.createDataFrame(
            [(1, "POLYGON((0 0,1 0,1 1,0 1,0 0))"), (2, "POLYGON((20 20,21 20,21 21,20 21,20 20))")],
            "k int, wkt string",
        ), "k",
    )
    pts = [(1, 0.5, 0.5), (2, 0.9, 0.2), (3, 21.25, 20.5), (4, 21.28, 20.5), (5, 25.0, 20.0)]
    points = spark.createDataFrame(pts, "p int, lon double, lat double")
    out = spatial.within_growing_buffer(areas, points).collect()
    assert sorted((r["area"], r["p"], r["ring"]) for r in out) == [(1, 1, 0), (1, 2, 0), (2, 3, 3), (2, 4, 3)]


def test_remote_area_meets_few_bins(spark):
    """An area 50 degrees away looks at few bins and finds the same points as all pairs."""
    areas = areas_from_wkt(
        spark.createDataFrame(
            [(1, "POLYGON((-30 3,-20.03 3,-20.03 9,-30 9,-30 3))"), (2, "POLYGON((40.3 70,41 72,39 71,40.3 70))"), (3, "POLYGON((30.05 0.05,30.1 0.05,30.1 0.1,30.05 0.05))")],
            "k int, wkt string",
        ), "k",
    )
    spots = [(p, 30 + p % 60 * 0.2, p // 60 * 0.2) for p in range(60 * 60)]
    points = spark.createDataFrame(spots, "p int, lon double, lat double")
    where = points.select(F.col("lon").alias("px"), F.col("lat").alias("py"))
    place, depth = spatial._root(where, 0.25)
    levels = spatial._levels(where.withColumns(place(F.col("px"), F.col("py"))), (), depth)
    bins = {r["area"]: r["count"] for r in spatial.bins_near(areas, levels, 0.1).groupBy("area").count().collect()}
    assert set(bins) == {1, 2, 3} and max(bins.values()) < 100
    got = sorted((r["area"], r["p"], r["ring"]) for r in spatial.within_growing_buffer(areas, points).collect())
    rings = {}
    for row in areas.select("area", "edges").collect():
        for p, x, y in spots:
            away = math.inf
            for e in row["edges"]:
                dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
                t = min(1.0, max(0.0, ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / (dx * dx + dy * dy)))
                away = min(away, math.hypot(e["x1"] + t * dx - x, e["y1"] + t * dy - y))
            rings.setdefault(row["area"], []).append((max(1, math.ceil(away / 0.1 - 1e-9)), p))
    want = sorted((a, p, ring) for a, found in rings.items() for ring, p in found if ring == min(found)[0])
    assert got == want and len(got) >= 3


def test_no_points_no_buffer(spark):
    areas = areas_from_wkt(spark.createDataFrame([(1, "POLYGON((0 0,1 0,1 1,0 0))")], "k int, wkt string"), "k")
    points = spark.createDataFrame([(1, None, 2.0)], "p int, lon double, lat double")
    assert spatial.within_growing_buffer(areas, points).count() == 0
    assert spatial.within_growing_buffer(areas, points.filter("p = 2")).count() == 0
