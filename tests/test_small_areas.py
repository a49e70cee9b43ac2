"""Areas smaller than a cell, or between centres, keep a value on any grid."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cellcast.operators import spatial
from cellcast.plans import flows
from cellcast.sources.polygons import areas_from_wkt


@pytest.mark.parametrize("res", [1.0, 0.25, 0.05])
def test_areas_without_a_centre_take_the_cell_of_their_centroid(spark, res):
    cells = [(r, c, 5.0 - res * r, 30.0 + res * c, float(10 * r + c)) for r in range(8) for c in range(8)]
    grid = spark.createDataFrame(cells, "row int, col int, lat double, lon double, value double")

    def box(x, y, w, h):
        """Lower left corner and size in cells, from the grid's corner centre."""
        a, b, c, d = 30.0 + res * x, 5.0 + res * y, 30.0 + res * (x + w), 5.0 + res * (y + h)
        return f"POLYGON(({a} {b},{c} {b},{c} {d},{a} {d},{a} {b}))"

    wkt = [
        (1, box(2.2, -1.8, 0.2, 0.2)),  # inside the cell of row 2, col 2
        (2, box(3.12, -3.88, 0.6, 3.6)),  # a strip between two columns of centres, centroid in row 2, col 3
        (3, box(2.4, -2.4, 1.2, 0.8)),  # holds the centre of row 2, col 3
        (4, box(80.0, -2.4, 0.2, 0.2)),  # off the grid
        (5, box(0.4, -1.6, 0.2, 0.2)),  # centroid on the edges of four cells
        (6, box(-0.5, -7.5, 8.0, 8.0)),  # the whole grid
    ]
    areas = areas_from_wkt(spark.createDataFrame(wkt, "k long, wkt string"), "k")
    member = spatial.zonal_membership(grid.drop("value"), areas)
    rows = sorted(tuple(r) for r in member.collect())
    assert [r[0] for r in rows[:4]] == [1, 2, 3, 5] and len(rows) == 4 + 64
    assert rows[0] == (1, 2, 2) and rows[1][1:] == (2, 3) and rows[2] == (3, 2, 3) and rows[3][1:] in [(r, c) for r in (1, 2) for c in (0, 1)]
    days = grid.withColumn("fdate", F.lit(date(2001, 1, 1)))
    got = {r["area"]: r["value"] for r in spatial.zonal_mean(days, member).collect()}
    assert got == {**{a: float(10 * r + c) for a, r, c in rows[:4]}, 6: 38.5}


def test_holes_in_the_index_and_a_single_cell(spark):
    box = lambda x, y: f"POLYGON(({x} {y},{x + 0.1} {y},{x + 0.1} {y + 0.1},{x} {y + 0.1},{x} {y}))"
    areas = areas_from_wkt(spark.createDataFrame([(1, box(1.2, -0.3)), (2, box(2.2, -0.3))], "k long, wkt string"), "k")
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 2, 0.0, 2.0)], "row int, col int, lat double, lon double")
    # The cell at column 1 is not stored.
    assert [tuple(r) for r in spatial.zonal_membership(cells, areas).collect()] == [(2, 0, 2)]
    single = cells.filter("col = 2")
    assert spatial.zonal_membership(single, areas).collect() == []
    assert [tuple(r) for r in spatial.zonal_membership(single, areas, res=1.0).collect()] == [(2, 0, 2)]


def test_crop_weather_takes_whole_tiles(spark):
    """An area inside one tile gets the mean of that tile, not of its own cells."""
    names = ("net_short", "net_long", "rainf", "tmax", "tmin")
    cells = [
        (r, c, date(2001, 1, d), v, float(100 * d + 10 * (r // 2) + (c // 2) + (r + c) % 2))
        for r in range(4) for c in range(4) for d in (1, 2) for v in names
    ]
    grid = spark.createDataFrame(cells, "row int, col int, fdate date, var string, value double")
    ring = "POLYGON((0.9 -0.1,1.1 -0.1,1.1 0.1,0.9 0.1,0.9 -0.1))"
    areas = areas_from_wkt(spark.createDataFrame([(7, ring)], "k long, wkt string"), "k")
    means = {r["fdate"].day: r["value"] for r in spatial.whole_tile_mean(grid.filter("var = 'rainf'"), areas, 1.0, 0.0, 0.0, size=2).collect()}
    assert means == {1: 100.5, 2: 200.5}
    out = flows.crop_weather(grid, areas, 1.0, 0.0, 0.0, members=3).collect()
    want = {(m, d, mean) for m in (1, 2, 3) for d, mean in _tile_means(cells).items()}
    assert len(out) == 6 and {(r["member"], r["fdate"].day, r["rain"]) for r in out} == want


def _tile_means(cells):
    """Mean over the one ten-by-ten tile that all cells lie in."""
    days = {}
    for _, _, day, var, value in cells:
        if var == "rainf":
            days.setdefault(day.day, []).append(value)
    return {d: sum(v) / len(v) for d, v in days.items()}
