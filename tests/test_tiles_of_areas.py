"""Whole tiles of an area are those its shape meets, not those its bounding box meets."""

import math
import random
from datetime import date, datetime
from fractions import Fraction

import duckdb
import pytest
from oracle import compare

import __spark_entry__ as entry
from cellcast.operators import spatial
from cellcast.plans import flows
from cellcast.sources.polygons import areas_from_wkt

STEP, TOP, LEFT = 2.5, 5.0, 30.0


def text(*rings):
    return "POLYGON(" + ",".join("(" + ",".join(f"{x!r} {y!r}" for x, y in (*r, r[0])) + ")" for r in rings) + ")"


def star(n, x, y, small, large, rng):
    turn = [2 * math.pi * k / n for k in range(n)]
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t in turn if (r := rng.uniform(small, large))]


def meets(rings, tile_y, tile_x):
    """One closed tile against one polygon, in fractions: some edge reaches into it, or its middle is inside."""
    x0, y1 = Fraction(LEFT) + tile_x * Fraction(STEP), Fraction(TOP) - tile_y * Fraction(STEP)
    x1, y0 = x0 + Fraction(STEP), y1 - Fraction(STEP)
    mx, my, odd = (x0 + x1) / 2, (y0 + y1) / 2, False
    for ring in rings:
        ring = [(Fraction(x), Fraction(y)) for x, y in ring]
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            lo, hi = Fraction(0), Fraction(1)  # the part of the edge between the sides
            for p, q in ((bx - ax, (x0 - ax, x1 - ax)), (by - ay, (y0 - ay, y1 - ay))):
                if p == 0:
                    if not q[0] <= 0 <= q[1]:
                        lo = Fraction(2)
                else:
                    lo, hi = max(lo, min(q[0] / p, q[1] / p)), min(hi, max(q[0] / p, q[1] / p))
            if lo <= hi:
                return True
            if (ay > my) != (by > my) and mx < (bx - ax) * (my - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def grid(spark, side=10):
    return spark.createDataFrame([(y, x) for y in range(side) for x in range(side)], "tile_y int, tile_x int")


def touching(spark, rows, side=10):
    areas = areas_from_wkt(spark.createDataFrame(rows, "k long, wkt string"), "k")
    got = [tuple(r) for r in spatial.tiles_touching(areas, grid(spark, side), STEP, TOP, LEFT).collect()]
    assert len(got) == len(set(got))
    return {r for r in got if 0 <= r[1] < side and 0 <= r[2] < side}


def test_equal_to_every_edge_of_every_tile(spark):
    rng = random.Random(5)
    shapes = {k: [star(rng.choice([3, 4, 30, 400]), rng.uniform(28, 56), rng.uniform(-21, 6), 0.1, rng.uniform(0.2, 12), rng)] for k in range(40)}
    shapes[50] = [[(31.0, 4.0), (53.0, 4.0), (53.0, -18.0), (31.0, -18.0)], [(36.0, -1.0), (48.0, -1.0), (48.0, -13.0), (36.0, -13.0)]]  # a hole over whole tiles
    shapes[51] = [[(32.5, 2.5), (35.0, 2.5), (35.0, 0.0), (32.5, 0.0)]]  # the sides of a tile: its neighbours share them
    shapes[52] = [[(30.125, 4.875), (54.875, -19.875), (54.875, -19.75)]]  # a long thin one through the corners of tiles
    shapes[53] = [[(0.0, -60.0), (90.0, -60.0), (40.0, 70.0)]]  # around all tiles
    shapes[54] = [[(31.0, 4.0), (32.0, 4.0), (32.0, 3.0), (31.0, 3.0)]]  # inside a tile
    got = touching(spark, [(k, text(*rings)) for k, rings in shapes.items()])
    want = {(k, y, x) for k, rings in shapes.items() for y in range(10) for x in range(10) if meets(rings, y, x)}
    assert got == want
    assert sum(k == 51 for k, _, _ in got) == 9 and sum(k == 53 for k, _, _ in got) == 100


def test_repeated_and_broken_areas(spark):
    rows = [(1, text([(31.0, 4.0), (53.0, 4.0), (53.0, -18.0), (31.0, -18.0)]))] * 2
    rows += [(2, "POLYGON((31 4,33 4,nan 3,31 3,31 4))"), (3, None), (None, None)]
    assert touching(spark, rows) == {(1, y, x) for y in range(10) for x in range(10)}


def test_mean_leaves_out_tiles_of_the_box_alone(spark):
    """A diamond whose box reaches the tile at its lower right: that tile is 100 times larger and must not count."""
    day = date(2001, 1, 1)
    cells = [(r, c, day, v, 100.0 if r >= 2 and c >= 2 else 1.0) for r in range(4) for c in range(4) for v in ("rainf", "tmax", "tmin", "net_short", "net_long")]
    frame = spark.createDataFrame(cells, "row int, col int, fdate date, var string, value double")
    # Tiles of two cells of one degree: sides at -0.5, 1.5, 3.5 and 0.5, -1.5, -3.5.
    wide = areas_from_wkt(spark.createDataFrame([(1, text([(0.0, -0.8), (0.9, 0.1), (1.8, -0.8), (0.9, -1.7)]))], "k long, wkt string"), "k")
    rain = frame.filter("var = 'rainf'")
    assert [r["value"] for r in spatial.whole_tile_mean(rain, wide, 1.0, 0.0, 0.0, size=2).collect()] == [1.0]
    assert [r["value"] for r in spatial.whole_tile_mean(rain, wide, 1.0, 0.0, 0.0, size=2, boxes=True).collect()] == [25.75]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One order per tile and day, of 1 + 100 * tile_y + 10 * tile_x + day; nations twice, and one without key."""
    path = tmp_path_factory.mktemp("tiles")
    orders = [
        (400 * y + 10 * (x % 4) + 14400 * (x // 4), datetime(1999, 5, d, 7), 1.0 + 100 * y + 10 * x + d)
        for y in range(5) for x in range(5) for d in (1, 2)
    ]
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k,) for k in [*range(25), *range(25), None]], "n_nationkey int").write.parquet(f"{path}/nation.parquet")
    return str(path)


def expected():
    """Mean over the tiles that a nation's diamond meets, per (area, day)."""
    out = {}
    for k in range(25):
        x, y = 31.03 + 2 * (k % 5), 4.06 - 2 * (k // 5)
        # Tiles start half a cell before the first centres.
        ring = [(x - 1.07 + 0.125, y - 0.125), (x + 0.125, y - 1.07 - 0.125), (x + 1.07 + 0.125, y - 0.125), (x + 0.125, y + 1.07 - 0.125)]
        met = [(i, j) for i in range(5) for j in range(5) if meets([ring], i, j)]
        for d in (1, 2):
            out[k, d] = sum(1.0 + 100 * i + 10 * j + d for i, j in met) / len(met)
    return out


def run(spark, tables, name):
    """Rows of a query, held against its SQL over the same tables."""
    con = duckdb.connect()
    for t in ("orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    df = entry.queries()[name](spark, tables)
    rows, _, error = compare(df, con, entry.oracle_sql()[name])
    assert error is None and rows > 0, error
    return df.collect()


def test_area_weather(spark, tables):
    got = {(r["area"], int(r["fdate"][-2:])): (r["radiation"], r["rainf"], r["tmax"], r["tmin"]) for r in run(spark, tables, "area_weather")}
    assert got == {at: pytest.approx((2 * v, v / 2, 2 * v, 1.5 * v), abs=2e-6) for at, v in expected().items()}


def test_weather_table(spark, tables):
    got = {(r["area"], int(r["fdate"][-2:]), r["member"]): (r["srad"], r["tmax"], r["tmin"], r["rain"]) for r in run(spark, tables, "weather_table")}
    want = {(*at, m): pytest.approx((2 * v * 0.0864, 2 * v, 1.5 * v, v / 2), abs=2e-6) for at, v in expected().items() for m in (1, 2, 3)}
    assert got == want


def test_crop_weather_leaves_out_tiles_of_the_box_alone(spark):
    """The plan of the same name: a diamond beside the corner of a tile a hundred times larger."""
    cells = [
        (r, c, date(2001, 1, 1), v, 100.0 if r >= 10 and c >= 10 else 1.0)
        for r in range(20) for c in range(20) for v in ("rainf", "tmax", "tmin", "net_short", "net_long")
    ]
    frame = spark.createDataFrame(cells, "row int, col int, fdate date, var string, value double")
    areas = areas_from_wkt(spark.createDataFrame([(1, text([(4.0, -8.0), (8.0, -4.0), (12.0, -8.0), (8.0, -12.0)]))], "k long, wkt string"), "k")
    assert {r["rain"] for r in flows.crop_weather(frame, areas, 1.0, 0.0, 0.0, members=2).collect()} == {25.75}
    small = areas_from_wkt(spark.createDataFrame([(1, text([(4.0, -8.0), (8.0, -4.0), (10.4, -8.0), (8.0, -10.4)]))], "k long, wkt string"), "k")
    assert {r["rain"] for r in flows.crop_weather(frame, small, 1.0, 0.0, 0.0, members=2).collect()} == {1.0}


def test_zonal_wide(spark, tables):
    got = {int(r["fdate"][-2:]): [r[f"p{k}"] for k in range(1, 26)] for r in run(spark, tables, "zonal_wide")}
    assert got == {d: pytest.approx([expected()[k, d] for k in range(25)], abs=2e-6) for d in (1, 2)}
