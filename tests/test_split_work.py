"""Ranks, grids and scans that are split over tasks, and pools of whole seasons."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cellcast.operators import ensemble as E
from cellcast.operators import grid
from cellcast.operators import series as S
from cellcast.plans import flows


def test_tile_numbers_have_no_gaps(spark):
    rng = random.Random(3)
    cells = [(rng.randrange(-40, 300), rng.randrange(0, 500)) for _ in range(700)]
    out = grid.tile_rank(spark.createDataFrame(cells, "row int, col int"), 7)
    order = {t: i for i, t in enumerate(sorted({(c // 7, r // 7) for r, c in cells}), 1)}
    rows = out.collect()
    assert len(rows) == len(cells) and all(r["tile"] == order[r["tile_x"], r["tile_y"]] for r in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(tile_y" not in plan and "windowspecdefinition(tile_x" in plan
    assert grid.tile_rank(spark.createDataFrame([], "row int, col int")).count() == 0


@pytest.mark.parametrize("chunk", [1, 5, 1 << 16])
def test_grids_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(grid, "CHUNK", chunk)
    rng = random.Random(4)
    points = [(k, 10 - 0.5 * rng.randrange(0, 6 + k), 20 + 0.5 * rng.randrange(0, 4 + k), float(i)) for k in (1, 2) for i in range(9)]
    points.append((3, 0.0, 0.0, 7.0))
    df = spark.createDataFrame(points, "k int, lat double, lon double, value double")
    got = {(r["k"], r["row"], r["col"]): r["value"] for r in grid.dense_grid(df, 0.5, ["k"]).collect()}
    want = {}
    for k in (1, 2, 3):
        mine = [p for p in points if p[0] == k]
        top, left = max(p[1] for p in mine), min(p[2] for p in mine)
        rows = round((top - min(p[1] for p in mine)) / 0.5) + 1
        cols = round((max(p[2] for p in mine) - left) / 0.5) + 1
        want.update({(k, r, c): grid.NODATA for r in range(rows) for c in range(cols)})
        for _, lat, lon, v in sorted(mine):
            want[k, round((top - lat) / 0.5), round((lon - left) / 0.5)] = v
    assert got == want


def test_one_large_grid_uses_many_tasks(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (1, 999.0, 799.0, 2.0)], "k int, lat double, lon double, value double")
    out = grid.dense_grid(df, 1.0, ["k"])
    assert out.count() == 800_000
    assert out.groupBy(F.spark_partition_id()).count().count() > 1


def test_scan_equals_a_loop(spark):
    rng = random.Random(6)
    rows = []
    want = {}
    for gid, length, broken in ((1, 200, None), (2, 33, None), (3, 64, 40), (4, 5, None), (5, 130, 0)):
        last = None
        for i in range(-3, length):
            x = None if i == broken else rng.uniform(-1, 1) * 10 ** rng.randrange(0, 4)
            rows.append((gid, i, x))
            last = x if i <= 0 else None if last is None or x is None else 0.5 * last + x
            want[gid, i] = last
    df = spark.createDataFrame(rows, "gid int, q int, x double").repartition(5)
    got = {(r["gid"], r["q"]): r["r"] for r in S.half_carried(df, "x", "q", "r").collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, rel=1e-12, abs=1e-12), k


def history(spark, gaps=()):
    """Two cells from 2000 to the middle of a season in 2004."""
    first, rows = date(2000, 1, 1), []
    for k in range((date(2004, 4, 10) - first).days):
        day = first + timedelta(k)
        rows += [(g, day, float(k), k + 1.0, k - 1.0, 2.0) for g in (1, 2) if (g, day) not in gaps]
    return spark.createDataFrame(rows, "gid int, fdate date, prec double, tmax double, tmin double, wind double")


def test_members_come_from_whole_seasons(spark):
    """Data that end within a season, and one with a gap in one cell, are not drawn from."""
    gap = (2, date(2002, 3, 20))
    table = history(spark, {gap})
    years = sorted(r["year"] for r in E.whole_seasons(table, 3, 15, 40).collect())
    assert years == [2000, 2001, 2003]
    gaps = sorted(tuple(r) for r in E.season_gaps(table, 3, 15, 40).select("gid", "year", "found", "missing").collect())
    assert gaps == [(1, 2004, 26, 14), (2, 2002, 39, 1), (2, 2004, 26, 14)]
    out = flows.forecast_forcings("esp", table, date(2005, 3, 15), date(2005, 4, 23), 7, 1)
    lengths = out.groupBy("ensemble", "gid").count().collect()
    assert len(lengths) == 14 and {r["count"] for r in lengths} == {40}


def test_seasons_over_new_year_and_long_ones(spark):
    table = history(spark)
    assert sorted(r["year"] for r in E.whole_seasons(table, 12, 1, 62).collect()) == [2000, 2001, 2002, 2003]
    assert sorted(r["year"] for r in E.whole_seasons(table, 2, 1, 800).collect()) == [2000, 2001, 2002][:2]
    assert E.whole_seasons(table.filter("gid = 9"), 3, 1, 10).count() == 0
