"""Results that earlier limits cut: no line, point, delivery or rank goes missing."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.functions import gamma
from cellcast.operators import loads, series, spatial
from cellcast.sources import tables, text
from cellcast.streaming import jobs

DAY = date(2001, 1, 1)


def test_long_soil_profiles_keep_every_line(spark):
    lines = ["*AB01 name", "@SITE", "x here 1.5 2.5 y"] + [f"  {i} a 0.1" for i in range(1, 10_051)]
    row = text.parse_soil_profiles(spark.createDataFrame([("\n".join(lines),)], "value string")).first()
    assert len(row["bottoms"]) == 10_050


def test_percentile_rank_skips_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 1.0), (1, 2.0), (1, 2.0)], "gid int, v double")
    got = [r["p"] for r in series.percentile_of_score(df, ["gid"], "v", "p").orderBy(F.col("v").asc_nulls_last()).collect()]
    assert got == [pytest.approx(100 / 3), pytest.approx(250 / 3), pytest.approx(250 / 3), None, None]


@pytest.mark.parametrize("low,high,finest", [(0.0, 360.0, 0.5), (-400.0, -100.0, 1.0), (2e5, 9e5, 500.0)])
def test_nearest_join_equals_all_pairs_anywhere(spark, low, high, finest):
    rng = np.random.default_rng(3)
    points = rng.uniform(low, high, (300, 2))
    targets = rng.uniform(low - (high - low), high + (high - low), (200, 2))
    p = spark.createDataFrame([(i, *map(float, xy)) for i, xy in enumerate(points)], "p int, px double, py double")
    t = spark.createDataFrame([(i, *map(float, xy)) for i, xy in enumerate(targets)] + [(999, None, 1.0)], "t int, x double, y double")
    got = {r["t"]: (r["p"], r["distance"]) for r in spatial.nearest_join(t, p, ("x", "y"), ("px", "py"), "p", finest=finest).collect()}
    assert got.pop(999) == (None, None) and len(got) == 200
    for i, xy in enumerate(targets):
        gaps = np.hypot(*(points - xy).T)
        assert got[i][0] == int(gaps.argmin()) and got[i][1] == pytest.approx(gaps.min())


def test_nearest_join_without_points_keeps_targets(spark):
    p = spark.createDataFrame([], "p int, px double, py double")
    t = spark.createDataFrame([(1, 2.0, 3.0)], "t int, x double, y double")
    assert spatial.nearest_join(t, p, ("x", "y"), ("px", "py"), "p").first()["p"] is None


def cells(spark, var, value, rows=(0, 1), member=None):
    out = [(var, "a", DAY, r, 0, float(value), member) for r in rows]
    return spark.createDataFrame(out, "var string, dataset string, fdate date, row int, col int, value double, ensemble int")


def test_deliveries_of_one_date_stand_side_by_side(spark, tmp_path):
    path = str(tmp_path / "cells")
    for var, value, member in (("tmax", 1, 1), ("tmin", 2, 1), ("tmin", 3, 2), ("tmax", 9, 1)):
        tables.write_cells(cells(spark, var, value, member=member), path)
    got = {(r["var"], r["ensemble"]): (r["n"], r["v"]) for r in spark.read.parquet(path).groupBy("var", "ensemble").agg(F.count("*").alias("n"), F.max("value").alias("v")).collect()}
    assert got == {("tmax", 1): (2, 9.0), ("tmin", 1): (2, 2.0), ("tmin", 2): (2, 3.0)}


def test_a_date_split_over_batches_is_whole(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    schema = cells(spark, "tmax", 0).schema
    for rows, value in (((0,), 1), ((1,), 2), ((1,), 5)):
        cells(spark, "tmax", value, rows).coalesce(1).write.mode("append").parquet(landing)
        jobs.daily_ingest(spark, landing, schema, lambda df: df, out, mark).awaitTermination(120)
    assert {r["row"]: r["value"] for r in spark.read.parquet(out).collect()} == {0: 1.0, 1: 5.0}


def test_member_column_is_added_once(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    cells(spark, "tmax", 1).drop("ensemble").write.parquet(old)
    assert loads.rewrite_with_member(spark, old, 0, new)
    assert {r["ensemble"] for r in spark.read.parquet(new).collect()} == {0}
    assert not loads.rewrite_with_member(spark, new, 0, str(tmp_path / "again"))


@pytest.mark.parametrize("shape,loc,scale", [(4, 3, 2), (30, -5, 0.5), (1.6, 10, 3)])
def test_gamma_fit_is_a_maximum(shape, loc, scale):
    x = np.random.default_rng(8).gamma(shape, scale, 900) + loc
    (a, b, s), inner = gamma.fit_profile(x)
    assert inner

    def loss(a, b, s):
        z = (x - b) / s
        return len(x) * (math.lgamma(a) + math.log(s)) - (a - 1) * np.log(z).sum() + z.sum()

    here = loss(a, b, s)
    for da, db, ds in np.random.default_rng(2).normal(0, 1, (60, 3)) * 1e-3:
        assert loss(a * (1 + da), b - abs(db) * s, s * (1 + ds)) >= here - 1e-7 * abs(here)
    step = 1e-5
    slopes = [(loss(a + step, b, s) - loss(a - step, b, s)), (loss(a, b + step, s) - loss(a, b - step, s)), (loss(a, b, s + step) - loss(a, b, s - step))]
    assert max(map(abs, slopes)) / (2 * step) < 0.05


def test_left_skewed_samples_reach_the_edge():
    x = -np.random.default_rng(1).gamma(4, 1, 500)
    params, inner = gamma.fit_profile(x)
    assert not inner
    z = gamma.standard_score(x, *params, 5)
    assert np.isfinite(z).all() and abs(z.std() - 1) < 0.1


def test_distribution_function_has_no_step_between_methods():
    a = np.array([499.999, 500.0, 500.001])
    values = gamma.cdf(a + 10, a, 0.0, 1.0)
    assert abs(values[2] - 2 * values[1] + values[0]) < 1e-12


def test_table_is_replaced_under_its_readers(spark, tmp_path):
    """Who opened the old version keeps it, who opens the table later gets the new one, and a half-done write shows nothing."""
    root = str(tmp_path / "table")
    assert loads.current(spark, root) is None and not loads.add_member_column(spark, root, 1)
    old = spark.createDataFrame([(1, 2.0)], "gid int, value double").selectExpr("*", "date'2020-01-01' AS fdate")
    assert loads.publish(old, root) == 1
    reader = loads.current(spark, root)
    loads.replace_dates(old.withColumn("value", F.lit(9.0)), root + "/data-unnamed")  # stored, not yet in the ledger
    assert loads.current(spark, root).first()["value"] == 2.0
    assert loads.add_member_column(spark, root, 4)
    assert "ensemble" not in reader.columns and reader.count() == 1
    new = loads.current(spark, root)
    assert [(r["gid"], r["ensemble"], r["value"], str(r["fdate"])) for r in new.collect()] == [(1, 4, 2.0, "2020-01-01")]
    assert not loads.add_member_column(spark, root, 5)
    assert loads.publish(old, root) == 3 and "ensemble" not in loads.current(spark, root).columns


def test_path_patterns(spark, tmp_path):
    """Dates come from the paths: padded or not, in folders or names, with signs that globs read otherwise."""
    from datetime import date

    from cellcast.sources import normalisers

    rows = spark.createDataFrame([(0.0, 30.0, 1.5)], "lat double, lon double, raw double")
    cases = [("y {0}[a]/m{1}/{2}", lambda t: f"y {t.year}[a]/m{t.month}/{t.day}"), ("{0:04d}{1:02d}/x_{2:02d}.d", lambda t: f"{t:%Y%m}/x_{t:%d}.d")]
    for k, (pattern, name) in enumerate(cases):
        base = str(tmp_path / f"case{k}")
        for t in (date(2020, 1, 1), date(2020, 1, 11), date(2020, 2, 1), date(2021, 1, 1)):
            rows.write.parquet(f"{base}/{name(t)}")
        options = {"path": f"{base}/{pattern}", "res": "0.25", "table": "precip.local"}
        read = lambda a, b: normalisers.user_dataset(spark, options, a, b)  # noqa: E731, B023
        found = sorted(str(r["fdate"]) for r in read(date(2020, 1, 2), date(2021, 1, 1)).collect())
        assert found == ["2020-01-11", "2020-02-01", "2021-01-01"]
        assert read(date(2019, 1, 1), date(2019, 12, 31)) is None
