"""Samplers by support, determinism and mass."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cellcast.functions import rng
from cellcast.operators import ensemble as E
from cellcast.operators import terciles as T
from cellcast.operators.series import nearest_date


def test_draws_do_not_depend_on_partitions(spark):
    ids = spark.range(500).withColumn("u", rng.uniform(7, F.col("id")))
    a = {r["id"]: r["u"] for r in ids.collect()}
    b = {r["id"]: r["u"] for r in spark.range(500).repartition(9).withColumn("u", rng.uniform(7, F.col("id"))).collect()}
    assert a == b and all(0 <= u < 1 for u in a.values())
    assert 0.45 < sum(a.values()) / 500 < 0.55


@pytest.mark.parametrize("portable", [True, False])
def test_normal_moments(spark, portable):
    z = spark.range(20000).select(rng.normal(3, F.col("id"), portable=portable).alias("z"))
    m, s = z.agg(F.avg("z"), F.stddev_samp("z")).first()
    assert abs(m) < 0.03 and abs(s - 1) < 0.03


def years(spark, first, last):
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def test_esp_cycles_all_years_before_repeating(spark):
    out = [r["year"] for r in E.esp_years(years(spark, 1990, 1996), 10, 5).orderBy("ensemble").collect()]
    assert len(out) == 10 and set(out[:7]) == set(range(1990, 1997)) and out[:3] == out[7:]


def test_esp_with_fewer_members_than_years(spark):
    out = E.esp_years(years(spark, 1990, 1999), 3, 5).collect()
    assert len(out) == 3 and len({r["year"] for r in out}) == 3


def test_random_years_leave_out_the_newest(spark):
    out = {r["year"] for r in E.random_years(years(spark, 1990, 1993), 200, 1).collect()}
    assert out == {1990, 1991, 1992}
    assert {r["year"] for r in E.random_years(years(spark, 1990, 1990), 5, 1).collect()} == {1990}


def test_spin_up_length_ignores_leap_days(spark):
    drawn = spark.createDataFrame([(1, 2000), (2, 2001)], "ensemble int, year int")
    out = E.random_windows(drawn, F.lit("2010-03-10").cast("date"), 90).collect()
    assert all((r["to_date"] - r["from_date"]).days == 90 for r in out)


def test_perturbed_weather_keeps_its_constraints(spark):
    rows = [(g, date(2001, 1, 1) + timedelta(t), float(g), 30.0, 20.0, 2.0) for g in range(3) for t in range(300)]
    f = spark.createDataFrame(rows, "gid int, fdate date, prec double, tmax double, tmin double, wind double")
    out = E.perturb(f, 4, 9)
    assert out.count() == 3600
    stats = out.groupBy("gid").agg(
        F.avg("prec").alias("m"), F.stddev("prec").alias("s"), F.avg("tmax").alias("t"),
        F.stddev(0.5 * (F.col("tmax") + F.col("tmin"))).alias("ts"), F.min("wind").alias("w"),
    ).orderBy("gid").collect()
    assert (stats[0]["m"], stats[0]["s"]) == (0.0, 0.0)
    assert stats[2]["m"] == pytest.approx(2.0, abs=0.06) and stats[2]["s"] == pytest.approx(0.5, abs=0.05)
    assert stats[1]["t"] == pytest.approx(30, abs=0.4) and stats[1]["w"] == 2.0
    # tmax' + tmin' = 4 m - (tmin + tmax), so the mean moves by twice the draw minus itself.
    assert stats[1]["ts"] == pytest.approx(4.0, abs=0.3)


def test_strata_sizes(spark):
    ranks = spark.range(1, 11).select(F.col("id").cast("int").alias("rid"))
    sizes = lambda n: [
        r["count"] for r in T.strata(ranks.filter(F.col("rid") <= n), n).groupBy("pg").count().orderBy("pg").collect()
    ]
    assert sizes(9) == [3, 4, 2] and sizes(10) == [3, 4, 3]


def chances(spark, below, normal, above):
    rows = [(1, 1, "below", below), (1, 1, "normal", normal), (1, 1, "above", above)]
    return spark.createDataFrame(rows, "gid int, leadtime int, tercile string, prob double")


def climate(spark):
    rows = [(1, date(1990 + y, 5, 1), float((7 * y) % 9)) for y in range(9)]
    return spark.createDataFrame(rows, "gid int, fdate date, value double")


def test_cdf_ends_at_one_and_every_draw_hits(spark):
    probs = chances(spark, 20.0, 30.0, 50.0)
    cdf = T.resampling_cdf(climate(spark), probs, [5], ["gid"]).orderBy("psum").collect()
    assert cdf[-1]["w1"] == 1.0 and cdf[0]["w2"] == 0.0
    assert all(a["w1"] == b["w2"] for a, b in zip(cdf, cdf[1:]))
    drawn = T.resample(climate(spark), probs, [5], 400, 3, ["gid"])
    assert drawn.count() == 400


def test_sure_tercile_draws_only_its_years(spark):
    drawn = T.resample(climate(spark), chances(spark, 0.0, 0.0, 100.0), [5], 50, 3, ["gid"])
    wettest = {r["yr"] for r in drawn.collect()}
    sums = {r["yr"]: r["psum"] for r in T.season_sums(climate(spark), [5], ["gid"]).collect()}
    assert min(sums[y] for y in wettest) >= 7.0


def test_nearest_date_both_directions(spark):
    catalog = spark.createDataFrame(
        [(1, "a", date(2000, 1, 1)), (1, "b", date(2000, 2, 1)), (1, "c", date(2000, 2, 1))],
        "name int, filename string, fdate date",
    )
    asked = spark.createDataFrame(
        [(1, date(2000, 1, 10)), (1, date(2000, 1, 25)), (1, date(1999, 5, 1)), (1, date(2001, 1, 1)), (2, date(2000, 1, 1))],
        "name int, fdate date",
    )
    out = {(r["name"], r["fdate"]): r["filename"] for r in nearest_date(asked, catalog, ["name"], "filename").collect()}
    assert out[(1, date(2000, 1, 10))] == "a" and out[(1, date(2000, 1, 25))] == "b"
    assert out[(1, date(1999, 5, 1))] == "a" and out[(1, date(2001, 1, 1))] == "b"
    assert out[(2, date(2000, 1, 1))] is None


def test_warm_up_is_reset_when_the_state_is_old(spark):
    catalog = spark.createDataFrame([(1, "old", date(1990, 1, 1)), (2, "new", date(1999, 12, 1))],
                                    "name int, filename string, fdate date")
    asked = spark.createDataFrame([(k, date(2000, 3, 1)) for k in (1, 2, 3)], "name int, fdate date")
    out = {r["name"]: (r["filename"], r["start"]) for r in E.warm_up_choice(asked, catalog, ["name"]).collect()}
    assert out == {1: (None, date(1999, 3, 1)), 2: ("new", date(1999, 12, 1)), 3: (None, date(1999, 3, 1))}


def test_temperature_is_rebuilt_over_new_year(spark):
    history = spark.createDataFrame(
        [(1, date(1995, 12, 30) + timedelta(k), 10.0 + k, 5.0, 1.0) for k in range(5)],
        "gid int, fdate date, tmax double, tmin double, wind double",
    )
    ahead = spark.createDataFrame(
        [(1, date(2000, 12, 30) + timedelta(k), 1, 20.0) for k in range(5)], "gid int, fdate date, ensemble int, temp double"
    )
    year = spark.createDataFrame([(1995,)], "year int")
    out = E.rebuild_temperature(ahead, history, year, F.lit("2000-12-30").cast("date")).orderBy("fdate").collect()
    assert [r["tmax"] for r in out] == [22.5, 23.0, 23.5, 24.0, 24.5]


def test_multi_source_members(spark):
    cells = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "dataset string, value double")
    out = E.multi_source_ensemble(cells, ["a", "b"], 5).orderBy("ensemble").collect()
    assert [r["dataset"] for r in out] == ["a", "b", "a", "b", "a"]


def test_cycled_variants(spark):
    v = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "variant int, p double")
    out = E.cycle_variants(v, ["p"], ["variant"], 5).orderBy("ensemble").collect()
    assert [r["variant"] for r in out] == [1, 3, 1, 3, 1]
