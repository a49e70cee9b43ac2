"""Indices against plain-Python walks over small series."""

import math
import random
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.functions import gamma
from cellcast.operators import drought
from cellcast.operators import series as S

DAY0 = date(2001, 1, 1)


def series_of(spark, cells, name):
    rows = [(g, DAY0 + timedelta(t), float(v)) for g, xs in cells.items() for t, v in enumerate(xs)]
    return spark.createDataFrame(rows, f"gid long, fdate date, {name} double")


def by_cell(df, name="value"):
    out = {}
    for r in df.orderBy("gid", "fdate").collect():
        out.setdefault(r["gid"], []).append(r[name])
    return out


def make(seed, cells, days, low=0, high=30):
    rnd = random.Random(seed)
    return {g: [rnd.randint(low, high) for _ in range(days)] for g in range(cells)}


@pytest.mark.parametrize("duration,recovery", [(14, 2), (5, 3), (3, 1)])
def test_dry_spells_match_a_walk(spark, duration, recovery):
    cells = make(1, 4, 200)
    got = by_cell(drought.dry_spells(series_of(spark, cells, "rainf"), "rainf", duration, recovery))
    for g, xs in cells.items():
        limit = sum(xs) / len(xs)
        length = total = 0
        want = [0] * (recovery - 1)
        for i in range(recovery - 1, len(xs)):
            window = xs[i - recovery + 1: i + 1]
            length = 0 if min(window) > limit else length + 1
            total += length == duration
            want.append(total)
        assert got[g] == want
        assert all(a <= b for a, b in zip(got[g], got[g][1:]))


def test_severity_matches_counting(spark):
    cells = make(2, 3, 60, 0, 6)
    got = by_cell(drought.severity(series_of(spark, cells, "soil_moist")))
    for g, xs in cells.items():
        smooth = [np.mean(xs[max(0, i - 9): i + 1]) for i in range(len(xs))]
        for value, v in zip(got[g], smooth):
            below = sum(s < v - 1e-12 for s in smooth)
            upto = sum(s <= v + 1e-12 for s in smooth)
            assert value == pytest.approx(100 - (below + upto + 1) * 50 / len(smooth))


def _smdi_vector(xs):
    x = np.array(xs, float)
    median = [np.median(x[max(0, i - 6): i + 1]) for i in range(len(x))]
    sd = (np.array(median)[7:] - np.median(x)) / (x.max() - np.median(x)) * 100
    return sd


def test_smdi_both_modes(spark):
    cells = make(3, 2, 40)
    frame = series_of(spark, cells, "soil_moist").withColumn("layer", F.lit(2))
    vector = by_cell(drought.smdi(frame))
    recursive = by_cell(drought.smdi(frame, mode="recursive"))
    for g, xs in cells.items():
        sd = _smdi_vector(xs)
        out = np.zeros(len(xs))
        out[:7] = sd[:7] / 50
        shifted = out[6:-1].copy()
        out[7:] = 0.5 * shifted + sd / 50
        assert vector[g] == pytest.approx(np.clip(out, -4, 4).tolist())
        true = list(sd[:7] / 50)
        for v in sd:
            true.append(0.5 * true[-1] + v / 50)
        assert recursive[g] == pytest.approx(np.clip(true, -4, 4).tolist())


def test_rolling_rows_mean_has_no_partial_windows(spark):
    cells = {0: [1, 2, 3, 4, 5, 6], 1: [5, 5]}
    df = S.add_rolling_rows_mean(series_of(spark, cells, "v"), ["gid"], 3, "v", "m")
    assert by_cell(df, "m") == {0: [None, None, 2.0, 3.0, 4.0, 5.0], 1: [None, None]}


def test_rolling_rows_mean_skips_windows_with_nulls(spark):
    df = series_of(spark, {0: [1, 2, 3, 4, 5]}, "v")
    df = df.withColumn("v", F.when(F.col("v") != 2, F.col("v")))
    out = S.add_rolling_rows_mean(df, ["gid"], 2, "v", "m")
    assert by_cell(out, "m")[0] == [None, None, None, 3.5, 4.5]


def test_spi_shape_and_monotone(spark):
    rnd = np.random.default_rng(4)
    cells = {g: rnd.gamma(2.0, 3.0, 400).tolist() for g in range(3)}
    rain = series_of(spark, cells, "rainf")
    for fit in ("mle", "thom"):
        out = drought.spi(rain, 1, fit=fit)
        means = S.add_rolling_rows_mean(rain, ["gid"], 30, "rainf", "pm")
        rows = out.join(means, ["gid", "fdate"]).orderBy("gid", "fdate").collect()
        for g in cells:
            mine = [r for r in rows if r["gid"] == g]
            assert [r["value"] for r in mine[:30]] == [None] * 30
            pairs = sorted((r["pm"], r["value"]) for r in mine[30:])
            assert all(abs(v) <= 3.09 for _, v in pairs)
            assert all(a[1] <= b[1] + 1e-9 for a, b in zip(pairs, pairs[1:]))
            values = [v for _, v in pairs]
            assert abs(np.mean(values)) < 0.15 and 0.8 < np.std(values) < 1.2


def test_spi_warm_up_is_zero_in_compat_and_short_periods_give_none(spark):
    rain = series_of(spark, {0: list(range(1, 80))}, "rainf")
    out = by_cell(drought.spi(rain, 1, compat=True))
    assert out[0][:30] == [0.0] * 30
    assert drought.spi(rain, 3, start=DAY0, end=DAY0 + timedelta(40)) is None
    assert drought.spi(rain, 0, start=DAY0, end=DAY0 + timedelta(400)) is None


def test_gamma_cdf_against_integration():
    for a in (0.4, 1.0, 3.7, 60.0, 499.0, 800.0):
        x = a * np.array([0.2, 0.8, 1.0, 1.1, 2.0])
        got = gamma.cdf(x, a, 0.0, 1.0)
        for value, upper in zip(got, x):
            t = np.linspace(0, 1, 400001)[1:] ** 3 * upper
            density = np.exp((a - 1) * np.log(t) - t - math.lgamma(a))
            assert value == pytest.approx(np.trapezoid(density, t), abs=2e-5)


def test_gamma_fit_finds_a_good_optimum():
    x = np.random.default_rng(5).gamma(4.0, 2.0, 2000) + 3
    shape, loc, scale = gamma.fit_mle(x)
    assert shape * scale + loc == pytest.approx(x.mean(), rel=0.02)

    def loss(a, b, s):
        z = (x - b) / s
        return len(x) * (math.lgamma(a) + math.log(s)) - (a - 1) * np.log(z).sum() + z.sum()

    assert loss(shape, loc, scale) <= loss(4.0, 3.0 - 1e-9, 2.0) + 1e-6
    assert gamma.fit_mle(np.ones(10)) is None


def test_normal_quantile():
    ps = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    assert gamma.normal_quantile(ps) == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-7, abs=1e-8)
    edge = gamma.normal_quantile([0.0, 1.0, float("nan")])
    assert edge[0] == -math.inf and edge[1] == math.inf and math.isnan(edge[2])


def test_combined_level_last_match_wins(spark):
    rows = [(-2.0, 2.0, -2.0, 4), (-2.0, 0.0, -2.0, 3), (-2.0, 0.0, 2.0, 2), (-2.0, 2.0, 0.0, 1),
            (0.0, 2.0, -2.0, 0), (None, 2.0, -2.0, 0)]
    df = spark.createDataFrame(rows, "s double, m double, f double, want int")
    level = drought.combined_level(F.col("s"), F.col("m"), F.col("f"))
    assert all(r["got"] == r["want"] for r in df.withColumn("got", level).collect())


def test_index_names():
    assert drought.index_duration("spi12") == 12
    assert drought.index_duration("sri12", compat=True) == 1


def test_hot_cell_is_shrunk_before_the_window(spark):
    """A cell with a third of all raw rows has one row per day after pre-aggregation."""
    from cellcast.operators.common import daily_series

    raw = spark.range(90000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("gid"),
        F.date_add(F.lit(DAY0), (F.col("id") % 40).cast("int")).alias("day"),
        F.lit(1.0).alias("v"),
    )
    out = daily_series(raw, ["gid"], F.col("day"), rainf=F.sum("v"))
    assert out.groupBy("gid").count().agg(F.max("count")).first()[0] <= 40
    assert out.agg(F.sum("rainf")).first()[0] == 90000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2  # a partial one before the shuffle


def test_many_cells_are_fitted_as_each_alone():
    """All samples in step give what each gives alone, whatever the others need."""
    r = np.random.default_rng(12)
    samples = [r.gamma(k, 2.0, n) + 1 for k, n in ((1.2, 40), (3.0, 400), (60.0, 90), (8.0, 3))]
    samples += [np.full(9, 2.0), np.array([1.0, 2.0]), 10 - r.gamma(2.0, 1.0, 200), np.array([5.0])]
    starts = np.cumsum([0] + [len(s) for s in samples[:-1]])
    *params, inner = gamma.fit_profiles(np.concatenate(samples), starts)
    for i, s in enumerate(samples):
        alone, single = gamma.fit_profile(s)
        if alone is None:
            assert np.isnan(params[0][i]) and not inner[i]
        else:
            assert [p[i] for p in params] == pytest.approx(alone, rel=1e-4) and inner[i] == single
    assert list(inner[:3]) == [True] * 3 and not inner[6] and not np.isnan(params[0][6])


def test_cells_over_batch_edges(spark):
    """Cells cut by Arrow batches, of one row, without values and without a name."""
    rnd = np.random.default_rng(8)
    cells = {g: rnd.gamma(2.0, 3.0, n).tolist() for g, n in ((0, 95), (1, 40), (2, 1), (3, 130), (4, 64))}
    rain = series_of(spark, cells, "rainf")
    dry = series_of(spark, {9: [1.0] * 50}, "rainf").withColumn("rainf", F.lit(None).cast("double"))
    rain = rain.unionByName(dry)
    key = lambda df: {(r["gid"], r["fdate"]): (r["value"], r["method"]) for r in df.collect()}
    # Sums of other lengths round differently.
    alike = lambda a, b: a.keys() == b.keys() and all(
        a[k][1] == b[k][1] and a[k][0] == (None if b[k][0] is None else pytest.approx(b[k][0], abs=1e-6)) for k in b
    )
    want = key(drought.spi(rain, 1))
    assert {m for (g, _), (_, m) in want.items() if g in (2, 9)} == {"none"}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (1, 7, 40, 95):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert alike(key(drought.spi(rain, 1)), want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    lone = key(drought.spi(rain.filter("gid = 3"), 1))
    assert alike(lone, {k: v for k, v in want.items() if k[0] == 3}) and len(lone) == 130
