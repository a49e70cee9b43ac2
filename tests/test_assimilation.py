"""Filters against direct matrix formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.operators import assimilation as A

N = 6


def case(seed, nstate, nobs):
    r = np.random.default_rng(seed)
    return (r.normal(5, 2, (nstate, N)), r.normal(4, 1, (nobs, N)), r.normal(4, 1, (nobs, 1)),
            r.normal(0, 0.5, (nobs, N)))


def root(m):
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.sqrt(np.clip(w, 0, None))) @ v.T


def direct(method, a, ha, d, e):
    n = a.shape[1]
    ha_mean, a_mean = ha.mean(1, keepdims=True), a.mean(1, keepdims=True)
    y, x = ha - ha_mean, a - a_mean
    if method == "letkf":
        r = np.diag(np.diag(e @ e.T / (n - 1)))
        c = y.T @ np.linalg.pinv(r)
        p = np.linalg.pinv((n - 1) * np.eye(n) / 1.05 + c @ y)
        w = root((n - 1) * p) + p @ c @ (d - ha_mean)
        return x @ w + a_mean
    if method == "enkf":
        dp = d + e.mean(1, keepdims=True) - ha
        u, s, _ = np.linalg.svd(y + e, full_matrices=False)
        inv = 1 / s**2
        inv[np.cumsum(s) / s.sum() > 0.999] = 0
        return a + x @ y.T @ (u * inv) @ u.T @ dp
    u0, s0, _ = np.linalg.svd(y, full_matrices=False)
    inv = 1 / np.maximum(s0, 1e-300)
    inv[np.where(np.cumsum(inv) / inv.sum() > 0.999)[0][0]:] = 0
    x0 = inv[:, None] * u0.T @ e
    u1, s1, _ = np.linalg.svd(x0, full_matrices=False)
    x1 = u0 * inv @ u1
    y4 = y.T @ x1 @ (x1.T @ (d - ha_mean) / (1 + s1**2)[:, None])
    x2 = np.sqrt(1 / (1 + s1**2))[:, None] * (x1.T @ y)
    _, s2, v2 = np.linalg.svd(x2, full_matrices=True)
    pad = np.zeros(n)
    pad[: len(s2)] = s2
    # The rotation makes members random; their mean shift and covariance are not.
    return a_mean + x @ y4, x @ v2.T @ np.diag(np.clip(1 - pad**2, 0, None)) @ v2 @ x.T


def frames(spark, cases):
    states, obs = [], []
    for day, (a, ha, d, e) in cases.items():
        states += [(i, day, row.tolist()) for i, row in enumerate(a)]
        obs += [(day, ha[k].tolist(), float(d[k, 0]), e[k].tolist()) for k in range(len(d))]
    return (
        spark.createDataFrame(states, "gid long, fdate int, a array<double>"),
        spark.createDataFrame(obs, "fdate int, ha array<double>, d double, e array<double>"),
    )


@pytest.mark.parametrize("method", ["letkf", "enkf", "sqrtenkf"])
def test_filters_match_matrix_formulas(spark, method):
    cases = {1: case(1, 9, 25), 2: case(2, 5, 4), 3: case(3, 4, 6)}
    states, obs = frames(spark, cases)
    out = A.analyse(states.repartition(4), obs.repartition(5), method, salts=3).collect()
    assert len(out) == 18
    for day, (a, ha, d, e) in cases.items():
        want = direct(method, a, ha, d, e)
        got = {r["gid"]: r["xa"] for r in out if r["fdate"] == day}
        rows = np.array([got[i] for i in range(len(a))])
        if method == "sqrtenkf":
            centre, covariance = want
            assert (rows - centre) @ (rows - centre).T == pytest.approx(covariance, abs=1e-6)
        else:
            assert rows == pytest.approx(want, abs=1e-6)


def test_huge_errors_leave_the_mean(spark):
    a, ha, d, e = case(7, 5, 10)
    states, obs = frames(spark, {1: (a, ha, d, e * 1e6)})
    out = A.analyse(states, obs, "letkf").collect()
    for r in out:
        assert np.mean(r["xa"]) == pytest.approx(np.mean(r["a"]), abs=1e-6)


def test_dates_without_observations_keep_their_state(spark):
    states, obs = frames(spark, {1: case(1, 3, 5), 2: case(2, 3, 5)})
    out = A.analyse(states, obs.filter("fdate = 1"), "letkf").filter("fdate = 2").collect()
    assert len(out) == 3 and all(r["a"] == r["xa"] for r in out)


def test_result_does_not_depend_on_partitions(spark):
    states, obs = frames(spark, {1: case(1, 30, 50)})
    one = A.analyse(states.coalesce(1), obs.coalesce(1), "enkf", salts=1)
    many = A.analyse(states.repartition(7), obs.repartition(9), "enkf", salts=7)
    key = lambda df: {r["gid"]: r["xa"] for r in df.collect()}
    a, b = key(one), key(many)
    for g in a:
        assert a[g] == pytest.approx(b[g], abs=1e-8)


def test_update_gaps():
    assert [A.update_gap(u) for u in (None, "weekly", "monthly", "daily", "all", 5)] == [1, 7, 30, 1, -1, 5]


def test_unknown_distribution_falls_back(spark):
    obs = spark.range(50).select(F.col("id").alias("gid"))
    out = A.error_draws(obs, 8, 1, ["gid"], F.lit(0.01), F.lit("nonsense,1,2"))
    values = [v for r in out.collect() for v in r["e"]]
    assert 0.005 < np.std(values) < 0.015
    wide = A.error_draws(obs, 8, 1, ["gid"], F.lit(0.01), F.lit("uniform,5,1"))
    assert all(5 <= v < 6 for r in wide.collect() for v in r["e"])


def test_swe_update_cases(spark):
    rows = [(0.5, 10.0, 5.0), (0.5, 10.0, -1.0), (0.0, 0.0, 20.0)]
    df = spark.createDataFrame(rows, "part double, x double, xa double")
    out = df.select(A.update_swe(F.col("part"), F.col("x"), F.col("xa")).alias("u")).collect()
    scaled, cleared, fresh = (r["u"] for r in out)
    assert scaled["swe"] == 0.25 and scaled["coverage"] is None and scaled["cleared"] == 0
    assert cleared["swe"] == 0 and cleared["age"] == 0 and cleared["cleared"] == 1
    assert fresh["swe"] == 0.02 and fresh["coverage"] == 1.0 and fresh["density"] == 150.0
    assert fresh["cold_content"] == pytest.approx(-2102.0 * 1000 * 0.02 * 273.15)


def test_area_weighted_state_counts_bare_soil(spark):
    rows = [(1, 0.3, 0.6, 10.0), (1, 0.3, 0.4, 20.0), (1, None, 0.6, 5.0), (1, None, 0.4, 1.0)]
    df = spark.createDataFrame(rows, "gid int, veg_frac double, band_frac double, value double")
    got = A.area_weighted_state(df, ["gid"]).first()["value"]
    assert got == pytest.approx(0.3 * (6 + 8) + 0.7 * (3 + 0.4))


def placed(spark, seed, nstate, nobs, width=12.0):
    a, ha, d, e = case(seed, nstate, nobs)
    r = np.random.default_rng(seed + 50)
    at, seen = r.uniform(-width / 2, width / 2, (nstate, 2)), r.uniform(-width / 2, width / 2, (nobs, 2))
    states = spark.createDataFrame(
        [(i, 1, float(at[i, 0]), float(at[i, 1]), a[i].tolist()) for i in range(nstate)], "gid long, fdate int, lon double, lat double, a array<double>"
    )
    obs = spark.createDataFrame(
        [(1, float(seen[k, 0]), float(seen[k, 1]), ha[k].tolist(), float(d[k, 0]), e[k].tolist()) for k in range(nobs)],
        "fdate int, lon double, lat double, ha array<double>, d double, e array<double>",
    )
    return (a, ha, d, e, at, seen), states, obs


def gaspari_cohn(z):
    near = -z**5 / 4 + z**4 / 2 + 5 * z**3 / 8 - 5 * z**2 / 3 + 1
    far = z**5 / 12 - z**4 / 2 + 5 * z**3 / 8 + 5 * z**2 / 3 - 5 * z + 4 - 2 / (3 * np.maximum(z, 1e-9))
    return np.where(z <= 1, near, np.where(z < 2, far, 0.0))


def test_local_analysis_equals_dense_matrices(spark):
    """Each patch against whole matrices with the error covariance divided by the taper."""
    (a, ha, d, e, at, seen), states, obs = placed(spark, 21, 60, 80)
    got = {r["gid"]: r["xa"] for r in A.analyse_local(states.repartition(3), obs.repartition(5), 3.0, 0.75).collect()}
    alone = 0
    for i in range(len(a)):
        centre = (np.floor(at[i] / 0.75) + 0.5) * 0.75
        share = gaspari_cohn(np.hypot(*(seen - centre).T) / 1.5)
        near = share > 0
        if not near.any():
            alone += 1
            assert got[i] == a[i].tolist()
            continue
        r = np.diag(np.diag(e[near] @ e[near].T / (N - 1)) / share[near])
        y = ha[near] - ha[near].mean(1, keepdims=True)
        c = y.T @ np.linalg.inv(r)
        p = np.linalg.pinv((N - 1) * np.eye(N) / 1.05 + c @ y)
        w = root((N - 1) * p) + p @ c @ (d[near] - ha[near].mean(1, keepdims=True))
        assert got[i] == pytest.approx((a[i] - a[i].mean()) @ w + a[i].mean(), abs=1e-7)
    assert alone < len(a) / 2


def test_local_analysis_far_radius_is_the_analysis_with_all(spark):
    _, states, obs = placed(spark, 22, 20, 30)
    whole = {r["gid"]: r["xa"] for r in A.analyse(states, obs.drop("lon", "lat"), "letkf").collect()}
    far = {r["gid"]: r["xa"] for r in A.analyse_local(states, obs, 1e7, 100.0).collect()}
    assert set(far) == set(whole) and all(far[g] == pytest.approx(whole[g], abs=1e-6) for g in whole)


def test_local_analysis_without_place_or_neighbours(spark):
    _, states, obs = placed(spark, 23, 6, 9)
    lost = states.withColumn("lon", F.when(F.col("gid") == 2, F.lit(None)).otherwise(F.col("lon")))
    lost = lost.withColumn("lat", F.when(F.col("gid") == 3, F.lit(80.0)).otherwise(F.col("lat")))
    nowhere = obs.unionByName(obs.limit(1).withColumn("lat", F.lit(None).cast("double")))
    out = {r["gid"]: r for r in A.analyse_local(lost, nowhere, 2.0, 1.0).collect()}
    assert len(out) == 6 and all(out[g]["a"] == out[g]["xa"] for g in (2, 3))
    assert A.analyse_local(states, obs.filter("fdate = 9"), 2.0, 1.0).filter("a = xa").count() == 6
