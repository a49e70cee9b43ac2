"""Steps that must not grow faster than their input: spreads, growth text, gamma fits."""

from datetime import date

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from cellcast.functions import gamma
from cellcast.operators import drought, ensemble
from cellcast.sources import text


def test_members_carry_their_original(spark, small_dir):
    rows = [(1, date(2001, 1, 1), 4.0, 20.0, 10.0, 1.0), (1, date(2001, 1, 2), 0.0, 21.0, 9.0, 2.0), (2, date(2001, 1, 1), 7.0, 3.0, 1.0, 3.0)]
    forcing = spark.createDataFrame(rows, "gid long, fdate date, prec double, tmax double, tmin double, wind double")
    out = ensemble.perturb(forcing, 3, 5, original="p0")
    assert {(r["gid"], r["fdate"], r["ensemble"], r["p0"]) for r in out.collect()} == {(r[0], r[1], e, r[2]) for r in rows for e in (1, 2, 3)}
    assert out.drop("p0").exceptAll(ensemble.perturb(forcing, 3, 5)).count() == 0
    plan = entry.queries()["perturb_spread"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_growth_lines_are_split_once(spark):
    line = " 2003  {} 0 0 0 0 {} 0 0 {} 0 0 0 0 0 0 0 0 {}".format
    lines = ["*GROWTH", "@YEAR DOY", "", "Year 1", "in 5", line(5, 0.5, 9, 0.25), line(6, 1, 0, 1), line(7, "x", "1e3", "-inf"), line(8, ".5", "nan", "+2"), "+Infinity 1"]
    frame = spark.createDataFrame([(1, 2, s) for s in lines] + [(3, 4, None)], "gid long, ensemble int, value string")
    from pyspark.sql import functions as F

    out = text.parse_growth(frame, F.lit(2003))
    got = {r["fdate"].day: (r["lai"], r["gwad"], r["wsgd"]) for r in out.collect()}
    assert got[5] == (0.5, 9.0, 0.25) and got[7] == (None, 1000.0, float("-inf")) and str(got[8]) == "(0.5, nan, 2.0)"
    assert set(got) == {5, 7, 8} and out.count() == 3
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_cells_of_many_batches_are_fitted_together(monkeypatch):
    calls = []
    fit = drought.fit_profiles
    monkeypatch.setattr(drought, "fit_profiles", lambda x, starts: calls.append(len(starts)) or fit(x, starts))
    rng = np.random.default_rng(3)
    table = pa.table({
        "gid": np.repeat(np.arange(40), 50), "fdate": np.tile(np.arange(50), 40), "pm": rng.gamma(3.0, 2.0, 2000), "usable": np.ones(2000, bool),
    })
    together = pa.Table.from_batches(list(drought._score_batches(iter(table.to_batches(max_chunksize=70)))))
    assert calls == [40]
    monkeypatch.setattr(drought, "ROWS_AT_ONCE", 120)
    apart = pa.Table.from_batches(list(drought._score_batches(iter(table.to_batches(max_chunksize=70)))))
    assert sum(calls[1:]) == 40 and len(calls) > 10
    assert together.column("gid").equals(apart.column("gid")) and together.column("fdate").equals(apart.column("fdate"))
    assert together.column("z").to_numpy() == pytest.approx(apart.column("z").to_numpy(), abs=1e-9)


def test_large_shapes_agree_with_series_and_fraction():
    rng = np.random.default_rng(4)
    a = rng.uniform(100, 20000, 3000)
    z = np.abs(a + 3 * rng.normal(size=3000) * np.sqrt(a))
    low = z < a + 1
    want = np.where(low, gamma._lower_series(a, np.where(low, z, a)), 1 - gamma._upper_fraction(a, np.where(low, a + 1, z)))
    assert gamma._quadrature(a, z) == pytest.approx(want, abs=1e-10)
    assert gamma.cdf(z, a, 0.0, 1.0) == pytest.approx(want, abs=1e-10)
