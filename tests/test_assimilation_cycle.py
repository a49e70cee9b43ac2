"""The sequence of analyses against a plain loop, and its resumption."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_assimilation import direct

from cellcast.operators import assimilation as A
from cellcast.plans import flows

N, CELLS, LAYERS = 5, 7, 2
DAYS = [date(2001, 1, 1), date(2001, 2, 1), date(2001, 3, 1)]


def model(seed=3):
    """value[day, cell, layer, member], and observed values and errors of each day and cell."""
    r = np.random.default_rng(seed)
    value = r.uniform(5, 15, (len(DAYS), CELLS, LAYERS, N))
    return value, r.uniform(1, 3, (len(DAYS), CELLS)), r.normal(0, 0.3, (len(DAYS), CELLS, N))


def frame(spark, value, skip=()):
    rows = [
        (i, DAYS[t], k + 1, 10 * m, float(value[t, i, k, m]), 0.5 * i, 0.25 * i)
        for t in range(len(DAYS)) for i in range(CELLS) for k in range(LAYERS) for m in range(N) if (t, i) not in skip
    ]
    return spark.createDataFrame(rows, "gid long, fdate date, layer int, ensemble int, value double, lon double, lat double")


def observer(spark, seen, errors, calls, place=False):
    def observe(background, day):
        calls.append(day)
        t = DAYS.index(day)
        rows = [(i, float(seen[t, i]), errors[t, i].tolist(), 0.5 * i, 0.25 * i) for i in range(CELLS)]
        table = spark.createDataFrame(rows, "gid long, d double, e array<double>, lon double, lat double")
        states = A.state_vector(background).withColumn("ha", F.transform("a", lambda v: v * 0.1))
        return states.join(table, "gid").select("fdate", "ha", "d", "e", *(["lon", "lat"] if place else []))

    return observe


def plain(value, seen, errors, method="letkf", skip=()):
    """Updated layers by day, with whole matrices."""
    factor = np.ones((CELLS, N))
    out = {}
    for t in range(len(DAYS)):
        here = [i for i in range(CELLS) if (t, i) not in skip]
        background = value[t, here] * factor[here][:, None, :]
        a = background.sum(1)
        xa = direct(method, a, a * 0.1, seen[t, here][:, None], errors[t, here])
        for n, i in enumerate(here):
            out[t, i] = background[n] * (xa[n] / a[n])
            factor[i] *= xa[n] / a[n]
    return out


def check(rows, want):
    got = {(DAYS.index(r["fdate"]), r["gid"], r["layer"], r["ensemble"]): r["value"] for r in rows}
    assert len(got) == len(rows) == len(want) * LAYERS * N
    for (t, i), layers in want.items():
        for k in range(LAYERS):
            for m in range(N):
                assert got[t, i, k + 1, 10 * m] == pytest.approx(layers[k, m], rel=1e-7)


@pytest.mark.parametrize("method", ["letkf", "enkf"])
def test_cycle_equals_a_plain_loop(spark, tmp_path, method):
    value, seen, errors = model()
    skip = {(1, 4)}  # a cell without rows on one date keeps its factor
    sim = frame(spark, value, skip).repartition(4)
    out = flows.assimilation_cycle(sim, observer(spark, seen, errors, []), reversed(DAYS), str(tmp_path / "run"), method)
    check(out.collect(), plain(value, seen, errors, method, skip))


def test_cycle_goes_on_where_it_stopped(spark, tmp_path):
    value, seen, errors = model(5)
    sim, calls = frame(spark, value), []
    path = str(tmp_path / "run")
    flows.assimilation_cycle(sim, observer(spark, seen, errors, calls), DAYS[:2], path)
    assert calls == DAYS[:2]
    out = flows.assimilation_cycle(sim, observer(spark, seen, errors, calls), DAYS, path).collect()
    assert calls == DAYS
    check(out, plain(value, seen, errors))


def test_cycle_with_localisation_and_none(spark, tmp_path):
    value, seen, errors = model(6)
    sim = frame(spark, value)
    wide = flows.assimilation_cycle(sim, observer(spark, seen, errors, [], True), DAYS[:2], str(tmp_path / "a"), "local", radius=1e7, patch=50.0)
    want = {k: v for k, v in plain(value, seen, errors).items() if k[0] < 2}
    check(wide.collect(), want)
    assert flows.assimilation_cycle(sim, observer(spark, seen, errors, []), [], str(tmp_path / "b")).count() == 0
