"""Profile moisture from the layers that are there."""

from collections import defaultdict

import numpy as np
from oracle import connect

import __spark_entry__ as entry
from cellcast.queries.inputs import views


def test_every_cell_day_is_interpolated(spark, small_dir):
    rows = connect(small_dir).execute(views("layered") + " SELECT gid, fdate, layer, soil_moist FROM layered").fetchall()
    held = defaultdict(dict)
    for gid, day, layer, moist in rows:
        held[gid, str(day)][layer] = moist / {1: 100.0, 2: 300.0, 3: 700.0}[layer]
    middle = {1: 5.0, 2: 25.0, 3: 75.0}
    got = {
        (r["gid"], str(r["fdate"])): [r[f"l{k}"] for k in range(1, 5)]
        for r in entry.queries()["layer_interpolation"](spark, small_dir).collect()
    }
    assert set(got) == set(held) and min(map(len, held.values())) < 3
    for key, u in held.items():
        layers = sorted(u)
        want = np.interp([2.5, 10.0, 37.5, 90.0], [middle[k] for k in layers], [u[k] for k in layers])
        assert np.allclose(got[key], want, rtol=0, atol=1e-6), key
