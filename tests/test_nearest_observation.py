"""Nearest observations on every date, by all pairs."""

import math
import random
from collections import defaultdict
from datetime import date

from oracle import connect

import __spark_entry__ as entry
from cellcast.operators import assimilation, spatial
from cellcast.queries.inputs import views


def test_all_dates_are_answered(spark, small_dir):
    con = connect(small_dir)
    cells = con.execute(views("basin") + " SELECT gid, lat, lon FROM basin").fetchall()
    seen = defaultdict(list)
    for row, col, lat, lon, day in con.execute(views("grid_daily") + " SELECT row, col, lat, lon, fdate FROM grid_daily").fetchall():
        seen[str(day)].append((row * 1000 + col, float(lat), float(lon)))
    want = {}
    for day, spots in seen.items():
        for gid, lat, lon in cells:
            away = lambda s: ((float(lat) - s[1]) ** 2 + (float(lon) - s[2]) ** 2) ** 0.5
            best = min(spots, key=lambda s: (round(away(s), 9), s[0]))
            want[gid, day] = (best[0], round(away(best), 6))
    rows = entry.queries()["nearest_observation"](spark, small_dir).collect()
    got = {(r["gid"], str(r["fdate"])): (r["oid"], round(r["distance"], 6)) for r in rows}
    assert len({day for _, day in got}) == len(seen) > 4
    assert len(rows) == len(got) and set(got) == set(want)
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert sum(got[k][0] != want[k][0] for k in want) == 0


def test_states_without_a_date_are_asked_on_every_date(spark, monkeypatch):
    """Tiles, blocks and far places against all pairs: ties, copies, places and days without coordinates."""
    monkeypatch.setattr(spatial, "_BLOCK", 7)
    rng = random.Random(5)
    spot = lambda k: (float(rng.randint(0, k)), float(rng.randint(0, k)))
    states = [(k, *spot(30)) for k in range(60)] + [(3, 2.0, 2.0), (3, 2.0, 2.0), (90, 900.0, -700.0), (91, None, 4.0)]
    days = [date(2001, 1, d) for d in range(1, 6)]
    seen = [(100 - k, days[k % 4], *spot(20)) for k in range(80)] + [(500, days[4], None, 1.0), (501, None, 1.0, 1.0), (7, days[3], 5000.0, 0.0)]
    left = spark.createDataFrame(states, "gid long, lat double, lon double")
    right = spark.createDataFrame(seen, "oid long, fdate date, lat double, lon double")
    got = assimilation.nearest_observation(left, right, 1.0).select("gid", "lat", "lon", "fdate", "oid", "distance").collect()
    want = []
    for gid, lat, lon in states:
        for day in days:
            at = [(round(math.dist((lat, lon), o[2:]), 9), o[0]) for o in seen if o[1] == day and None not in (*o[2:], lat)]
            want.append((gid, lat, lon, day, *(reversed(min(at)) if at else (None, None))))
    order = lambda r: [(v is None, v or 0) if not isinstance(v, date) else (False, v.toordinal()) for v in r[:4]]
    plain = [(*r[:5], None if r[5] is None else round(r[5], 9)) for r in got]
    assert sorted(plain, key=order) == sorted(want, key=order)
