"""Satellite tiles of basin cells, by all pairs of boxes."""

from oracle import connect

import __spark_entry__ as entry
from cellcast.queries.inputs import views
from cellcast.sources import catalog


def test_every_overlap_is_returned(spark, small_dir):
    cells = connect(small_dir).execute(views("basin") + " SELECT gid, lat::DOUBLE, lon::DOUBLE FROM basin").fetchall()
    tiles = [(r["h"], r["v"], r["tile_box"]) for r in catalog.satellite_tiles(spark).collect()]
    want = sorted(
        (gid, h, v) for gid, lat, lon in cells for h, v, b in tiles
        if lon - 0.125 <= b["xmax"] and lon + 0.125 >= b["xmin"] and lat - 0.125 <= b["ymax"] and lat + 0.125 >= b["ymin"]
    )
    got = sorted((r["gid"], r["h"], r["v"]) for r in entry.queries()["satellite_tiles"](spark, small_dir).collect())
    assert got == want and len(got) > len(cells)
