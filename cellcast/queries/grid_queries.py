"""Grid and spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.functions import geometry
from cellcast.operators import grid, spatial
from cellcast.operators.common import salted_join
from cellcast.queries import inputs as I
from cellcast.queries.inputs import BBOX, LEFT, RES, TOP, views
from cellcast.queries.registry import query
from cellcast.sources import catalog

CELLS = "row:i col:i lat:f lon:f value:f"


@query(
    "bbox_subset", CELLS,
    views("grid_static") + f" SELECT * FROM grid_static WHERE lat > {BBOX[1] - 0.125} AND lat < {BBOX[3] + 0.125} "
    f"AND lon > {BBOX[0] - 0.125} AND lon < {BBOX[2] + 0.125} AND value IS NOT NULL",
)
def bbox_subset(spark, d):
    """Cells touching a bounding box."""
    return grid.subset_bbox(I.grid_static(spark, d), RES, BBOX).filter("value is not null")


@query(
    "axis_order", "row:i col:i lat:f lon:f n:i",
    views("grid_daily") + """, g AS (SELECT lat, CASE WHEN lon + 148 > 180 THEN lon - 212 ELSE lon + 148 END AS lon
    FROM grid_daily), a AS (SELECT lat, row_number() OVER (ORDER BY lat DESC) - 1 AS row FROM (SELECT DISTINCT lat FROM g)),
    b AS (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS col FROM (SELECT DISTINCT lon FROM g))
    SELECT row, col, lat, lon, count(*) AS n FROM g JOIN a USING (lat) JOIN b USING (lon) GROUP BY ALL""",
)
def axis_order(spark, d):
    """Longitude wrap, then row and column by axis order."""
    g = I.grid_daily(spark, d).withColumn("lon", F.col("lon") + 148)
    out = grid.order_index(grid.wrap_longitude(g))
    return out.groupBy("row", "col", "lat", "lon").agg(F.count("*").alias("n"))


@query(
    "resample_methods", "k:i source:f target:f method:s",
    """SELECT c_custkey AS k, [0.05, 0.25, 1.0][c_custkey % 3 + 1] AS source,
    [0.25, 0.5, 0.05][(c_custkey // 3) % 3 + 1] AS target,
    CASE WHEN [0.25, 0.5, 0.05][(c_custkey // 3) % 3 + 1] = [0.05, 0.25, 1.0][c_custkey % 3 + 1] THEN 'near'
    WHEN [0.25, 0.5, 0.05][(c_custkey // 3) % 3 + 1] < [0.05, 0.25, 1.0][c_custkey % 3 + 1] THEN 'bilinear'
    ELSE 'average' END AS method FROM customer""",
)
def resample_methods(spark, d):
    """Regrid form by source and target resolution."""
    c = I.table(spark, d, "customer")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    k = F.col("c_custkey")
    out = c.select(
        k.alias("k"), pick([0.05, 0.25, 1.0], k % 3).alias("source"),
        pick([0.25, 0.5, 0.05], F.floor(k / 3) % 3).alias("target"),
    )
    return out.withColumn("method", grid.resample_method(F.col("target"), F.col("source")))


@query(
    "regrid_average", "fdate:d row:i col:i lat:f lon:f value:f",
    views("grid_daily") + """ SELECT fdate, r AS row, c AS col, 90 - (r + 0.5) AS lat, -180 + (c + 0.5) AS lon, value
    FROM (SELECT fdate, CAST(floor((90 - lat) + 1e-9) AS BIGINT) AS r, CAST(floor((lon + 180) + 1e-9) AS BIGINT) AS c,
    avg(value) AS value FROM grid_daily GROUP BY 1, 2, 3)""",
)
def regrid_average(spark, d):
    """Daily cells averaged to one degree."""
    return grid.regrid(I.grid_daily(spark, d), RES, 1.0, ["fdate"])


_FINE_TOP, _FINE_LEFT = TOP + RES / 2, LEFT - RES / 2


@query(
    "regrid_bilinear", CELLS,
    views("grid_static") + f""", s AS (SELECT lat, lon, value FROM grid_static WHERE value IS NOT NULL),
    b AS (SELECT max(row) AS mr, max(col) AS mc FROM grid_static),
    t AS (SELECT i AS row, j AS col, {_FINE_TOP} - (i + 0.5) * 0.125 AS tlat, {_FINE_LEFT} + (j + 0.5) * 0.125 AS tlon
    FROM b, range(0, 2 * (mr + 1)) AS x(i), range(0, 2 * (mc + 1)) AS y(j)),
    w AS (SELECT row, col, tlat, tlon, value, abs(tlat - lat) AS dy, abs(tlon - lon) AS dx FROM t JOIN s
    ON s.lat IN (5 - 0.25 * (row // 2), 5 - 0.25 * (row // 2 + 1), 5 - 0.25 * (row // 2 - 1))
    AND s.lon IN (30 + 0.25 * (col // 2), 30 + 0.25 * (col // 2 + 1), 30 + 0.25 * (col // 2 - 1)))
    SELECT row, col, tlat AS lat, tlon AS lon, sum((1 - dy / 0.25) * (1 - dx / 0.25) * value)
    / sum((1 - dy / 0.25) * (1 - dx / 0.25)) AS value FROM w WHERE dy < 0.25 - 1e-9 AND dx < 0.25 - 1e-9
    GROUP BY 1, 2, 3, 4 HAVING bool_or(dy <= 0.125 + 1e-9 AND dx <= 0.125 + 1e-9)""",
)
def regrid_bilinear(spark, d):
    """Cells with data interpolated to half their size."""
    g = I.grid_static(spark, d).drop("row", "col")
    return grid.regrid(g, RES, 0.125, [], top=_FINE_TOP, left=_FINE_LEFT)


@query(
    "regrid_nearest", CELLS,
    views("grid_static") + f" SELECT row, col, {_FINE_TOP} - (row + 0.5) * 0.25 AS lat, "
    f"{_FINE_LEFT} + (col + 0.5) * 0.25 AS lon, value FROM grid_static WHERE value IS NOT NULL",
)
def regrid_nearest(spark, d):
    """Equal resolution, slightly shifted source: nearest centre."""
    g = I.grid_static(spark, d).drop("row", "col").withColumn("lat", F.col("lat") + 0.04)
    out = grid.regrid(g, RES, RES, [], top=_FINE_TOP, left=_FINE_LEFT)
    return out.filter("value is not null")


@query(
    "grid_tiles", "tile:i n:i",
    views("grid_static") + """ SELECT dense_rank() OVER (ORDER BY col // 10, row // 10) AS tile, count(*) AS n
    FROM grid_static GROUP BY col // 10, row // 10""",
)
def grid_tiles(spark, d):
    """10 x 10 tiles numbered by upper-left corner."""
    return grid.tile_rank(I.grid_static(spark, d)).groupBy("tile").agg(F.count("*").alias("n"))


@query(
    "tile_numbers", "tile:i n:i",
    views("grid_static") + " SELECT (col // 10) * 36 + row // 10 + 1 AS tile, count(*) AS n FROM grid_static GROUP BY 1",
)
def tile_numbers(spark, d):
    """Tile numbers by arithmetic."""
    g = I.grid_static(spark, d)
    return g.groupBy(grid.tile_id(F.col("row"), F.col("col"), 36).alias("tile")).agg(
        F.count("*").alias("n")
    )


@query(
    "basin_index", "gid:i row:i col:i tile_x:i tile_y:i",
    views("basin") + f""", i AS (SELECT gid, CAST(floor(({TOP} - lat) / 0.25 + 0.5 + 1e-9) AS BIGINT) AS row,
    CAST(floor((lon - {LEFT}) / 0.25 + 0.5 + 1e-9) AS BIGINT) AS col FROM basin)
    SELECT gid, row, col, col // 10 AS tile_x, row // 10 AS tile_y FROM i""",
)
def basin_index(spark, d):
    """Cell indices of basin points."""
    return grid.index_table(I.basin(spark, d), TOP, LEFT, RES)


_INDEX = f""", i AS (SELECT gid, CAST(floor(({TOP} - lat) / 0.25 + 0.5 + 1e-9) AS BIGINT) AS row,
    CAST(floor((lon - {LEFT}) / 0.25 + 0.5 + 1e-9) AS BIGINT) AS col FROM basin)"""


@query(
    "value_at_cells", "gid:i fdate:d value:f",
    views("basin", "grid_daily") + _INDEX + " SELECT gid, fdate, value FROM grid_daily JOIN i USING (row, col) "
    "WHERE fdate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
)
def value_at_cells(spark, d):
    """Daily values at basin cells in a date range."""
    index = grid.index_table(I.basin(spark, d), TOP, LEFT, RES)
    return grid.value_at_cells(I.grid_daily(spark, d), index, "1996-01-01", "1999-12-31")


@query(
    "nearest_known_value", "gid:i month:d value:f",
    views("basin", "grid_daily") + _INDEX + """, m AS (SELECT date_trunc('month', fdate)::DATE AS month, row, col, lat, lon,
    max(value) AS v FROM grid_daily GROUP BY ALL),
    k AS (SELECT month, row, col, lat, lon, CASE WHEN v > 150000 THEN v END AS value FROM m),
    hit AS (SELECT gid, month, value FROM k JOIN i USING (row, col) WHERE value IS NOT NULL),
    miss AS (SELECT gid, month, lat, lon FROM k JOIN i USING (row, col) WHERE value IS NULL),
    n AS (SELECT gid, miss.month, arg_min(k.value, (sqrt(pow(k.lat - miss.lat, 2) + pow(k.lon - miss.lon, 2)), k.row, k.col)) AS value
    FROM miss JOIN k ON k.month = miss.month AND k.value IS NOT NULL GROUP BY 1, 2)
    SELECT * FROM hit UNION ALL SELECT * FROM n""",
)
def nearest_known_value(spark, d):
    """Monthly cells with gaps: value at basin cells or at the nearest cell with data."""
    g = I.grid_daily(spark, d)
    month = F.trunc("fdate", "MM").cast("date")
    cells = g.groupBy(month.alias("month"), "row", "col", "lat", "lon").agg(F.max("value").alias("v"))
    cells = cells.withColumn("value", F.when(F.col("v") > 150000, F.col("v"))).drop("v")
    index = grid.index_table(I.basin(spark, d), TOP, LEFT, RES)
    return spatial.nearest_known_value(cells, index, ["month"], RES)


@query(
    "point_samples", "gid:i value:f",
    views("basin", "grid_static") + _INDEX + " SELECT gid, value FROM i JOIN grid_static USING (row, col) WHERE value IS NOT NULL",
)
def point_samples(spark, d):
    """Raster value under points."""
    out = grid.sample_points(I.grid_static(spark, d), I.basin(spark, d), TOP, LEFT, RES)
    return out.filter("value is not null")


_INSIDE = "abs(lon - cx) + abs(lat - cy) < r"


@query(
    "points_in_areas", "gid:i area:i",
    views("basin", "areas") + f" SELECT gid, area FROM basin JOIN areas ON {_INSIDE}",
)
def points_in_areas(spark, d):
    """Basin points inside polygons."""
    return spatial.points_in_areas(I.basin(spark, d), I.areas(spark, d))


def _membership(spark, d):
    c = I.table(spark, d, "customer")
    index = c.select(
        I.grid_row(F.col("c_custkey")).alias("row"), I.grid_col(F.col("c_custkey")).alias("col")
    ).distinct()
    placed = index.withColumn("lat", F.lit(TOP) - RES * F.col("row")).withColumn(
        "lon", F.lit(LEFT) + RES * F.col("col")
    )
    return spatial.zonal_membership(placed, I.areas(spark, d))


@query(
    "clipped_cells", "area:i row:i col:i value:f",
    views("grid_static", "areas") + f" SELECT area, row, col, value FROM grid_static JOIN areas ON {_INSIDE} WHERE value IS NOT NULL",
)
def clipped_cells(spark, d):
    """Raster clipped to polygons: centres inside."""
    inside = spatial.points_in_areas(I.grid_static(spark, d), I.areas(spark, d))
    return inside.filter("value is not null")


@query(
    "zonal_mean_clip", "area:i fdate:d value:f",
    views("grid_daily", "areas") + f" SELECT area, fdate, avg(value) AS value FROM grid_daily JOIN areas ON {_INSIDE} GROUP BY 1, 2",
)
def zonal_mean_clip(spark, d):
    """Clipped mean per polygon and day."""
    return spatial.zonal_mean(I.grid_daily(spark, d), _membership(spark, d))


@query(
    "zonal_mean_tiles", "area:i fdate:d value:f",
    views("grid_daily", "areas") + f""", t AS (SELECT row // 10 AS ty, col // 10 AS tx, fdate, avg(value) AS m
    FROM grid_daily GROUP BY 1, 2, 3)
    SELECT area, fdate, avg(m) AS value FROM t JOIN areas ON cx - r <= {LEFT} - 0.125 + (tx + 1) * 2.5
    AND cx + r >= {LEFT} - 0.125 + tx * 2.5 AND cy - r <= {TOP} + 0.125 - ty * 2.5
    AND cy + r >= {TOP} + 0.125 - (ty + 1) * 2.5 GROUP BY 1, 2""",
)
def zonal_mean_tiles(spark, d):
    """Mean of whole tiles touching the box of a polygon, per day."""
    return spatial.whole_tile_mean(I.grid_daily(spark, d), I.areas(spark, d), RES, TOP, LEFT, boxes=True)


@query(
    "zonal_summary", "area:i month:d average:f highest:f lowest:f",
    views("grid_daily", "areas") + f""" SELECT area, date_trunc('month', fdate)::DATE AS month, avg(value) AS average,
    max(value) AS highest, min(value) AS lowest FROM grid_daily JOIN areas ON {_INSIDE} GROUP BY 1, 2""",
)
def zonal_summary(spark, d):
    """Average, maximum and minimum per polygon and month."""
    joined = I.grid_daily(spark, d).join(_membership(spark, d), ["row", "col"])
    return joined.groupBy("area", F.trunc("fdate", "MM").cast("date").alias("month")).agg(
        F.avg("value").alias("average"), F.max("value").alias("highest"), F.min("value").alias("lowest")
    )


@query(
    "nearest_basin_cell", "area:i gid:i distance:f",
    views("basin", "areas") + """ SELECT area, gid, distance FROM (SELECT area, gid,
    sqrt(pow(lon - cx, 2) + pow(lat - cy, 2)) AS distance, row_number() OVER (PARTITION BY area
    ORDER BY round(sqrt(pow(lon - cx, 2) + pow(lat - cy, 2)), 9), gid) AS rn FROM basin, areas) WHERE rn = 1""",
)
def nearest_basin_cell(spark, d):
    """Basin cell closest to each polygon centroid."""
    sought = I.areas(spark, d).select(
        "area", F.round("centroid.x", 9).alias("cx"), F.round("centroid.y", 9).alias("cy")
    )
    return spatial.nearest_join(sought, I.basin(spark, d), ("cx", "cy"), ("lon", "lat"), "gid")


@query(
    "nearest_soil_of_cells", "k:i gid:i distance:f",
    views("basin") + """, g AS (SELECT c_custkey AS k, 5 - 0.25 * ((c_custkey // 40) % 360) AS y,
    30 + 0.25 * (c_custkey % 40 + 40 * ((c_custkey // 14400) % 8)) AS x FROM customer)
    SELECT k, gid, distance FROM (SELECT k, gid, sqrt(pow(lon - x, 2) + pow(lat - y, 2)) AS distance,
    row_number() OVER (PARTITION BY k ORDER BY round(sqrt(pow(lon - x, 2) + pow(lat - y, 2)), 9), gid) AS rn
    FROM g, basin) WHERE rn = 1""",
)
def nearest_soil_of_cells(spark, d):
    """Nearest soil point of every grid cell."""
    c = I.table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"),
        (F.lit(TOP) - RES * I.grid_row(F.col("c_custkey"))).alias("y"),
        (F.lit(LEFT) + RES * I.grid_col(F.col("c_custkey"))).alias("x"),
    )
    return spatial.nearest_join(c, I.basin(spark, d), ("x", "y"), ("lon", "lat"), "gid")


# Distance to a diamond: to an edge, or to a vertex beyond its reach.
BUFFER_SQL = views("basin", "areas") + """, dist AS (SELECT area, gid, abs(lon - cx) <= r AND abs(lat - cy) <= r AS boxed,
    CASE WHEN abs(lon - cx) - abs(lat - cy) > r THEN sqrt(pow(abs(lon - cx) - r, 2) + pow(lat - cy, 2))
    WHEN abs(lat - cy) - abs(lon - cx) > r THEN sqrt(pow(lon - cx, 2) + pow(abs(lat - cy) - r, 2))
    ELSE greatest(0, (abs(lon - cx) + abs(lat - cy) - r) / sqrt(2)) END AS away FROM basin, areas),
    ringed AS (SELECT area, gid, CASE WHEN boxed THEN 0 ELSE greatest(1, CAST(ceil(away / 0.1) AS BIGINT)) END AS ring FROM dist),
    reach AS (SELECT area, gid, ring FROM (SELECT *, min(ring) OVER (PARTITION BY area) AS low FROM ringed) WHERE ring = low)"""


@query("growing_buffer", "area:i gid:i ring:i", BUFFER_SQL + " SELECT * FROM reach")
def growing_buffer(spark, d):
    """Points in each polygon's box, or in the smallest 0.1-degree buffer with any."""
    return spatial.within_growing_buffer(I.areas(spark, d), I.basin(spark, d))


@query(
    "polygon_distance", "gid:i area:i distance:f",
    views("basin", "areas") + f""" SELECT gid, area, CASE WHEN {_INSIDE} THEN 0 ELSE
    (abs(lon - cx) + abs(lat - cy) - r) / sqrt(2) END AS distance FROM basin JOIN areas
    ON lon BETWEEN cx - r AND cx + r AND lat BETWEEN cy - r AND cy + r""",
)
def polygon_distance(spark, d):
    """Distance from points in a polygon's box to the polygon."""
    shapes = spatial.area_bins(I.areas(spark, d), 1.0)
    p = I.basin(spark, d)
    binned = p.withColumn("bx", F.floor("lon").cast("int")).withColumn("by", F.floor("lat").cast("int"))
    joined = binned.join(shapes, ["bx", "by"])
    box = F.col("lon").between(F.col("bbox.xmin"), F.col("bbox.xmax")) & F.col("lat").between(
        F.col("bbox.ymin"), F.col("bbox.ymax")
    )
    out = joined.filter(box)
    away = geometry.distance_to(F.col("lon"), F.col("lat"), F.col("edges"))
    return out.withColumn("distance", away)


@query(
    "satellite_tiles", "gid:i h:i v:i",
    views("basin") + """, ids AS (SELECT h, v, (h - 18) * 10.0 AS west, (h - 17) * 10.0 AS east, v < 9 AS north,
    least(abs(90 - 10 * v), abs(80 - 10 * v)) AS near, greatest(abs(90 - 10 * v), abs(80 - 10 * v)) AS far
    FROM range(0, 36) AS a(h), range(0, 18) AS b(v)), sides AS (SELECT *, CASE WHEN west >= 0 THEN west ELSE -east END AS side FROM ids),
    valid AS (SELECT *, cos(radians(near)) AS c1, least(far, degrees(acos(side / 180.0))) AS reached FROM sides
    WHERE side < 180.0 * cos(radians(near)) - 1e-9), cuts AS (SELECT *, cos(radians(reached)) AS c2 FROM valid),
    lons AS (SELECT *, least(west / c1, CASE WHEN c2 > 1e-12 THEN west / c2 ELSE sign(west) * 180.0 END) AS w,
    greatest(east / c1, CASE WHEN c2 > 1e-12 THEN east / c2 ELSE sign(east) * 180.0 END) AS e FROM cuts),
    boxes AS (SELECT h, v, greatest(-180.0, w) AS xmin, least(180.0, e) AS xmax, CASE WHEN north THEN near ELSE -reached END AS ymin,
    CASE WHEN north THEN reached ELSE -near END AS ymax FROM lons)
    SELECT gid, h, v FROM basin JOIN boxes ON lon - 0.125 <= xmax AND lon + 0.125 >= xmin AND lat - 0.125 <= ymax AND lat + 0.125 >= ymin""",
)
def satellite_tiles(spark, d):
    """All satellite tiles whose box meets the box of each basin cell."""
    b = I.basin(spark, d)
    cell = F.struct(
        (F.col("lon") - 0.125).alias("xmin"), (F.col("lat") - 0.125).alias("ymin"),
        (F.col("lon") + 0.125).alias("xmax"), (F.col("lat") + 0.125).alias("ymax"),
    )
    boxes = b.select(F.col("gid").alias("area"), cell.alias("bbox"))
    hit = spatial.boxes_touching(boxes, catalog.satellite_tiles(spark), 10.0)
    return hit.select(F.col("area").alias("gid"), "h", "v")


@query(
    "layer_union_sum", "gid:i fdate:d value:f",
    views("layered") + " SELECT gid, fdate, sum(soil_moist) AS value FROM layered WHERE layer < 3 GROUP BY 1, 2",
)
def layer_union_sum(spark, d):
    """Overlay of soil layers by sum."""
    upper = I.layered(spark, d).filter("layer < 3").withColumnRenamed("soil_moist", "value")
    return grid.union_sum(upper, ["gid", "fdate"])


@query(
    "mosaic_latest", "row:i col:i value:f",
    views("grid_daily") + " SELECT row, col, max_by(value, fdate) AS value FROM grid_daily GROUP BY 1, 2",
)
def mosaic_latest(spark, d):
    """Latest value of each cell over overlapping rasters."""
    return grid.union_latest(I.grid_daily(spark, d), ["row", "col"], "fdate")


@query(
    "resample_on_grid", "fdate:d row:i col:i model:f obs:f",
    views("grid_daily", "grid_static") + """, m AS (SELECT fdate, row // 4 AS row, col // 4 AS col, avg(value) AS model
    FROM grid_daily GROUP BY 1, 2, 3), o AS (SELECT row // 4 AS row, col // 4 AS col, avg(value) AS obs
    FROM grid_static WHERE value IS NOT NULL GROUP BY 1, 2) SELECT * FROM m JOIN o USING (row, col)""",
)
def resample_on_grid(spark, d):
    """Model values averaged on the grid of observations and matched to them.

    The join key is a coarse cell, so the daily side is spread by a salt.
    """
    edge = {"top": TOP + RES / 2, "left": LEFT - RES / 2}
    model = grid.regrid_average(I.grid_daily(spark, d), 1.0, ["fdate"], **edge)
    obs = grid.regrid_average(I.grid_static(spark, d), 1.0, [], **edge)
    return salted_join(
        model.select("fdate", "row", "col", F.col("value").alias("model")),
        obs.select("row", "col", F.col("value").alias("obs")),
        ["row", "col"], salts=4, spread_by=["fdate"],
    )


@query(
    "pixel_centroids", "lon:f lat:f value:f",
    views("grid_static") + " SELECT lon, lat, value FROM grid_static WHERE value IS NOT NULL",
)
def pixel_centroids(spark, d):
    return grid.pixel_centroids(I.grid_static(spark, d))


@query(
    "dense_grid", "nation:i row:i col:i value:f",
    """WITH p AS (SELECT c_nationkey AS nation, 5 - 0.25 * ((c_custkey // 40) % 360) AS lat,
    30 + 0.25 * (c_custkey % 40 + 40 * ((c_custkey // 14400) % 8)) AS lon, max(floor(c_acctbal)) AS value
    FROM customer GROUP BY 1, 2, 3), b AS (SELECT nation, max(lat) AS t, min(lat) AS u, min(lon) AS l, max(lon) AS r
    FROM p GROUP BY 1), g AS (SELECT nation, t, l, i AS row, j AS col FROM b, range(0, 400) AS x(i), range(0, 400) AS y(j)
    WHERE i <= floor((t - u) / 0.25 + 1e-9) AND j <= floor((r - l) / 0.25 + 1e-9))
    SELECT g.nation, g.row, g.col, coalesce(p.value, -9999.0) AS value FROM g LEFT JOIN p ON p.nation = g.nation
    AND p.lat = g.t - 0.25 * g.row AND p.lon = g.l + 0.25 * g.col""",
)
def dense_grid(spark, d):
    """Scattered points on the full grid of each nation with the nodata number."""
    c = I.table(spark, d, "customer")
    points = c.select(
        F.col("c_nationkey").alias("nation"),
        (F.lit(TOP) - RES * I.grid_row(F.col("c_custkey"))).alias("lat"),
        (F.lit(LEFT) + RES * I.grid_col(F.col("c_custkey"))).alias("lon"),
        F.floor("c_acctbal").cast("double").alias("value"),
    )
    return grid.dense_grid(points, RES, ["nation"])


_CATALOG = """, t AS (SELECT ['precip', 'tmax'][row % 2 + 1] AS var, 'chirps_' || [4, 1][row % 2 + 1] AS dataset,
    lat * (1 + 3 * (row % 2)) AS lat FROM grid_daily), u AS (SELECT DISTINCT * FROM t),
    s AS (SELECT var, dataset, lat - lag(lat) OVER (PARTITION BY var, dataset ORDER BY lat) AS step FROM u),
    c AS (SELECT var, dataset, round(min(step), 6) AS resolution FROM s WHERE step > 1e-9 GROUP BY 1, 2)"""


def _catalog(spark, d):
    g = I.grid_daily(spark, d)
    odd = F.col("row") % 2
    named = g.select(
        F.when(odd == 0, "precip").otherwise("tmax").alias("var"),
        F.when(odd == 0, "chirps_4").otherwise("chirps_1").alias("dataset"),
        (F.col("lat") * (1 + 3 * odd)).alias("lat"),
    )
    return grid.grid_catalog(named)


@query("catalog_tables", "var:s dataset:s resolution:f", views("grid_daily") + _CATALOG + " SELECT * FROM c")
def catalog_tables(spark, d):
    """Every stored table with its resolution."""
    return _catalog(spark, d)


@query("grid_catalog", "var:s dataset:s resolution:f",
       views("grid_daily") + _CATALOG + " SELECT * FROM c WHERE var = 'precip' AND dataset LIKE 'chirps%' AND abs(resolution - 0.5) < 1e-6")
def grid_catalog(spark, d):
    """Resolution catalogue and lookup by name prefix."""
    return grid.find_tables(_catalog(spark, d), "precip", "chirps", 0.5)


@query("nearest_resolution", "gid:i resolution:f",
       views("grid_daily") + _CATALOG + """, w AS (SELECT s_suppkey AS gid, 0.2 + (s_suppkey % 20) * 0.1 AS want FROM supplier)
    SELECT gid, arg_min(resolution, (round(abs(resolution - want), 9), resolution)) AS resolution FROM w, c GROUP BY gid""")
def nearest_resolution(spark, d):
    """Available resolution closest to what each basin cell wants."""
    known = _catalog(spark, d).agg(F.sort_array(F.collect_set("resolution"))).scalar()
    wants = I.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("gid"), F.round(0.2 + (F.col("s_suppkey") % 20) * 0.1, 9).alias("want"),
        known.alias("known"),
    )
    return wants.withColumn("resolution", grid.closest_of(F.col("want"), F.col("known")))
