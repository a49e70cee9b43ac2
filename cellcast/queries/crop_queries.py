"""Crop inputs, growth outputs, yields and zonal exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.operators import crops as C
from cellcast.operators.ensemble import cycle_variants
from cellcast.operators import spatial
from cellcast.queries import inputs as I
from cellcast.queries.ensemble_queries import _u
from cellcast.queries.grid_queries import BUFFER_SQL, _membership
from cellcast.queries.inputs import LEFT, RES, TOP, views
from cellcast.queries.registry import query

_BEST = """, b AS (SELECT gid, ensemble, gwad, fdate FROM (SELECT *, row_number() OVER (PARTITION BY gid, ensemble
    ORDER BY gwad DESC, fdate DESC) AS rn FROM growth) WHERE rn = 1)"""


@query("season_best", "gid:i ensemble:i gwad:f fdate:d", views("growth") + _BEST + " SELECT * FROM b")
def season_best(spark, d):
    """Highest grain weight per area and member with its date."""
    return C.season_best(I.growth(spark, d))


@query(
    "yield_table", "gid:i max_yield:f avg_yield:f std_yield:f fdate:d crop:s",
    views("growth") + _BEST + """ SELECT gid, max(gwad) AS max_yield, avg(gwad) AS avg_yield,
    coalesce(stddev_samp(gwad), 0) AS std_yield, max(fdate) AS fdate, 'maize' AS crop FROM b GROUP BY gid""",
)
def yield_table(spark, d):
    """Yield statistics over members."""
    return C.yield_table(I.growth(spark, d), "maize")


@query(
    "yield_export", "gid:i max_yield:f avg_yield:f std_yield:f min_yield:f fdate:d crop:s",
    views("growth") + _BEST + """ SELECT gid, max(gwad) AS max_yield, avg(gwad) AS avg_yield,
    coalesce(stddev_samp(gwad), 0) AS std_yield, min(gwad) AS min_yield, max(fdate) AS fdate, 'rice' AS crop
    FROM b WHERE fdate BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY gid""",
)
def yield_export(spark, d):
    """Yield statistics of the bests inside a date range."""
    return C.yield_export(I.growth(spark, d), "rice", "1999-01-01", "2000-12-31")


@query(
    "growth_with_shape", "gid:i wkt:s n:i",
    views("growth", "areas") + """, g AS (SELECT gid % 40 AS gid, count(*) AS n FROM growth GROUP BY 1)
    SELECT gid, coalesce(CASE WHEN area IS NULL THEN NULL ELSE printf('%.2f', cx - r) END, '-') AS wkt, n
    FROM g LEFT JOIN areas ON area = gid""",
)
def growth_with_shape(spark, d):
    """Geometry attached by area id; the first coordinate is shown."""
    g = I.growth(spark, d).groupBy((F.col("gid") % 40).alias("gid")).agg(F.count("*").alias("n"))
    out = C.attach_geometry(g, I.areas(spark, d))
    first = F.regexp_extract("wkt", r"\(\(([-0-9.]+)", 1).cast("double")
    shown = F.when(F.col("wkt").isNotNull(), F.format_string("%.2f", first)).otherwise("-")
    return out.withColumn("wkt", shown)


_WEATHER = """, z AS (SELECT area, fdate, avg(value) AS v FROM grid_daily JOIN areas
    ON abs(lon - cx) + abs(lat - cy) < r GROUP BY 1, 2)"""


_TILES = f""", t AS (SELECT row // 10 AS ty, col // 10 AS tx, fdate, avg(value) AS m FROM grid_daily GROUP BY 1, 2, 3),
    z AS (SELECT area, fdate, avg(m) AS v FROM t JOIN areas ON cx - r <= {LEFT} - 0.125 + (tx + 1) * 2.5
    AND cx + r >= {LEFT} - 0.125 + tx * 2.5 AND cy - r <= {TOP} + 0.125 - ty * 2.5
    AND cy + r >= {TOP} + 0.125 - (ty + 1) * 2.5
    AND greatest({LEFT} - 0.125 + tx * 2.5 - cx, cx - {LEFT} + 0.125 - (tx + 1) * 2.5, 0)
    + greatest({TOP} + 0.125 - (ty + 1) * 2.5 - cy, cy - {TOP} - 0.125 + ty * 2.5, 0) <= r GROUP BY 1, 2)"""


def _whole_tiles(spark, d):
    return spatial.whole_tile_mean(I.grid_daily(spark, d), I.areas(spark, d), RES, TOP, LEFT)


def _zonal_weather(spark, d):
    """Tall whole-tile means of five variables derived from the daily grid."""
    zonal = _whole_tiles(spark, d)
    scale = {"net_short": 3.0, "net_long": 1.0, "rainf": 0.5, "tmax": 2.0, "tmin": 1.5}
    pairs = [F.struct(F.lit(v).alias("var"), (F.col("value") * k).alias("value")) for v, k in scale.items()]
    return zonal.withColumn("_p", F.explode(F.array(*pairs))).select("area", "fdate", "_p.*")


@query(
    "area_weather", "area:i fdate:d radiation:f rainf:f tmax:f tmin:f",
    views("grid_daily", "areas") + _TILES + """ SELECT area, fdate, 3 * v - v AS radiation, v * 0.5 AS rainf,
    v * 2 AS tmax, v * 1.5 AS tmin FROM z""",
)
def area_weather(spark, d):
    """Zonal means of the crop variables, wide, with net radiation."""
    return C.pivot_weather(_zonal_weather(spark, d), ["area", "fdate"])


@query(
    "weather_table", "area:i member:i fdate:d srad:f tmax:f tmin:f rain:f",
    views("grid_daily", "areas") + _TILES + """ SELECT area, m AS member, fdate, 2 * v * 0.0864 AS srad, v * 2 AS tmax,
    v * 1.5 AS tmin, v * 0.5 AS rain FROM z, range(1, 4) AS r(m)""",
)
def weather_table(spark, d):
    """Daily crop weather for three members."""
    wide = C.pivot_weather(_zonal_weather(spark, d), ["area", "fdate"])
    return C.weather_table(wide, 3)


@query(
    "weather_members", "gid:i member:i days:i tavg:f",
    views("daily") + """, w AS (SELECT gid, fdate, s, rainf * s + 3 AS tmax, rainf * s AS tmin FROM daily, range(1, 3) AS r(s)),
    m AS (SELECT gid, fdate, k AS member, tmax, tmin FROM w, range(1, 6) AS r(k) WHERE (k - 1) % 2 + 1 = s)
    SELECT gid, member, count(*) AS days, (avg(tmax) + avg(tmin)) / 2 AS tavg FROM m GROUP BY 1, 2""",
)
def weather_members(spark, d):
    """Two weather members cycled over five crop members; mean temperature."""
    base = I.daily(spark, d).withColumn("ensemble", F.explode(F.array(F.lit(1), F.lit(2))))
    warm = F.col("rainf") * F.col("ensemble")
    weather = base.select(
        F.col("gid").alias("area"), "fdate", "ensemble", (warm + 3).alias("tmax"), warm.alias("tmin"),
        "rainf", F.lit(1.0).alias("radiation"),
    )
    table = C.weather_table(weather, 5, "ensemble")
    means = C.weather_means(table).join(
        table.groupBy("area", "member").agg(F.count("*").alias("days")), ["area", "member"]
    )
    return means.withColumnRenamed("area", "gid")


@query(
    "leaf_area", "area:i fdate:d value:f",
    views("grid_daily", "areas") + _WEATHER + """, span AS (SELECT area, min(fdate) AS a, max(fdate) AS b FROM z GROUP BY 1),
    days AS (SELECT area, CAST(unnest(generate_series(make_date(year(a), 1, 1)::TIMESTAMP, make_date(year(b), 12, 31)::TIMESTAMP,
    INTERVAL 1 DAY)) AS DATE) AS fdate FROM span)
    SELECT area, fdate, coalesce(v / 10, -9999.0) AS value FROM days LEFT JOIN z USING (area, fdate)""",
)
def leaf_area(spark, d):
    """Leaf-area series per polygon over whole years."""
    return C.leaf_area(spatial.zonal_mean(I.grid_daily(spark, d), _membership(spark, d)))


@query(
    "planting_dates", "area:i pdate:d season:i",
    """WITH s AS (SELECT o_custkey AS area, CASE WHEN o_orderstatus = 'F' THEN 'maize' ELSE 'rice' END AS type,
    make_date(1998, 1, 1) + CAST(dayofyear(o_orderdate) - 1 AS INTEGER) AS p FROM orders),
    m AS (SELECT DISTINCT area, p FROM s WHERE type = 'maize'),
    k AS (SELECT *, p BETWEEN DATE '1998-04-01' AND DATE '1998-10-31' AS ok, max(CASE WHEN p < DATE '1998-04-01' THEN p END)
    OVER (PARTITION BY area) AS lastp, max(p BETWEEN DATE '1998-04-01' AND DATE '1998-10-31') OVER (PARTITION BY area) AS anyok FROM m)
    SELECT area, p AS pdate, row_number() OVER (PARTITION BY area ORDER BY p) AS season FROM k
    WHERE ok OR (NOT anyok AND p = lastp)""",
)
def planting_dates(spark, d):
    """Planting dates inside the period, else the latest before it."""
    o = I.table(spark, d, "orders").select(
        F.col("o_custkey").alias("area"),
        F.when(F.col("o_orderstatus") == "F", "maize").otherwise("rice").alias("type"),
        F.dayofyear("o_orderdate").alias("doy"),
    )
    return C.planting_dates(o, "maize", "1998-04-01", "1998-10-31")


@query(
    "layer_interpolation", "gid:i fdate:d l1:f l2:f l3:f l4:f",
    views("layered") + """, w AS (SELECT gid, fdate, max(CASE WHEN layer = 1 THEN soil_moist END) / 100.0 AS u1,
    max(CASE WHEN layer = 2 THEN soil_moist END) / 300.0 AS u2, max(CASE WHEN layer = 3 THEN soil_moist END) / 700.0 AS u3
    FROM layered GROUP BY 1, 2), x AS (SELECT *, coalesce(u2, u1) AS low, CASE WHEN u2 IS NULL THEN 5 ELSE 25 END AS z FROM w)
    SELECT gid, fdate, coalesce(u1, u2, u3) AS l1, CASE WHEN u1 IS NULL THEN coalesce(u2, u3) WHEN u2 IS NOT NULL
    THEN u1 + (u2 - u1) * 5 / 20.0 WHEN u3 IS NOT NULL THEN u1 + (u3 - u1) * 5 / 70.0 ELSE u1 END AS l2,
    CASE WHEN low IS NULL THEN u3 WHEN u3 IS NULL THEN low ELSE low + (u3 - low) * (37.5 - z) / (75.0 - z) END AS l3,
    coalesce(u3, u2, u1) AS l4 FROM x""",
)
def layer_interpolation(spark, d):
    """Moisture of three model layers (0.1, 0.3, 0.7 m) at the middles of four profile layers.

    Every cell-day stays; layers without a value are bridged by those that have one.
    """
    m = I.layered(spark, d)
    pick = lambda k: F.max(F.when(F.col("layer") == k, F.col("soil_moist")))
    wide = m.groupBy("gid", "fdate").agg(*[pick(k).alias(f"m{k}") for k in (1, 2, 3)])
    depths = F.array(F.lit(0.1), F.lit(0.3), F.lit(0.7))
    bottoms = F.array(F.lit(5.0), F.lit(15.0), F.lit(60.0), F.lit(120.0))
    out = wide.withColumn("u", C.interpolate_layers(F.array("m1", "m2", "m3"), depths, bottoms))
    return out.select("gid", "fdate", *[F.get("u", k).alias(f"l{k + 1}") for k in range(4)])


@query(
    "moisture_table", "gid:i fdate:d doy:i l1:f l2:f",
    views("daily") + """, y AS (SELECT DISTINCT gid, year(fdate) AS y FROM daily), days AS (SELECT gid, CAST(unnest(generate_series(
    make_date(y, 1, 1)::TIMESTAMP, make_date(y, 12, 31)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS fdate FROM y)
    SELECT gid, fdate, dayofyear(fdate) AS doy, coalesce(rainf, -9999.0) AS l1, coalesce(runoff, -9999.0) AS l2
    FROM days LEFT JOIN daily USING (gid, fdate)""",
)
def moisture_table(spark, d):
    """Layer moistures on every day of each year with gaps filled."""
    s = I.daily(spark, d).select("gid", "fdate", F.array("rainf", "runoff").alias("layers"))
    out = C.moisture_table(s, 2, ["gid"])
    return out.select("gid", "fdate", "doy", F.get("layers", 0).alias("l1"), F.get("layers", 1).alias("l2"))


@query(
    "cropland_areas", "area:i value:f",
    views("grid_static", "areas") + """ SELECT area, avg(value) AS value FROM grid_static JOIN areas
    ON abs(lon - cx) + abs(lat - cy) < r GROUP BY area HAVING avg(value) >= 4800""",
)
def cropland_areas(spark, d):
    """Mean cover per polygon (here in ten-thousandths) above a threshold."""
    return C.cropland_areas(I.grid_static(spark, d), _membership(spark, d), 4800.0)


_WIDE = ", ".join(
    f"max(CASE WHEN area = {k} THEN v END) AS p{k + 1}" for k in range(25)
)


@query(
    "zonal_wide", "fdate:d " + " ".join(f"p{k}:f" for k in range(1, 26)),
    views("grid_daily", "areas") + _TILES + f" SELECT fdate, {_WIDE} FROM z GROUP BY fdate",
)
def zonal_wide(spark, d):
    """One row per date, one column per polygon (NULL where a polygon has no value)."""
    return C.zonal_wide(_whole_tiles(spark, d), list(range(25)))


_PLANT = """, p AS (SELECT s_suppkey AS area, DATE '1999-03-01' + CAST(s_suppkey % 60 AS INTEGER) AS pdate FROM supplier)"""


@query(
    "rice_schedule", "area:i pdate:d fdate:d kind:s code:s amount:f",
    "WITH x AS (SELECT 1)" + _PLANT + """ SELECT area, pdate, pdate + lag AS fdate, 'fertiliser' AS kind, '014' AS code, kg AS amount
    FROM p, (VALUES (0, 60), (30, 70), (45, 80)) AS f(lag, kg)
    UNION ALL SELECT area, pdate, pdate - 7 + lag, 'irrigation', code, mm FROM p, (VALUES (0, 'IR010', 0), (0, 'IR008', 2),
    (0, 'IR009', 20), (0, 'IR011', 5), (6, 'IR009', 100), (6, 'IR011', 30), (10, 'IR009', 150), (10, 'IR011', 50)) AS i(lag, code, mm)""",
)
def rice_schedule(spark, d):
    """Default fertiliser and irrigation dates of rice."""
    return C.schedules(_plantings(spark, d), "rice")


@query(
    "maize_schedule", "area:i pdate:d fdate:d kind:s code:s amount:f",
    "WITH x AS (SELECT 1)" + _PLANT + """ SELECT area, pdate, pdate + lag AS fdate, 'fertiliser' AS kind, '001' AS code, kg AS amount
    FROM p, (VALUES (0, 60), (30, 70), (45, 80)) AS f(lag, kg) UNION ALL SELECT area, pdate, pdate - 7, 'irrigation', '', 0 FROM p""",
)
def maize_schedule(spark, d):
    """Default fertiliser and irrigation dates of maize."""
    return C.schedules(_plantings(spark, d), "maize")


def _plantings(spark, d):
    s = I.table(spark, d, "supplier")
    day = F.date_add(F.lit("1999-03-01").cast("date"), (F.col("s_suppkey") % 60).cast("int"))
    return s.select(F.col("s_suppkey").alias("area"), day.alias("pdate"), F.date_sub(day, 7).alias("start"))


@query(
    "soil_profile_draw", "area:i ensemble:i profile:i",
    BUFFER_SQL + f""" SELECT area, e AS ensemble, arg_min(gid, ({_u('5', 'area, e, gid')}, gid)) AS profile
    FROM reach, range(1, 41) AS r(e) GROUP BY 1, 2""",
)
def soil_profile_draw(spark, d):
    """Forty soil profiles per polygon, drawn from those in reach."""
    reach = spatial.within_growing_buffer(I.areas(spark, d), I.basin(spark, d))
    return C.sample_profiles(reach.withColumn("profile", F.col("gid")), 40, 5, portable=True)


@query(
    "cultivar_ensemble", "ensemble:i crop:s p1:f p5:f phint:f",
    """WITH v AS (SELECT p_partkey AS variant, p_size * 10.0 AS p1, p_retailprice AS p5,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 30.0 + p_size END AS phint FROM part),
    r AS (SELECT *, row_number() OVER (ORDER BY variant) AS i, count(*) OVER () AS n FROM v WHERE phint IS NOT NULL)
    SELECT i AS ensemble, 'maize' AS crop, p1, p5, phint FROM r WHERE i <= 40""",
)
def cultivar_ensemble(spark, d):
    """Forty members from variants that have all parameters."""
    p = I.table(spark, d, "part")
    size = F.col("p_size")
    variants = p.select(
        F.col("p_partkey").alias("variant"), (size * 10.0).alias("p1"), (size / 100.0).alias("p2"),
        F.col("p_retailprice").alias("p5"), (size * 2.0).alias("g2"), (size / 5.0).alias("g3"),
        F.when(F.col("p_partkey") % 3 != 0, 30.0 + size).alias("phint"),
    )
    return C.cultivar_ensemble(variants, "maize", 40)


@query(
    "cultivar_cycles", "brand:s ensemble:i variant:i",
    """WITH r AS (SELECT p_brand AS brand, p_partkey AS variant, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i,
    count(*) OVER (PARTITION BY p_brand) AS n FROM part),
    k AS (SELECT *, least(n, 40) AS m FROM r WHERE i <= 40)
    SELECT brand, e AS ensemble, variant FROM k, range(1, 41) AS g(e) WHERE (e - 1) % m + 1 = i""",
)
def cultivar_cycles(spark, d):
    """Variants of each zone in turn over forty members, repeated where there are fewer."""
    p = I.table(spark, d, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("variant"),
        F.col("p_size").alias("needed"),
    )
    return cycle_variants(p, ["needed"], ["variant"], 40, ["brand"])


@query(
    "cultivar_lookup", "gid:i zone:i how:s",
    views("basin", "areas") + """, b AS (SELECT gid, lon, lat FROM basin),
    h AS (SELECT gid, min(area) AS zone FROM b JOIN areas ON lon + 0.125 >= cx - r AND lon - 0.125 <= cx + r
    AND lat + 0.125 >= cy - r AND lat - 0.125 <= cy + r GROUP BY gid),
    n AS (SELECT gid, area AS zone, row_number() OVER (PARTITION BY gid ORDER BY round(sqrt(pow(lon - cx, 2) + pow(lat - cy, 2)), 9), area) AS rn
    FROM b ANTI JOIN h USING (gid), areas)
    SELECT gid, zone, 'meets' AS how FROM h UNION ALL SELECT gid, zone, 'nearest' FROM n WHERE rn = 1""",
)
def cultivar_lookup(spark, d):
    """Cultivar zone meeting each cell, else the nearest one."""
    cell = F.struct(
        (F.col("lon") - 0.125).alias("xmin"), (F.col("lat") - 0.125).alias("ymin"),
        (F.col("lon") + 0.125).alias("xmax"), (F.col("lat") + 0.125).alias("ymax"),
    )
    cells = I.basin(spark, d).select(
        F.col("gid").alias("area"), cell.alias("bbox"),
        F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("centroid"),
    )
    zones = I.areas(spark, d).withColumnRenamed("area", "zone").withColumn(
        "centroid", F.struct(F.round("centroid.x", 9).alias("x"), F.round("centroid.y", 9).alias("y"))
    )
    return C.cultivar_lookup(cells, zones).withColumnRenamed("area", "gid")
