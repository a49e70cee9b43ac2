"""Product normalisers, catalogues, text sources and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.functions import dates as D
from cellcast.operators.grid import between, with_index
from cellcast.queries import inputs as I
from cellcast.queries.inputs import BBOX, views
from cellcast.queries.registry import query
from cellcast.sources import catalog, tables, text
from cellcast.sources.normalisers import normalise

CELL_COLS = "var:s dataset:s fdate:d lat:f lon:f value:f"


def _raw(spark, d):
    return I.grid_daily(spark, d).select("fdate", "lat", "lon", F.col("value").alias("raw"))


def _box(res: float) -> str:
    w, s, e, n = BBOX
    h = res / 2
    return f"lat > {s - h} AND lat < {n + h} AND lon > {w - h} AND lon < {e + h}"


def _cells_sql(var: str, dataset: str, res: float, value: str, source: str = "grid_daily") -> str:
    return (
        f"SELECT '{var}' AS var, '{dataset}' AS dataset, fdate, lat, lon, {value} AS value "
        f"FROM {source} WHERE {_box(res)}"
    )


def _scaled(product: str, var: str, res: float, factor: str) -> None:
    @query(
        f"{product}_cells", CELL_COLS,
        views("grid_daily") + " " + _cells_sql(var, product, res, f"value * {factor}"),
    )
    def run(spark, d):
        return normalise(product, _raw(spark, d), BBOX)

    run.__doc__ = f"{product} cells in a bounding box."


for _name, _res, _factor in (
    ("chirps", 0.05, "1.0"), ("cmorph", 0.25, "24.0"), ("persiann", 0.25, "24.0"),
    ("rfe2", 0.10, "1.0"), ("trmm", 0.25, "1.0"),
):
    _scaled(_name, "precip", _res, _factor)


@query(
    "gpm_cells", CELL_COLS,
    views("grid_daily") + " SELECT * FROM ("
    + _cells_sql("precip", "gpm", 0.1, "CASE WHEN value % 5 <> 0 THEN value * 0.1 END")
    + ") WHERE value IS NOT NULL",
)
def gpm_cells(spark, d):
    """Tenths with a missing-data number."""
    raw = _raw(spark, d)
    raw = raw.withColumn("raw", F.when(F.col("raw") % 5 == 0, 29999.0).otherwise(F.col("raw")))
    return normalise("gpm", raw, BBOX).filter(F.col("value").isNotNull())


@query(
    "prism_cells", CELL_COLS,
    views("grid_daily") + """, p AS (SELECT *, ['precip', 'tmax', 'tmin'][col % 3 + 1] AS var
    FROM grid_daily) SELECT var, 'prism' AS dataset, fdate, lat, lon, value FROM p WHERE """
    + _box(0.04) + " AND fdate BETWEEN DATE '1996-03-01' AND DATE '1999-10-31'",
)
def prism_cells(spark, d):
    """Variable and date read from file names."""
    code = F.get(F.array(F.lit("ppt"), F.lit("tmax"), F.lit("tmin")), F.col("col") % 3)
    path = F.concat(
        F.lit("/daily/PRISM_"), code, F.lit("_stable_4kmD1_"), F.date_format("fdate", "yyyyMMdd"),
        F.lit("_bil.bil"),
    )
    raw = I.grid_daily(spark, d).select(path.alias("path"), "lat", "lon", F.col("value").alias("raw"))
    return normalise("prism", raw, BBOX, start="1996-03-01", end="1999-10-31")


_EVENT_PLACE = """e AS (SELECT CAST(ts AS DATE) AS fdate, ts, 2.0 - 0.5 * (user_id % 8) AS lat,
    32.0 + 0.5 * ((user_id // 8) % 8) AS lon, event_type, value FROM events)"""


def _events(spark, d):
    e = I.table(spark, d, "events")
    return e.select(
        "ts", F.to_date("ts").alias("fdate"), (2.0 - 0.5 * (F.col("user_id") % 8)).alias("lat"),
        (32.0 + 0.5 * (F.floor(F.col("user_id") / 8) % 8)).alias("lon"), "event_type", "value",
    )


def _tall_sql(wide: str, dataset: str) -> str:
    parts = [
        f"SELECT '{v}' AS var, '{dataset}' AS dataset, fdate, lat, lon, {v} AS value FROM ({wide})"
        for v in ("tmax", "tmin", "wind")
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


@query(
    "ncep_cells", CELL_COLS,
    "WITH " + _EVENT_PLACE + ", w AS (SELECT fdate, lat, lon, "
    "max(CASE WHEN event_type = 'view' THEN value END) - 273.15 AS tmax, "
    "max(CASE WHEN event_type = 'click' THEN value END) - 273.15 AS tmin, "
    "sqrt(pow(max(CASE WHEN event_type = 'error' THEN value END), 2) + "
    "pow(max(CASE WHEN event_type = 'signup' THEN value END), 2)) AS wind "
    f"FROM e WHERE {_box(1.875)} GROUP BY 1, 2, 3) " + _tall_sql("SELECT * FROM w", "ncep"),
)
def ncep_cells(spark, d):
    """Kelvin to Celsius and wind from two aligned fields."""
    field = (
        F.when(F.col("event_type") == "view", "tmax").when(F.col("event_type") == "click", "tmin")
        .when(F.col("event_type") == "error", "u").when(F.col("event_type") == "signup", "v")
    )
    raw = _events(spark, d).select(
        field.alias("field"), "fdate", "lat", "lon", F.col("value").alias("raw")
    )
    return normalise("ncep", raw, BBOX)


@query(
    "merra_cells", CELL_COLS,
    "WITH " + _EVENT_PLACE + ", w AS (SELECT fdate, lat, lon, max(value) - 273.15 AS tmax, "
    "min(value) - 273.15 AS tmin, avg(sqrt(value * value + 16.0)) AS wind "
    f"FROM e WHERE {_box(0.5)} GROUP BY 1, 2, 3) " + _tall_sql("SELECT * FROM w", "merra"),
)
def merra_cells(spark, d):
    """Sub-daily rows to daily extremes and mean wind."""
    raw = _events(spark, d).select(
        "ts", "lat", "lon", F.col("value").alias("t2m"), F.col("value").alias("u10m"),
        F.lit(4.0).alias("v10m"),
    )
    return normalise("merra", raw, BBOX)


_ORBITS = """, o AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'D' END AS orbit,
    CAST(o_orderdate AS DATE) AS fdate, (o_custkey // 40) % 360 AS r,
    o_custkey % 40 + 40 * ((o_custkey // 14400) % 8) AS c,
    max(CASE WHEN o_orderkey % 11 = 0 THEN -9999 ELSE floor(o_totalprice / 1000) END) AS raw
    FROM orders GROUP BY 1, 2, 3, 4),
    m AS (SELECT fdate, 5 - 0.25 * r AS lat, 30 + 0.25 * c AS lon,
    coalesce(max(CASE WHEN orbit = 'D' THEN raw END), max(CASE WHEN orbit = 'A' THEN raw END)) AS raw
    FROM o GROUP BY 1, 2, 3)"""


def _orbits(spark, d):
    o = I.table(spark, d, "orders")
    placed = o.select(
        F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("D").alias("orbit"),
        F.to_date("o_orderdate").alias("fdate"),
        I.grid_row(F.col("o_custkey")).alias("r"), I.grid_col(F.col("o_custkey")).alias("c"),
        F.when(F.col("o_orderkey") % 11 == 0, -9999.0)
        .otherwise(F.floor(F.col("o_totalprice") / 1000)).alias("v"),
    )
    out = placed.groupBy("orbit", "fdate", "r", "c").agg(F.max("v").alias("raw"))
    return out.select(
        "orbit", "fdate", (F.lit(5.0) - 0.25 * F.col("r")).alias("lat"),
        (F.lit(30.0) + 0.25 * F.col("c")).alias("lon"), "raw",
    )


@query(
    "amsre_cells", CELL_COLS,
    "WITH x AS (SELECT 1)" + _ORBITS + " SELECT * FROM ("
    + _cells_sql("soilmoist", "amsre", 0.25, "CASE WHEN abs(raw) <> 9999 THEN raw / 1000.0 END", "m")
    + ") WHERE value IS NOT NULL",
)
def amsre_cells(spark, d):
    """Two orbits merged, masked and scaled."""
    return normalise("amsre", _orbits(spark, d), BBOX).filter(F.col("value").isNotNull())


@query(
    "smos_cells", CELL_COLS,
    views("grid_daily") + """, s AS (SELECT fdate - DATE '1995-01-01' AS k, lat + 0.08 AS lat,
    lon + 0.08 AS lon, value FROM grid_daily),
    t AS (SELECT * FROM s WHERE """ + _box(0.25) + """ AND k >= 0),
    e AS (SELECT round(max(lat), 1) AS a, round(min(lat), 1) AS b, round(min(lon), 1) AS c,
    round(max(lon), 1) AS d FROM t),
    tlat AS (SELECT round(a - i * 0.25, 6) AS tl FROM e, range(0, 1000) AS r(i)
    WHERE i <= round((a - b) / 0.25)),
    tlon AS (SELECT round(c + i * 0.25, 6) AS tl FROM e, range(0, 2000) AS r(i)
    WHERE i <= round((d - c) / 0.25)),
    mlat AS (SELECT tl, lat FROM (SELECT tl, lat, row_number() OVER
    (PARTITION BY tl ORDER BY abs(tl - lat), lat) AS rn FROM tlat, (SELECT DISTINCT lat FROM t)) WHERE rn = 1),
    mlon AS (SELECT tl, lon FROM (SELECT tl, lon, row_number() OVER
    (PARTITION BY tl ORDER BY abs(tl - lon), lon) AS rn FROM tlon, (SELECT DISTINCT lon FROM t)) WHERE rn = 1)
    SELECT 'soilmoist' AS var, 'smos' AS dataset, DATE '2010-01-12' + CAST(k AS INTEGER) AS fdate,
    mlat.tl AS lat, mlon.tl AS lon, value FROM t JOIN mlat USING (lat) JOIN mlon USING (lon)""",
)
def smos_cells(spark, d):
    """Nearest-neighbour move to a regular grid; days counted from the product start."""
    g = I.grid_daily(spark, d)
    raw = g.select(
        F.datediff("fdate", F.lit("1995-01-01").cast("date")).alias("day_index"),
        (F.col("lat") + 0.08).alias("lat"), (F.col("lon") + 0.08).alias("lon"),
        F.col("value").alias("raw"),
    )
    return normalise("smos", raw, BBOX)


def _smap(product: str, res: float) -> None:
    @query(
        f"{product}_cells", CELL_COLS,
        views("grid_daily") + ", g AS (SELECT fdate, lat, CASE WHEN lon + 300 > 180 THEN lon + 300 - 360 "
        f"ELSE lon + 300 END AS lon, value FROM grid_daily) SELECT 'soilmoist' AS var, '{product}' AS dataset, "
        f"fdate, lat, lon, value FROM g WHERE lat > -3.3 - {res / 2} AND lat < 3.9 + {res / 2} "
        f"AND lon > -28.0 - {res / 2} AND lon < -24.0 + {res / 2}",
    )
    def run(spark, d):
        raw = _raw(spark, d).withColumn("lon", F.col("lon") + 300)
        return normalise(product, raw, (-28.0, -3.3, -24.0, 3.9))

    run.__doc__ = f"{product}: longitudes above 180 wrap before the subset."


_smap("smap", 0.36)
_smap("smape", 0.09)


@query(
    "grace_cells", CELL_COLS,
    views("grid_daily", "grid_static") + """, f AS (SELECT CAST(floor(90 - lat + 0.5) AS BIGINT) AS r,
    CAST(floor(lon + 180 + 0.5) AS BIGINT) AS c, 1 + max(col) / 100.0 AS factor
    FROM grid_static GROUP BY 1, 2)
    SELECT 'tws' AS var, 'grace' AS dataset, fdate, lat, lon, value * factor AS value
    FROM grid_daily g JOIN f ON f.r = CAST(floor(90 - lat + 0.5) AS BIGINT)
    AND f.c = CAST(floor(lon + 180 + 0.5) AS BIGINT) WHERE """ + _box(1.0),
)
def grace_cells(spark, d):
    """Values times a static scaling grid."""
    g = I.grid_static(spark, d).drop("row")
    scale = with_index(g.withColumnRenamed("col", "k"), 90.0, -180.0, 1.0)
    scale = scale.groupBy("row", "col").agg((1 + F.max("k") / 100.0).alias("factor"))
    scaling = scale.select(
        (90.0 - F.col("row")).alias("lat"), (F.col("col") - 180.0).alias("lon"), "factor"
    )
    return normalise("grace", _raw(spark, d), BBOX, scaling=scaling)


def _tiles(spark, d):
    o = I.table(spark, d, "orders")
    placed = o.select(
        F.to_date("o_orderdate").alias("fdate"),
        (F.lit(3.0) - 0.005 * (F.col("o_custkey") % 400)).alias("lat"),
        (F.lit(32.0) + 0.005 * (F.floor(F.col("o_custkey") / 3) % 400)).alias("lon"),
        (F.col("o_orderkey") % 3).alias("tile_order"),
        (F.floor(F.col("o_totalprice")) % 140).cast("double").alias("v"),
    )
    return placed.groupBy("fdate", "lat", "lon", "tile_order").agg(F.max("v").alias("raw"))


_TILES = """WITH t AS (SELECT CAST(o_orderdate AS DATE) AS fdate, 3.0 - 0.005 * (o_custkey % 400) AS lat,
    32.0 + 0.005 * ((o_custkey // 3) % 400) AS lon, o_orderkey % 3 AS tile_order,
    max(floor(o_totalprice) % 140) AS raw FROM orders GROUP BY 1, 2, 3, 4),
    m AS (SELECT fdate, lat, lon, max_by(raw, tile_order) AS raw FROM t WHERE {box} GROUP BY 1, 2, 3)"""


def _mosaic(product: str, var: str, dataset: str, res: float, limit: float, scale: str) -> None:
    @query(
        f"{product}_cells", CELL_COLS,
        _TILES.format(box=_box(res)) + f" SELECT '{var}' AS var, '{dataset}' AS dataset, fdate, lat, "
        f"lon, raw * {scale} AS value FROM m WHERE raw < {limit}",
    )
    def run(spark, d):
        out = normalise(product, _tiles(spark, d), BBOX)
        return out.filter(F.col("value").isNotNull())

    run.__doc__ = f"{product}: tiles overlaid, masked and scaled."


_mosaic("mod10", "snow", "mod10", 0.005, 101, "1.0")
_mosaic("modscag", "snow", "modscag", 0.01, 101, "1.0")
_mosaic("mod16", "evap", "mod16", 0.01, 32701, "0.1")


@query(
    "mcd15_cells", CELL_COLS,
    _TILES.format(box=_box(0.005)) + """, g AS (SELECT fdate,
    CAST(floor((90 - lat) / 0.005 + 1e-9) AS BIGINT) AS r,
    CAST(floor((lon + 180) / 0.005 + 1e-9) AS BIGINT) AS c,
    avg(raw * 0.1) AS value FROM m WHERE raw < 101 GROUP BY 1, 2, 3)
    SELECT 'lai' AS var, 'modis' AS dataset, fdate, 90 - (r + 0.5) * 0.005 AS lat,
    -180 + (c + 0.5) * 0.005 AS lon, value FROM g""",
)
def mcd15_cells(spark, d):
    """Leaf-area tiles overlaid, masked, scaled and regridded."""
    return normalise("mcd15", _tiles(spark, d), BBOX)


@query(
    "iri_terciles", "fdate:d lat:f lon:f leadtime:i tercile:s prob:f",
    """WITH o AS (SELECT DISTINCT (year(o_orderdate) - 1960) * 12 + month(o_orderdate) - 1 AS months,
    2.5 * (o_custkey % 8) AS lat, 2.5 * (o_custkey % 5) + 180 AS lon FROM orders)
    SELECT CAST(DATE '1960-01-01' + to_months(CAST(months AS INTEGER)) AS DATE) AS fdate, lat,
    CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, a + 1 AS leadtime,
    ['below', 'normal', 'above'][t + 1] AS tercile, (months + 10 * a + t) % 97 AS prob
    FROM o, range(0, 3) AS x(a), range(0, 3) AS y(t)""",
)
def iri_terciles(spark, d):
    """Nested lead by tercile arrays to rows, months since 1960 to dates."""
    o = I.table(spark, d, "orders")
    m = (F.year("o_orderdate") - 1960) * 12 + F.month("o_orderdate") - 1
    raw = o.select(
        (m + 0.5).alias("months"), (2.5 * (F.col("o_custkey") % 8)).alias("lat"),
        (2.5 * (F.col("o_custkey") % 5) + 180).alias("lon"),
    ).distinct()
    base = F.floor(F.col("months")).cast("int")
    prob = F.array(*[F.array(*[((base + 10 * a + t) % 97).cast("double") for t in range(3)]) for a in range(3)])
    return normalise("iri", raw.withColumn("prob", prob))


@query(
    "nmme_cells", "var:s fdate:d lat:f lon:f ensemble:i value:f",
    views("grid_daily") + """ SELECT CASE WHEN row % 2 = 0 THEN 'tmax' ELSE 'precip' END AS var, fdate,
    lat, lon, col % 10 + 1 AS ensemble, CASE WHEN row % 2 = 0 THEN value - 273.15 ELSE value END AS value
    FROM grid_daily WHERE """ + _box(0.5),
)
def nmme_cells(spark, d):
    """Forecast members; dates from file names, temperatures from kelvin."""
    g = I.grid_daily(spark, d)
    raw = g.select(
        F.concat(F.lit("fcst_m01_"), F.lit("d"), F.date_format("fdate", "yyyyMMdd"), F.lit(".tif")).alias("path"),
        F.when(F.col("row") % 2 == 0, "Temperature").otherwise("Precipitation").alias("variable"),
        (F.col("col") % 10 + 1).alias("ensemble"), "lat", "lon", F.col("value").alias("raw"),
    )
    return normalise("nmme", raw, BBOX)


_PRODUCTS = ", ".join(
    f"({i}, '{p[1]}', {p[2]}, '{p[7]}', {p[5]})" for i, p in enumerate(catalog.PRODUCTS)
)


@query(
    "product_catalog", "dataset:s mode:s resolution:f n:i",
    f"""WITH p(i, dataset, first_year, mode, resolution) AS (VALUES {_PRODUCTS})
    SELECT dataset, mode, resolution, count(*) AS n FROM orders JOIN p ON i = o_custkey % {len(catalog.PRODUCTS)}
    WHERE year(o_orderdate) >= first_year GROUP BY 1, 2, 3""",
)
def product_catalog(spark, d):
    """Rows per product that fall in its time span, with use and resolution."""
    names = F.array(*[F.lit(p[1]) for p in catalog.PRODUCTS])
    o = I.table(spark, d, "orders").select(
        F.get(names, (F.col("o_custkey") % len(catalog.PRODUCTS)).cast("int")).alias("dataset"),
        F.year("o_orderdate").alias("y"),
    )
    counts = o.groupBy("dataset", "y").agg(F.count("*").alias("n"))
    joined = counts.join(F.broadcast(catalog.products(spark)), "dataset")
    kept = joined.filter(F.col("y") >= F.col("first_year"))
    return kept.groupBy("dataset", "mode", "resolution").agg(F.sum("n").alias("n"))


@query(
    "model_series", "lat:f lon:f fdate:d var:s layer:i value:f",
    views("daily") + """ SELECT 1 + gid * 0.25 AS lat, 30.5 AS lon, fdate, u.var, u.layer, u.value FROM
    (SELECT gid, fdate, unnest([{'var': 'rainf', 'layer': 0, 'value': rainf},
    {'var': 'soil_moist', 'layer': 1, 'value': runoff},
    {'var': 'soil_moist', 'layer': 2, 'value': rainf + runoff}]) AS u FROM daily)""",
)
def model_series(spark, d):
    """Whitespace-separated model lines, one file per cell, to tall rows."""
    s = I.daily(spark, d)
    path = F.format_string("output/wb_%.2f_%.2f", 1 + F.col("gid") * 0.25, F.lit(30.5))
    line = F.format_string(
        "  %d %d  %d %.1f   %.1f %.1f", F.year("fdate"), F.month("fdate"), F.dayofmonth("fdate"),
        F.col("rainf"), F.col("runoff"), F.col("rainf") + F.col("runoff"),
    )
    columns = text.output_columns(["rainf", "soil_moist"], 2, catalog.LAYERED)
    out = text.parse_model_series(
        s.select(path.alias("path"), line.alias("value")), columns, 2, tuple(catalog.LAYERED)
    )
    return out.withColumn("layer", F.coalesce("layer", F.lit(0)))


@query(
    "growth_rows", "gid:i ensemble:i fdate:d lai:f gwad:f wsgd:f",
    """SELECT l_suppkey AS gid, l_orderkey % 5 + 1 AS ensemble,
    make_date(2003, 1, 1) + CAST(dayofyear(l_shipdate) - 1 AS INTEGER) AS fdate, l_tax AS lai,
    l_quantity - 3 AS gwad, l_discount AS wsgd FROM lineitem WHERE l_quantity > 3""",
)
def growth_rows(spark, d):
    """Crop growth text: header lines dropped, days of year to dates, zero yields dropped."""
    li = I.table(spark, d, "lineitem")
    zeros = lambda n: [F.lit("0")] * n
    line = F.concat_ws(
        "  ", F.lit(" 2003"), F.dayofyear("l_shipdate").cast("string"), *zeros(4),
        F.col("l_tax").cast("string"), *zeros(2), (F.col("l_quantity") - 3).cast("string"), *zeros(8),
        F.col("l_discount").cast("string"),
    )
    heads = F.array(F.lit("*GROWTH OUTPUT"), F.lit("@YEAR DOY DAS"), line)
    rows = li.select(
        F.col("l_suppkey").alias("gid"), (F.col("l_orderkey") % 5 + 1).alias("ensemble"),
        F.explode(heads).alias("value"),
    )
    return text.parse_growth(rows, F.lit(2003))


@query(
    "soil_profiles", "lat:f lon:f layers:i deepest:f head:s",
    """SELECT -1.5 + s_suppkey * 0.1 AS lat, 30 + (s_suppkey % 50) * 0.1 AS lon, 3 AS layers,
    60.0 + s_suppkey % 40 AS deepest, 'P' || s_suppkey || ' loam' AS head FROM supplier""",
)
def soil_profiles(spark, d):
    """Profile records with headings, a site line and layer lines."""
    s = I.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    record = F.format_string(
        "*P%d loam\n@SITE COUNTRY LAT LONG SCS\n LOC KE %.2f %.2f SAND\n@ SCOM SALB\n BN 0.13 6.0 0.5 61 1.0\n"
        "@ SLB SLMH\n 5 A 0.1 0.2 0.3 1.00\n 15 B 0.1 0.2 0.3 0.85\n %d C 0.1 0.2 0.3 0.70\n",
        k, -1.5 + k * 0.1, 30 + (k % 50) * 0.1, 60 + k % 40,
    )
    out = text.parse_soil_profiles(s.select(record.alias("value")))
    return out.select(
        "lat", "lon", F.size("bottoms").alias("layers"), F.array_max("bottoms").alias("deepest"),
        F.get(F.split("props", "\r\n"), 0).alias("head"),
    )


@query(
    "crop_calendars", "type:s row:i col:i doy:i",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'maize' ELSE 'rice' END AS type,
    (o_custkey // 40) % 360 AS row, o_custkey % 40 + 40 * ((o_custkey // 14400) % 8) AS col,
    dayofyear(o_orderdate) AS doy FROM orders""",
)
def crop_calendars(spark, d):
    """Planting-day tables of several seasons appended and stamped with the crop."""
    o = I.table(spark, d, "orders")
    cells = o.select(
        I.grid_row(F.col("o_custkey")).alias("row"), I.grid_col(F.col("o_custkey")).alias("col"),
        F.dayofyear("o_orderdate").alias("doy"), "o_orderstatus",
    )
    part = lambda cond: cells.filter(cond).drop("o_orderstatus")
    return tables.append_typed([
        ("maize", part(F.col("o_orderstatus") == "F")),
        ("rice", part(F.col("o_orderstatus") == "O")),
        ("rice", part(~F.col("o_orderstatus").isin("F", "O"))),
    ])


@query(
    "area_centroids", "area:i x:f y:f xmin:f ymax:f",
    views("areas") + " SELECT area, cx AS x, cy AS y, cx - r AS xmin, cy + r AS ymax FROM areas",
)
def area_centroids(spark, d):
    """Centroid and box from polygon texts."""
    return I.areas(spark, d).select(
        "area", F.col("centroid.x").alias("x"), F.col("centroid.y").alias("y"),
        F.col("bbox.xmin").alias("xmin"), F.col("bbox.ymax").alias("ymax"),
    )


@query(
    "date_scan", "gid:i fdate:d rainf:f",
    views("daily") + " SELECT gid, fdate, rainf FROM daily "
    "WHERE fdate >= DATE '1997-02-03' AND fdate <= DATE '1998-11-20'",
)
def date_scan(spark, d):
    return between(I.daily(spark, d), "1997-02-03", "1998-11-20")


@query(
    "date_functions", "fdate:d yyddd:s from_doy:d planting:d fixed:d wrapped:i n:i",
    """SELECT fdate, strftime(fdate, '%y%j') AS yyddd, make_date(year(fdate), 1, 1)
    + CAST(dayofyear(fdate) - 1 AS INTEGER) AS from_doy,
    CASE WHEN dayofyear(fdate) > 8 THEN fdate - 7 ELSE fdate END AS planting,
    make_date(CASE WHEN year(fdate) % 4 = 0 THEN 2008 ELSE 2009 END, month(fdate), day(fdate)) AS fixed,
    CASE WHEN month(fdate) >= 11 OR month(fdate) <= 2 THEN 1 ELSE 0 END AS wrapped, count(*) AS n
    FROM (SELECT CAST(l_shipdate AS DATE) AS fdate FROM lineitem) GROUP BY fdate""",
)
def date_functions(spark, d):
    """Calendar expressions on every ship date."""
    rows = I.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("fdate")).agg(
        F.count("*").alias("n")
    )
    day = F.col("fdate")
    return rows.select(
        "fdate", D.short_doy(day).alias("yyddd"),
        D.doy_to_date(F.year(day), F.dayofyear(day)).alias("from_doy"),
        D.simulation_start(day).alias("planting"), D.fixed_year(day).alias("fixed"),
        D.in_month_range(day, 11, 2).cast("int").alias("wrapped"), "n",
    )


@query(
    "date_in_name", "fdate:d n:i",
    "SELECT CAST(o_orderdate AS DATE) AS fdate, count(*) AS n FROM orders GROUP BY 1",
)
def date_in_name(spark, d):
    """Date taken by position from output file names."""
    o = I.table(spark, d, "orders")
    name = F.concat(F.lit("runoff_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_01.tif"))
    return o.groupBy(D.date_at(name, 8).alias("fdate")).agg(F.count("*").alias("n"))


