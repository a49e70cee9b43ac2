"""Ensemble Kalman analyses and model-state updates.

Embeddings serve as ensemble rows: the label is the date, the first 20 dimensions the state
members, the next 20 the predicted observations, dimension 41 the observation and
dimensions 42-61 (tenths) the error draws.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellcast.operators import assimilation as A
from cellcast.operators.spatial import nearest_join
from cellcast.queries import inputs as I
from cellcast.queries.inputs import LEFT, TOP, views
from cellcast.queries.registry import query
from cellcast.plans import flows
from cellcast.session import cut_lineage, ensure_checkpoint_dir

N = 20


def _rows(spark, d):
    e = I.table(spark, d, "embeddings")
    part = lambda start: F.transform(F.slice("embedding", start, N), lambda v: v.cast("double"))
    return e.select(
        F.col("vec_id").alias("gid"), F.col("label").alias("fdate"), part(1).alias("a"),
        part(N + 1).alias("ha"), F.get("embedding", 2 * N).cast("double").alias("d"),
        F.transform(part(2 * N + 2), lambda v: v * 0.1).alias("e"),
    )


def _analysis(method: str):
    @query(f"{method}_analysis", "gid:i fdate:i ensemble:i x:f xa:f")
    def run(spark, d):
        rows = _rows(spark, d)
        out = A.analyse(
            rows.select("gid", "fdate", "a"), rows.select("fdate", "ha", "d", "e"), method
        )
        return A.unpack_members(out, ["gid", "fdate"])

    run.__doc__ = f"Full {method} analysis of every state row."


for _method in ("letkf", "enkf", "sqrtenkf"):
    _analysis(_method)

_OBS = """WITH o AS (SELECT label AS fdate, list_transform(embedding[21:40], lambda v: v::DOUBLE) AS ha,
    embedding[41]::DOUBLE AS d, list_transform(embedding[42:61], lambda v: v::DOUBLE * 0.1) AS e FROM embeddings),
    m AS (SELECT fdate, ha, d, e, list_avg(ha) AS mean, 19.0 / list_sum(list_transform(e, lambda v: v * v)) AS inv FROM o),
    p AS (SELECT fdate, inv, d - mean AS res, list_transform(ha, lambda v: v - mean) AS y FROM m)"""


@query(
    "filter_gram", "fdate:i i:i j:i yy:f",
    _OBS + """ SELECT fdate, i - 1 AS i, j - 1 AS j, sum(y[i] * y[j] * inv) AS yy
    FROM p, range(1, 21) AS a(i), range(1, 21) AS b(j) GROUP BY 1, 2, 3""", digits=4,
)
def filter_gram(spark, d):
    """Weighted sums of member products over all observations of a date."""
    sums = A.gram_sums(_rows(spark, d).select("fdate", "ha", "d", "e"))
    tall = sums.select("fdate", F.posexplode("yy").alias("k", "yy"))
    return tall.select("fdate", F.floor(F.col("k") / N).alias("i"), (F.col("k") % N).alias("j"), "yy")


@query(
    "filter_innovation", "fdate:i i:i yd:f nobs:i",
    _OBS + """ SELECT fdate, i - 1 AS i, sum(y[i] * res * inv) AS yd, count(*) AS nobs
    FROM p, range(1, 21) AS a(i) GROUP BY 1, 2""", digits=4,
)
def filter_innovation(spark, d):
    """Weighted sums of members and residuals over all observations of a date."""
    sums = A.gram_sums(_rows(spark, d).select("fdate", "ha", "d", "e"))
    tall = sums.select("fdate", "nobs", F.posexplode("yd").alias("i", "yd"))
    return tall.filter(F.col("i") < N)


@query(
    "observation_dates", "fdate:d",
    """WITH RECURSIVE o AS (SELECT DISTINCT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS fdate FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'),
    k AS (SELECT status, min(fdate) AS fdate FROM o GROUP BY status
    UNION ALL SELECT * FROM (SELECT k.status, (SELECT min(o.fdate) FROM o WHERE o.status = k.status
    AND o.fdate >= k.fdate + 30) AS fdate FROM k) WHERE fdate IS NOT NULL)
    SELECT DISTINCT fdate FROM k WHERE fdate NOT IN (DATE '1996-01-01', DATE '1999-12-31')""",
)
def observation_dates(spark, d):
    """Monthly analysis dates over three products, first and last day left out."""
    o = I.table(spark, d, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("fdate"))
    return A.observation_dates(o, "o_orderstatus", "1996-01-01", "1999-12-31", "monthly")


@query(
    "state_vector", "gid:i fdate:d members:i total:f first:f",
    views("member_series") + """, s AS (SELECT gid, fdate, ensemble, sum(value) AS v FROM member_series GROUP BY 1, 2, 3)
    SELECT gid, fdate, count(*) AS members, sum(v) AS total, arg_min(v, ensemble) AS first FROM s GROUP BY 1, 2""",
)
def state_vector(spark, d):
    """Layer sums per cell, day and member, packed by member."""
    out = A.state_vector(I.member_series(spark, d))
    return out.select(
        "gid", "fdate", F.size("a").alias("members"),
        F.aggregate("a", F.lit(0.0), lambda acc, v: acc + v).alias("total"), F.get("a", 0).alias("first"),
    )


@query(
    "predicted_moisture", "row:i col:i fdate:d ensemble:i value:f",
    views("basin") + f""", i AS (SELECT gid, lat, lon, elev, CAST(floor(({TOP} + 0.125 - lat) + 1e-9) AS BIGINT) AS row,
    CAST(floor((lon - {LEFT} + 0.125) + 1e-9) AS BIGINT) AS col FROM basin),
    li AS (SELECT l_suppkey AS gid, CAST(l_shipdate AS DATE) AS fdate, l_orderkey % 5 + 1 AS ensemble, sum(l_quantity) AS value
    FROM lineitem WHERE (l_linenumber - 1) % 3 + 1 = 1 GROUP BY 1, 2, 3),
    c AS (SELECT DISTINCT row, col, {TOP} + 0.125 - (row + 0.5) AS clat, {LEFT} - 0.125 + (col + 0.5) AS clon FROM i),
    z AS (SELECT c.row, c.col, arg_min(0.1 + (gid % 5) * 0.05, (round(sqrt(pow(lat - clat, 2) + pow(lon - clon, 2)), 9), gid)) AS depth
    FROM c, i GROUP BY 1, 2)
    SELECT i.row, i.col, fdate, ensemble, avg(value) / (1000.0 * any_value(depth)) AS value
    FROM li JOIN i USING (gid) JOIN z ON z.row = i.row AND z.col = i.col GROUP BY 1, 2, 3, 4""",
)
def predicted_moisture(spark, d):
    """Top-layer moisture on the observation grid over the depth of the nearest cell."""
    b = I.basin(spark, d)
    row = F.floor(F.lit(TOP) + 0.125 - F.col("lat") + 1e-9).cast("int")
    col = F.floor(F.col("lon") - LEFT + 0.125 + 1e-9).cast("int")
    placed = b.withColumn("row", row).withColumn("col", col)
    fine = I.member_series(spark, d).join(placed.select("gid", "row", "col"), "gid")
    centres = placed.select("row", "col").distinct().select(
        "row", "col", (F.lit(TOP) + 0.125 - (F.col("row") + 0.5)).alias("clat"),
        (F.lit(LEFT) - 0.125 + (F.col("col") + 0.5)).alias("clon"),
    )
    near = nearest_join(centres, b, ("clon", "clat"), ("lon", "lat"), "gid")
    depth = near.select("row", "col", (0.1 + (F.col("gid") % 5) * 0.05).alias("depth"))
    return A.predicted_moisture(fine, depth, ["row", "col"])


@query("error_draws", "gid:i draws:i spread:f")
def error_draws(spark, d):
    """Error draws of each observation, distribution by product."""
    e = I.table(spark, d, "embeddings").select(F.col("vec_id").alias("gid"), "label")
    kind = F.get(
        F.array(*[F.lit(x) for x in ("norm,0,0.1", "uniform,-1,2", "laplace 0 0.2", "unknown,1")]),
        F.col("label") % 4,
    )
    out = A.error_draws(e, N, 3, ["gid"], F.lit(0.01), kind)
    return out.select(
        "gid", F.size("e").alias("draws"),
        (F.array_max("e") - F.array_min("e")).alias("spread"),
    )


@query(
    "combined_products", "gid:i fdate:d value:f",
    views("daily") + """, a AS (SELECT gid, fdate, rainf AS value FROM daily WHERE rainf > 25),
    b AS (SELECT gid, fdate, runoff AS value FROM daily)
    SELECT * FROM a UNION ALL SELECT gid, fdate, value FROM b ANTI JOIN a USING (gid, fdate)""",
)
def combined_products(spark, d):
    """Two products of one variable: the first product of a key is kept."""
    s = I.daily(spark, d)
    first = s.filter("rainf > 25").select("gid", "fdate", F.col("rainf").alias("value"))
    second = s.select("gid", "fdate", F.col("runoff").alias("value"))
    return A.combine_products([first, second], ["gid", "fdate"])


_CLASSES = ", ".join(f"('{p}', {r}, {s})" for p, _, _, _, r, s in A.OBSERVATION_CLASSES)


@query(
    "observation_classes", "product:s n:i mean_error:f",
    f"""WITH c(product, res, std) AS (VALUES {_CLASSES}), o AS (SELECT ['amsre', 'smos', 'smap', 'smape', 'modscag', 'mod10', 'mod16'][o_custkey % 7 + 1] AS product
    FROM orders) SELECT product, count(*) AS n, avg(std) AS mean_error FROM o JOIN c USING (product) GROUP BY 1""",
)
def observation_classes(spark, d):
    """Observation rows matched with the error of their product."""
    names = F.array(*[F.lit(c[0]) for c in A.OBSERVATION_CLASSES])
    o = I.table(spark, d, "orders")
    counts = o.groupBy(F.get(names, (F.col("o_custkey") % 7).cast("int")).alias("product")).agg(
        F.count("*").alias("n")
    )
    table = spark.createDataFrame(
        A.OBSERVATION_CLASSES,
        "product string, tablename string, statevar string, obsvar string, res double, stddev double",
    )
    return counts.join(F.broadcast(table), "product").select("product", "n", F.col("stddev").alias("mean_error"))


@query(
    "nearest_observation", "gid:i fdate:d oid:i distance:f",
    views("basin", "grid_daily") + """, s AS (SELECT gid, fdate, lat, lon FROM basin, (SELECT DISTINCT fdate FROM grid_daily)), o AS (SELECT row * 1000 + col AS oid, fdate, lat, lon FROM grid_daily)
    SELECT gid, fdate, oid, distance FROM (SELECT gid, s.fdate, oid, sqrt(pow(s.lat - o.lat, 2) + pow(s.lon - o.lon, 2)) AS distance,
    row_number() OVER (PARTITION BY gid, s.fdate ORDER BY round(sqrt(pow(s.lat - o.lat, 2) + pow(s.lon - o.lon, 2)), 9), oid) AS rn
    FROM s JOIN o USING (fdate)) WHERE rn = 1""",
)
def nearest_observation(spark, d):
    """Distance from model cells to the nearest observation of each date."""
    obs = I.grid_daily(spark, d).select(
        (F.col("row") * 1000 + F.col("col")).alias("oid"), "fdate", "lat", "lon"
    )
    # Cells without a date are asked on every date that has observations.
    states = I.basin(spark, d).select("gid", "lat", "lon")
    return A.nearest_observation(states, obs, 1.0)


_PARTS = """, parts AS (SELECT l_suppkey AS gid, CASE WHEN v = 2 THEN NULL ELSE [0.3, 0.25][v + 1] END AS veg_frac,
    [0.6, 0.4][b + 1] AS band_frac, v * 2 + b AS k, sum(l_quantity) / 1000.0 AS value
    FROM (SELECT l_suppkey, l_quantity, l_partkey % 3 AS v, (l_partkey // 3) % 2 AS b FROM lineitem) GROUP BY 1, 2, 3, 4)"""


def _parts(spark, d):
    li = I.table(spark, d, "lineitem")
    v, b = F.col("l_partkey") % 3, F.floor(F.col("l_partkey") / 3) % 2
    sums = li.groupBy(F.col("l_suppkey").alias("gid"), v.alias("v"), b.alias("b")).agg(
        (F.sum("l_quantity") / 1000.0).alias("value")
    )
    return sums.select(
        "gid", F.when(F.col("v") == 0, 0.3).when(F.col("v") == 1, 0.25).alias("veg_frac"),
        F.when(F.col("b") == 0, 0.6).otherwise(0.4).alias("band_frac"),
        (F.col("v") * 2 + F.col("b")).alias("k"), "value",
    )


@query(
    "area_weighted_state", "gid:i value:f",
    "WITH x AS (SELECT 1)" + _PARTS + """ SELECT gid, sum(CASE WHEN veg_frac IS NOT NULL THEN veg_frac ELSE 1 - 0.55 END
    * band_frac * value) AS value FROM parts GROUP BY gid""",
)
def area_weighted_state(spark, d):
    """Cell state from vegetation and elevation-band parts."""
    return A.area_weighted_state(_parts(spark, d), ["gid"])


@query(
    "moisture_update", "gid:i k:i value:f",
    "WITH x AS (SELECT 1)" + _PARTS + """, c AS (SELECT gid, sum(value) AS x, sum(value) * (0.8 + (gid % 5) * 0.1) AS xa FROM parts GROUP BY gid)
    SELECT gid, k, value * xa / x AS value FROM parts JOIN c USING (gid)""",
)
def moisture_update(spark, d):
    """Every part scales by analysis over background."""
    parts = _parts(spark, d)
    cells = parts.groupBy("gid").agg(F.sum("value").alias("x"))
    cells = cells.withColumn("xa", F.col("x") * (0.8 + (F.col("gid") % 5) * 0.1))
    joined = parts.join(cells, "gid")
    return joined.withColumn("value", A.update_moisture(F.col("value"), F.col("x"), F.col("xa")))


@query(
    "swe_update", "gid:i k:i swe:f coverage:f density:f cold_content:f cleared:i",
    "WITH x AS (SELECT 1)" + _PARTS + """, c AS (SELECT gid, CASE WHEN gid % 4 = 0 THEN 0 ELSE sum(value) END AS x,
    CASE gid % 3 WHEN 0 THEN -1 WHEN 1 THEN 40 ELSE 12.5 END AS xa FROM parts GROUP BY gid),
    s AS (SELECT gid, k, x, greatest(xa, 0) AS xa, CASE WHEN x = 0 THEN greatest(xa, 0) / 1000.0 ELSE value * greatest(xa, 0) / x END AS s
    FROM parts JOIN c USING (gid))
    SELECT gid, k, s AS swe, CASE WHEN xa = 0 THEN 0 WHEN x = 0 THEN 1 ELSE -1 END AS coverage,
    CASE WHEN xa = 0 THEN 0 WHEN x = 0 THEN 150 ELSE -1 END AS density,
    CASE WHEN xa = 0 THEN 0 WHEN x = 0 THEN -2102.0 * 1000 * s * 273.15 ELSE -1 END AS cold_content,
    CASE WHEN xa = 0 THEN 1 ELSE 0 END AS cleared FROM s""",
)
def swe_update(spark, d):
    """Snow update of every part: cleared, fresh and scaled packs (-1: left as it is)."""
    parts = _parts(spark, d)
    cells = parts.groupBy("gid").agg(F.sum("value").alias("_s")).select(
        "gid", F.when(F.col("gid") % 4 == 0, 0.0).otherwise(F.col("_s")).alias("x"),
        F.when(F.col("gid") % 3 == 0, -1.0).when(F.col("gid") % 3 == 1, 40.0).otherwise(12.5).alias("xa"),
    )
    new = A.update_swe(F.col("value"), F.col("x"), F.col("xa"))
    out = parts.join(cells, "gid").withColumn("_n", new)
    keep = lambda c: F.coalesce(F.col(f"_n.{c}"), F.lit(-1.0)).alias(c)
    return out.select(
        "gid", "k", "_n.swe", keep("coverage"), keep("density"), keep("cold_content"), "_n.cleared"
    )


@query(
    "observation_pixels", "area:i fdate:d row:i col:i value:f",
    views("grid_daily", "areas") + """ SELECT area, fdate, row, col, value FROM grid_daily JOIN areas
    ON abs(lon - cx) + abs(lat - cy) < r""",
)
def observation_pixels(spark, d):
    """Observed pixels inside the basin polygons on every date.

    Membership is found for distinct cells and joined to the daily rows; adaptive execution splits hot cells.
    """
    from cellcast.queries.grid_queries import _membership

    return I.grid_daily(spark, d).join(_membership(spark, d), ["row", "col"])




# Two members have closed forms: all anomalies are multiples of (1, -1), so N x N matrices are numbers.
_PAIR = """WITH RECURSIVE o AS (SELECT vec_id AS gid, label AS fdate, vec_id % 40 * 0.5 AS lon, vec_id // 40 % 20 * 0.5 AS lat,
    embedding[1]::DOUBLE AS a1, embedding[2]::DOUBLE AS a2, embedding[21]::DOUBLE AS h1, embedding[22]::DOUBLE AS h2, embedding[41]::DOUBLE AS d,
    embedding[42]::DOUBLE * 0.1 AS e1, embedding[43]::DOUBLE * 0.1 AS e2 FROM embeddings),
    q AS (SELECT *, (h1 - h2) / 2 AS y, d - (h1 + h2) / 2 AS res, 1 / (e1 * e1 + e2 * e2) AS inv, (a1 - a2) / 2 AS x, (a1 + a2) / 2 AS m FROM o)"""


def _pairs(spark, d):
    """Rows with two members and a place."""
    e = I.table(spark, d, "embeddings")
    two = lambda k: F.array(*[F.get("embedding", k + i).cast("double") for i in (0, 1)])
    return e.select(
        F.col("vec_id").alias("gid"), F.col("label").alias("fdate"), (F.col("vec_id") % 40 * 0.5).alias("lon"),
        (F.floor(F.col("vec_id") / 40) % 20 * 0.5).alias("lat"), two(0).alias("a"), two(20).alias("ha"),
        F.get("embedding", 40).cast("double").alias("d"), F.transform(two(41), lambda v: v * 0.1).alias("e"),
    )


@query(
    "letkf_pair", "gid:i fdate:i ensemble:i xa:f",
    _PAIR + """, s AS (SELECT fdate, 1 / (1 / 1.05 + 2 * sum(y * y * inv)) AS p, sum(y * res * inv) AS t FROM q GROUP BY 1)
    SELECT gid, fdate, k AS ensemble, m + (3 - 2 * k) * x * sqrt(p) + 2 * x * p * t AS xa FROM q JOIN s USING (fdate), range(1, 3) AS r(k)""",
)
def letkf_pair(spark, d):
    """Transform analysis of two members."""
    rows = _pairs(spark, d)
    out = A.analyse(rows.select("gid", "fdate", "a"), rows.select("fdate", "ha", "d", "e"), "letkf")
    return A.unpack_members(out, ["gid", "fdate"])


@query(
    "enkf_pair", "gid:i fdate:i ensemble:i xa:f",
    _PAIR + """, z AS (SELECT *, y + e1 AS z1, e2 - y AS z2, d + (e1 + e2) / 2 AS dp FROM q),
    s AS (SELECT fdate, sum(z1 * z1) AS g11, sum(z1 * z2) AS g12, sum(z2 * z2) AS g22, sum(y * z1) AS u1, sum(y * z2) AS u2,
    sum(z1 * (dp - h1)) AS k11, sum(z1 * (dp - h2)) AS k12, sum(z2 * (dp - h1)) AS k21, sum(z2 * (dp - h2)) AS k22 FROM z GROUP BY 1),
    l AS (SELECT *, (g11 + g22) / 2 + sqrt(pow((g11 - g22) / 2, 2) + g12 * g12) AS l1, greatest(0, (g11 + g22) / 2 - sqrt(pow((g11 - g22) / 2, 2)
    + g12 * g12)) AS l2 FROM s), v AS (SELECT *, atan2(l1 - g11, g12) AS turn FROM l),
    c AS (SELECT *, CASE WHEN sqrt(l1) / (sqrt(l1) + sqrt(l2)) > 0.999 THEN 0 ELSE 1 / (l1 * l1) END AS f, cos(turn) AS v1, sin(turn) AS v2 FROM v),
    w AS (SELECT *, (u1 * v1 + u2 * v2) * f AS h FROM c)
    SELECT gid, q.fdate, k AS ensemble, CASE WHEN k = 1 THEN a1 ELSE a2 END
    + 2 * x * h * CASE WHEN k = 1 THEN v1 * k11 + v2 * k21 ELSE v1 * k12 + v2 * k22 END AS xa FROM q JOIN w ON q.fdate = w.fdate, range(1, 3) AS r(k)""",
)
def enkf_pair(spark, d):
    """Perturbed-observation analysis of two members."""
    rows = _pairs(spark, d)
    out = A.analyse(rows.select("gid", "fdate", "a"), rows.select("fdate", "ha", "d", "e"), "enkf")
    return A.unpack_members(out, ["gid", "fdate"])


@query(
    "local_analysis", "gid:i fdate:i ensemble:i xa:f",
    _PAIR + """, p AS (SELECT DISTINCT fdate, floor(lon / 1.5) AS px, floor(lat / 1.5) AS py FROM q),
    n AS (SELECT p.fdate, px, py, y, res, inv, sqrt(pow(lon - (px + 0.5) * 1.5, 2) + pow(lat - (py + 0.5) * 1.5, 2)) / 2 AS z
    FROM p JOIN q USING (fdate)), g AS (SELECT *, CASE WHEN z <= 1 THEN -pow(z, 5) / 4 + pow(z, 4) / 2 + 5 * pow(z, 3) / 8 - 5 * z * z / 3 + 1
    ELSE pow(z, 5) / 12 - pow(z, 4) / 2 + 5 * pow(z, 3) / 8 + 5 * z * z / 3 - 5 * z + 4 - 2 / (3 * z) END * inv AS r FROM n WHERE z < 2),
    s AS (SELECT fdate, px, py, 1 / (1 / 1.05 + 2 * sum(y * y * r)) AS p, sum(y * res * r) AS t FROM g GROUP BY 1, 2, 3)
    SELECT gid, q.fdate, k AS ensemble, CASE WHEN p IS NULL THEN CASE WHEN k = 1 THEN a1 ELSE a2 END
    ELSE m + (3 - 2 * k) * x * sqrt(p) + 2 * x * p * t END AS xa FROM q LEFT JOIN s ON q.fdate = s.fdate AND floor(lon / 1.5) = px
    AND floor(lat / 1.5) = py, range(1, 3) AS r(k)""",
)
def local_analysis(spark, d):
    """Transform analysis of two members in patches of 1.5 degrees that see 4 degrees far."""
    rows = _pairs(spark, d)
    out = A.analyse_local(rows.select("gid", "fdate", "lon", "lat", "a"), rows.select("fdate", "lon", "lat", "ha", "d", "e"), 4.0, 1.5)
    return A.unpack_members(out, ["gid", "fdate"])


_YEARLY = """WITH RECURSIVE li AS (SELECT l_suppkey AS gid, make_date(year(l_shipdate), 1, 1) AS fdate, l_orderkey % 2 + 1 AS ensemble,
    (l_linenumber - 1) % 3 + 1 AS layer, l_quantity, l_discount FROM lineitem),
    sim AS (SELECT gid, fdate, layer, ensemble, sum(l_quantity) AS value FROM li GROUP BY 1, 2, 3, 4),
    ob AS (SELECT gid, fdate, sum(l_quantity * l_discount) AS d FROM li GROUP BY 1, 2),
    tot AS (SELECT gid, fdate, ensemble, sum(value) AS v FROM sim GROUP BY 1, 2, 3),
    days AS (SELECT fdate, row_number() OVER (ORDER BY fdate) AS k FROM (SELECT DISTINCT fdate FROM sim)),
    st AS (SELECT k, t.gid, max(CASE WHEN ensemble = 1 THEN v END) AS v1, max(CASE WHEN ensemble = 2 THEN v END) AS v2, any_value(d) AS d
    FROM tot t JOIN days USING (fdate) JOIN ob ON ob.gid = t.gid AND ob.fdate = t.fdate GROUP BY 1, 2 HAVING count(*) = 2),
    rec(k, gid, f1, f2) AS (SELECT 0::BIGINT, gid, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT gid FROM tot) UNION ALL
    SELECT k, gid, CASE WHEN x IS NULL THEN f1 ELSE f1 * (m + x * sqrt(p) + 2 * x * p * t) / b1 END,
    CASE WHEN x IS NULL THEN f2 ELSE f2 * (m - x * sqrt(p) + 2 * x * p * t) / b2 END FROM (
    SELECT *, 1 / (1 / 1.05 + 2 * sum(y * y * inv) OVER ()) AS p, sum(y * res * inv) OVER () AS t FROM (
    SELECT *, 0.1 * x AS y, d - 0.1 * m AS res, 1 / (2 * 0.02 * d * 0.02 * d) AS inv FROM (
    SELECT *, (b1 - b2) / 2 AS x, (b1 + b2) / 2 AS m FROM (
    SELECT rec.k + 1 AS k, rec.gid, f1, f2, f1 * v1 AS b1, f2 * v2 AS b2, d FROM rec LEFT JOIN st ON st.k = rec.k + 1 AND st.gid = rec.gid
    WHERE rec.k < (SELECT max(k) FROM days))))))"""


@query(
    "assimilation_cycle", "gid:i fdate:d layer:i ensemble:i value:f background:f",
    _YEARLY + """ SELECT sim.gid, sim.fdate, layer, ensemble, value * CASE WHEN ensemble = 1 THEN n.f1 ELSE n.f2 END AS value,
    value * CASE WHEN ensemble = 1 THEN b.f1 ELSE b.f2 END AS background FROM sim JOIN days USING (fdate)
    JOIN st ON st.k = days.k AND st.gid = sim.gid JOIN rec n ON n.k = days.k AND n.gid = sim.gid
    JOIN rec b ON b.k = days.k - 1 AND b.gid = sim.gid""", digits=4,
)
def assimilation_cycle(spark, d):
    """Yearly analyses of two members, each from the state that the one before it left."""
    li = I.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("gid"), F.trunc("l_shipdate", "year").alias("fdate"), (F.col("l_orderkey") % 2 + 1).cast("int").alias("ensemble"),
        ((F.col("l_linenumber") - 1) % 3 + 1).alias("layer"), "l_quantity", "l_discount",
    )
    both = li.groupBy("gid", "fdate").agg(F.count_distinct("ensemble").alias("n"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("d"))
    both = both.filter("n = 2").drop("n")
    sim = li.groupBy("gid", "fdate", "layer", "ensemble").agg(F.sum("l_quantity").alias("value")).join(both.select("gid", "fdate"), ["gid", "fdate"])
    sim = cut_lineage(sim.select("gid", "fdate", "layer", "ensemble", "value"))

    def observe(background, day):
        """A tenth of the column is seen, with an error of two per cent."""
        states = A.state_vector(background)
        seen = both.filter(F.col("fdate") == F.lit(day))
        return states.join(seen, ["gid", "fdate"]).select(
            "fdate", F.transform("a", lambda v: v * 0.1).alias("ha"), "d", F.array(F.col("d") * 0.02, F.col("d") * -0.02).alias("e")
        )

    years = [r["fdate"] for r in sim.select("fdate").distinct().collect()]  # one row a year
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cycle-{uuid.uuid4().hex}"
    return flows.assimilation_cycle(sim, observe, years, place)
