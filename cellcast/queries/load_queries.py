"""Incremental loads, upserts and completeness."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from cellcast.operators import grid, loads, series as S
from cellcast.queries import inputs as I
from cellcast.queries.inputs import LEFT, RES, TOP, views
from cellcast.queries.registry import query
from cellcast.session import ensure_checkpoint_dir
from cellcast.sources import normalisers


@query(
    "load_windows", "gid:i start:d end:d",
    views("daily") + """ SELECT gid, max(fdate) + 1 AS start, DATE '2001-10-31' AS "end" FROM daily
    GROUP BY gid HAVING max(fdate) < DATE '2001-10-31'""",
)
def load_windows(spark, d):
    """Next load window per dataset from the newest stored date."""
    return loads.load_windows(I.daily(spark, d), "2001-10-31", ["gid"])


@query(
    "resolved_windows", "gid:i start:s end:s status:s",
    views("daily") + """, w AS (SELECT gid, max(fdate) + 1 AS s, DATE '2001-10-31' AS e FROM daily
    GROUP BY gid HAVING max(fdate) < DATE '2001-10-31'),
    r AS (SELECT s_suppkey AS gid, CASE WHEN s_suppkey % 3 = 0 THEN DATE '2000-05-01' END AS cs,
    CASE WHEN s_suppkey % 6 = 0 THEN DATE '2000-06-30' END AS ce FROM supplier)
    SELECT gid, coalesce(CAST(coalesce(cs, s) AS VARCHAR), '-') AS start,
    coalesce(CAST(coalesce(ce, e) AS VARCHAR), '-') AS "end",
    CASE WHEN coalesce(cs, s) IS NOT NULL AND coalesce(ce, e) IS NOT NULL THEN 'load' ELSE 'skip' END AS status
    FROM r LEFT JOIN w USING (gid)""",
)
def resolved_windows(spark, d):
    """Configured dates override the computed window; the rest is skipped."""
    k = F.col("s_suppkey")
    asked = I.table(spark, d, "supplier").select(
        k.alias("gid"),
        F.when(k % 3 == 0, F.lit("2000-05-01").cast("date")).alias("start"),
        F.when(k % 6 == 0, F.lit("2000-06-30").cast("date")).alias("end"),
    )
    windows = loads.load_windows(I.daily(spark, d), "2001-10-31", ["gid"])
    out = loads.resolve_windows(asked, windows, ["gid"])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return out.select("gid", text("start"), text("end"), "status")


@query(
    "replace_dates", "gid:i fdate:d rainf:f",
    views("daily") + """, n AS (SELECT gid, fdate, rainf * 2 AS rainf FROM daily WHERE fdate >= DATE '2001-01-01')
    SELECT gid, fdate, rainf FROM daily WHERE fdate NOT IN (SELECT fdate FROM n) UNION ALL SELECT * FROM n""",
)
def replace_dates(spark, d):
    """A second delivery replaces whole dates."""
    old = I.daily(spark, d).select("gid", "fdate", "rainf")
    new = old.filter("fdate >= date'2001-01-01'").withColumn("rainf", F.col("rainf") * 2)
    return loads.upsert(old, new, ["fdate"])


@query(
    "keyed_upsert", "gid:i leadtime:i tercile:s prob:f",
    views("terciles") + """, n AS (SELECT gid, leadtime, tercile, prob + 1 AS prob FROM terciles WHERE leadtime = 2)
    SELECT * FROM terciles t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.gid = t.gid AND n.leadtime = t.leadtime
    AND n.tercile = t.tercile) UNION ALL SELECT * FROM n""",
)
def keyed_upsert(spark, d):
    """Upsert of forecast probabilities by cell, lead and tercile."""
    old = I.terciles(spark, d)
    new = old.filter("leadtime = 2").withColumn("prob", F.col("prob") + 1)
    return loads.upsert(old, new, ["gid", "leadtime", "tercile"])


@query(
    "range_overwrite", "gid:i ensemble:i fdate:d gwad:f n:i",
    views("growth") + """, g AS (SELECT gid, ensemble, fdate, max(gwad) AS gwad, count(*) AS n FROM growth GROUP BY 1, 2, 3)
    SELECT * FROM g WHERE NOT (fdate BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')
    UNION ALL SELECT gid, ensemble, fdate, gwad + 5, n FROM g WHERE fdate BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
)
def range_overwrite(spark, d):
    """Rows of a date range give way to the new run's rows."""
    old = I.growth(spark, d).groupBy("gid", "ensemble", "fdate").agg(
        F.max("gwad").alias("gwad"), F.count("*").alias("n")
    )
    new = grid.between(old, "1998-01-01", "1998-12-31").withColumn("gwad", F.col("gwad") + 5)
    return loads.drop_range(old, "1998-01-01", "1998-12-31").unionByName(new)


@query(
    "fill_stamps", "gid:i ensemble:i crop:s n:i",
    """SELECT l_suppkey AS gid, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 7 END AS ensemble, 'maize' AS crop,
    count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def fill_stamps(spark, d):
    """Stamp columns where they are missing."""
    li = I.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("gid"), F.when(F.col("l_orderkey") % 2 == 0, 1).alias("ensemble")
    )
    out = loads.fill_stamp(li, ensemble=7, crop="maize")
    return out.groupBy("gid", "ensemble", "crop").agg(F.count("*").alias("n"))


@query(
    "simulation_output", "gid:i fdate:d ensemble:i rid:i value:f",
    views("daily") + """ SELECT gid, fdate, 3 AS ensemble, (gid + 8) % 8 + 1 AS rid, rainf AS value FROM daily
    WHERE fdate >= DATE '1995-06-01' + 90""",
)
def simulation_output(spark, d):
    """Warm-up days dropped, member stamped, tile numbers wrapped."""
    raw = I.daily(spark, d).select("gid", "fdate", F.col("gid").alias("rid"), F.col("rainf").alias("value"))
    return loads.simulation_output(raw, F.lit("1995-06-01").cast("date"), 90, 3, 8)


@query(
    "state_catalog_upsert", "name:i filename:s fdate:d",
    views("states") + """, o AS (SELECT name, fdate, max(filename) AS filename FROM states GROUP BY 1, 2),
    n AS (SELECT name, fdate, filename || '.new' AS filename FROM o WHERE fdate >= DATE '2000-01-01')
    SELECT * FROM o WHERE fdate < DATE '2000-01-01' UNION ALL SELECT * FROM n""",
)
def state_catalog_upsert(spark, d):
    """Saved states: last delivery per date, then replaced by a newer run."""
    old = loads.latest_per_key(I.states(spark, d), ["name", "fdate"], "filename")
    new = old.filter("fdate >= date'2000-01-01'").withColumn(
        "filename", F.concat("filename", F.lit(".new"))
    )
    return loads.upsert(old, new, ["name", "fdate"])


@query(
    "completeness", "var:s found:i expected:i complete:i",
    views("daily") + """, c AS (SELECT count(DISTINCT gid) AS n FROM daily),
    f AS (SELECT count(rainf) AS rainf, count(runoff) AS runoff FROM daily)
    SELECT 'rainf' AS var, rainf AS found, n * 2557 AS expected, CASE WHEN rainf = n * 2557 THEN 1 ELSE 0 END AS complete FROM f, c
    UNION ALL SELECT 'runoff', runoff, n * 2557, CASE WHEN runoff = n * 2557 THEN 1 ELSE 0 END FROM f, c""",
)
def completeness(spark, d):
    """Rows found and expected per forcing variable."""
    s = I.daily(spark, d)
    cells = s.agg(F.count_distinct("gid")).scalar()
    return loads.completeness(s, cells, 2557, ["rainf", "runoff"])


@query(
    "missing_days", "gid:i fdate:d",
    views("daily") + """, w AS (SELECT gid, CAST(day AS DATE) AS fdate FROM (SELECT DISTINCT gid FROM daily),
    generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) AS s(day))
    SELECT gid, fdate FROM w ANTI JOIN daily USING (gid, fdate)""",
)
def missing_days(spark, d):
    """Days without a row per cell."""
    a, b = F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date")
    return loads.missing_days(I.daily(spark, d), ["gid"], a, b)


@query(
    "forecast_complete", "gid:i found:i expected:i complete:i",
    views("daily") + """ SELECT gid, count(DISTINCT fdate) AS found, 365 AS expected,
    CASE WHEN count(DISTINCT fdate) = 365 THEN 1 ELSE 0 END AS complete FROM daily
    WHERE fdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY gid""",
)
def forecast_complete(spark, d):
    """Distinct dates found in a forecast window."""
    return loads.forecast_complete(I.daily(spark, d), "1997-01-01", "1997-12-31", ["gid"])


@query(
    "filled_calendar", "gid:i fdate:d value:f",
    views("daily") + """, w AS (SELECT gid, CAST(day AS DATE) AS fdate FROM (SELECT DISTINCT gid FROM daily),
    generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '1999-12-31', INTERVAL 1 DAY) AS s(day))
    SELECT gid, fdate, coalesce(rainf, -9999.0) AS value FROM w LEFT JOIN daily USING (gid, fdate)""",
)
def filled_calendar(spark, d):
    """One year per cell with -9999 on missing days."""
    one = I.daily(spark, d).select("gid", "fdate", F.col("rainf").alias("value"))
    a, b = F.lit("1999-01-01").cast("date"), F.lit("1999-12-31").cast("date")
    return S.gap_fill(one, ["gid"], a, b, -9999.0)


@query(
    "forcing_table", "gid:i fdate:d prec:f tmax:f tmin:f wind:f",
    views("basin", "grid_daily") + f""", i AS (SELECT gid, CAST(floor(({TOP} - lat) / 0.25 + 0.5 + 1e-9) AS BIGINT) AS row,
    CAST(floor((lon - {LEFT}) / 0.25 + 0.5 + 1e-9) AS BIGINT) AS col FROM basin)
    SELECT gid, fdate, value AS prec, value + 1 AS tmax, value + 2 AS tmin, value + 3 AS wind
    FROM grid_daily JOIN i USING (row, col) WHERE fdate BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
)
def forcing_table(spark, d):
    """Wide forcings of basin cells from tall variables."""
    from cellcast.plans.flows import forcings

    g = I.grid_daily(spark, d).select("row", "col", "fdate", "value")
    pairs = [F.struct(F.lit(v).alias("var"), (F.col("value") + k).alias("value"))
             for k, v in enumerate(("precip", "tmax", "tmin", "wind"))]
    cells = g.withColumn("_p", F.explode(F.array(*pairs))).select("row", "col", "fdate", "_p.*")
    index = grid.index_table(I.basin(spark, d), TOP, LEFT, RES)
    return forcings(cells, index, "1996-01-01", "2000-12-31")


def _shared(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("member_rewrite", "gid:i ensemble:i fdate:d rainf:f", views("daily") + " SELECT gid, 7 AS ensemble, fdate, rainf FROM daily")
def member_rewrite(spark, d):
    """A stored table without a member column is replaced by one that has it."""
    root = _shared(spark, "member-rewrite")
    loads.publish(I.daily(spark, d).select("gid", "fdate", "rainf"), root, ())
    loads.add_member_column(spark, root, 7, ())
    return loads.current(spark, root)


@query(
    "path_pattern", "lat:f lon:f fdate:d value:f dataset:s",
    views("grid_daily") + """ SELECT lat, lon, fdate, value, 'landed' AS dataset FROM grid_daily
    WHERE fdate BETWEEN DATE '1996-11-15' AND DATE '1998-02-10'""",
)
def path_pattern(spark, d):
    """Daily folders of the whole table, read back for a window by one glob; dates come from the paths."""
    root = _shared(spark, "landed")
    of = lambda part: getattr(F, part)("fdate").alias(part)
    days = I.grid_daily(spark, d).select("lat", "lon", F.col("value").alias("raw"), of("year"), of("month"), of("day"), "fdate")
    # A fixed count: small days would else be merged into one task that writes them all.
    dealt = days.drop("fdate").repartition(spark.sparkContext.defaultParallelism, "year", "month", "day")
    dealt.write.partitionBy("year", "month", "day").parquet(root)
    options = {"path": root + "/year={0}/month={1}/day={2}", "res": str(RES), "table": "precip.landed"}
    return normalisers.user_dataset(spark, options, date(1996, 11, 15), date(1998, 2, 10))
