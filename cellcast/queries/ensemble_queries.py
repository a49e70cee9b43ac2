"""Ensemble statistics and forecast sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.functions.dates import in_month_range
from cellcast.operators import ensemble as E
from cellcast.operators import terciles as T
from cellcast.operators.common import members
from cellcast.operators.series import nearest_date
from cellcast.queries import inputs as I
from cellcast.queries.inputs import views
from cellcast.queries.registry import query

SEED = 11
KEYS = ["gid", "fdate", "layer"]


def _u(seed: str, keys: str) -> str:
    """SQL of the portable uniform draw."""
    return (
        f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {keys})), 1, 13) AS BIGINT) / 4503599627370496.0)"
    )


def _z(seed: str, keys: str) -> str:
    a, b = _u(f"{seed}a", keys), _u(f"{seed}b", keys)
    return f"(sqrt(-2.0 * ln(1.0 - {a})) * cos(2.0 * pi() * {b}))"


@query(
    "ensemble_std", "gid:i fdate:d layer:i std:f",
    views("member_series") + """ SELECT gid, fdate, layer, stddev_samp(value) AS std FROM member_series
    GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def ensemble_std(spark, d):
    """Spread over members per cell, day and layer."""
    out = E.ensemble_stddev(I.member_series(spark, d), KEYS)
    return out.filter(F.col("std").isNotNull())


@query(
    "ensemble_mean", "gid:i fdate:d layer:i mean:f",
    views("member_series") + " SELECT gid, fdate, layer, avg(value) AS mean FROM member_series GROUP BY 1, 2, 3",
)
def ensemble_mean(spark, d):
    return E.ensemble_mean(I.member_series(spark, d), KEYS)


@query(
    "ensemble_summary", "gid:i fdate:d mean:f std:f n:i",
    views("member_series") + """ SELECT gid, fdate, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std,
    count(*) AS n FROM member_series GROUP BY 1, 2""",
)
def ensemble_summary(spark, d):
    """Mean, spread and size in one pass."""
    out = E.ensemble_summary(I.member_series(spark, d), ["gid", "fdate"])
    return out.withColumn("std", F.coalesce("std", F.lit(0.0)))


@query(
    "ensemble_size", "gid:i size:i",
    views("member_series") + " SELECT gid, max(ensemble) AS size FROM member_series GROUP BY 1",
)
def ensemble_size(spark, d):
    return E.ensemble_size(I.member_series(spark, d), ["gid"])


@query(
    "member_arrays", "gid:i fdate:d layer:i packed:s",
    views("member_series") + """ SELECT gid, fdate, layer,
    string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY ensemble) AS packed FROM member_series GROUP BY 1, 2, 3""",
)
def member_arrays(spark, d):
    """Members of each cell and day as one ordered array."""
    from cellcast.operators.assimilation import member_array

    out = member_array(I.member_series(spark, d), KEYS, "value", "m")
    return out.withColumn("packed", F.array_join(F.transform("m", lambda v: v.cast("long").cast("string")), ","))


_YEARS = """, y AS (SELECT DISTINCT year(fdate) AS year FROM daily WHERE month(fdate) >= 11 OR month(fdate) <= 2)"""


@query("season_years", "year:i", views("daily") + _YEARS + " SELECT year FROM y")
def season_years(spark, d):
    """Years with data in a season that runs over new year."""
    return E.season_years(I.daily(spark, d), 11, 2)


@query(
    "esp_years", "ensemble:i year:i",
    views("daily") + _YEARS + f""", r AS (SELECT year, row_number() OVER (ORDER BY {_u(str(SEED), 'year')}, year) - 1 AS i,
    count(*) OVER () AS n FROM y) SELECT e AS ensemble, year FROM range(1, 21) AS m(e) JOIN r ON (e - 1) % n = i""",
)
def esp_years(spark, d):
    """Twenty members cycle through the shuffled years."""
    return E.esp_years(E.season_years(I.daily(spark, d), 11, 2), 20, SEED, portable=True)


def _forcing(spark, d):
    return I.daily(spark, d).select(
        "gid", "fdate", F.col("rainf").alias("prec"), (F.col("rainf") + 10).alias("tmax"),
        (F.col("rainf") - 5).alias("tmin"), (F.col("runoff") / 1000).alias("wind"),
    )


@query(
    "esp_forcings", "ensemble:i gid:i offset:i prec:f tmax:f",
    views("daily") + f""", y AS (SELECT DISTINCT year(fdate) AS year FROM daily WHERE month(fdate) BETWEEN 4 AND 6),
    r AS (SELECT year, row_number() OVER (ORDER BY {_u(str(SEED), 'year')}, year) - 1 AS i, count(*) OVER () AS n FROM y),
    m AS (SELECT e, year FROM range(1, 11) AS m(e) JOIN r ON (e - 1) % n = i)
    SELECT e AS ensemble, gid, fdate - make_date(year, 4, 15) AS "offset", rainf AS prec, rainf + 10 AS tmax
    FROM m JOIN daily ON fdate BETWEEN make_date(year, 4, 15) AND make_date(year, 4, 15) + 59""",
)
def esp_forcings(spark, d):
    """Sixty days of forcings of each member's year."""
    f = _forcing(spark, d)
    chosen = E.esp_years(E.season_years(f, 4, 6), 10, SEED, portable=True)
    return E.member_forcings(f, chosen, 4, 15, 60)


_THIRDS = """, t AS (SELECT DISTINCT gid % 3 AS gid, fdate FROM daily), s AS (SELECT gid, y AS year, count(*) AS found
    FROM t, range(1990, 2001) AS r(y) WHERE fdate BETWEEN make_date(y, 11, 15) AND make_date(y, 11, 15) + 59 GROUP BY 1, 2)"""


def _thirds(spark, d):
    s = I.daily(spark, d)
    return s.groupBy((F.col("gid") % 3).alias("gid"), "fdate").agg(F.sum("rainf").alias("prec"))


@query(
    "season_gaps", "gid:i year:i found:i missing:i",
    views("daily") + _THIRDS + """ SELECT g.gid, y.year, coalesce(found, 0) AS found, 60 - coalesce(found, 0) AS missing
    FROM (SELECT DISTINCT gid FROM t) g CROSS JOIN (SELECT DISTINCT year FROM s) y LEFT JOIN s ON s.gid = g.gid AND s.year = y.year
    WHERE coalesce(found, 0) < 60""",
)
def season_gaps(spark, d):
    """Seasons of sixty days from November on that lack days, by third of the cells."""
    return E.season_gaps(_thirds(spark, d), 11, 15, 60)


@query(
    "whole_members", "ensemble:i gid:i offset:i prec:f",
    views("daily") + _THIRDS + f""", y AS (SELECT year FROM s WHERE found = 60 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT gid) FROM t)),
    r AS (SELECT year, row_number() OVER (ORDER BY {_u(str(SEED), 'year')}, year) - 1 AS i, count(*) OVER () AS n FROM y),
    m AS (SELECT e, year FROM range(1, 11) AS m(e) JOIN r ON (e - 1) % n = i)
    SELECT e AS ensemble, gid % 3 AS gid, fdate - make_date(year, 11, 15) AS "offset", sum(rainf) AS prec
    FROM m JOIN daily ON fdate BETWEEN make_date(year, 11, 15) AND make_date(year, 11, 15) + 59 GROUP BY 1, 2, 3""",
)
def whole_members(spark, d):
    """Members drawn from the years that have the whole season for every cell: all are equally long."""
    f = _thirds(spark, d)
    chosen = E.esp_years(E.whole_seasons(f, 11, 15, 60), 10, SEED, portable=True)
    return E.member_forcings(f, chosen, 11, 15, 60)


@query(
    "random_init", "ensemble:i year:i from_date:d to_date:d",
    views("daily") + f""", y AS (SELECT DISTINCT year(fdate) AS year FROM daily),
    p AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i, count(*) OVER () AS n FROM y
    WHERE year < (SELECT max(year) FROM y)), m AS (SELECT e, CAST(floor({_u(str(SEED), 'e')} * n) AS BIGINT) AS i
    FROM range(1, 13) AS r(e), (SELECT DISTINCT n FROM p))
    SELECT e AS ensemble, year, make_date(year, 12, 2) AS from_date, make_date(year, 12, 2) + 90 AS to_date
    FROM m JOIN p USING (i)""",
)
def random_init(spark, d):
    """Spin-up windows of 90 days in drawn years, newest year left out."""
    years = I.daily(spark, d).select(F.year("fdate").alias("year")).distinct()
    drawn = E.random_years(years, 12, SEED, portable=True)
    return E.random_windows(drawn, F.lit("2001-03-02").cast("date"), 90)


@query(
    "state_month_draw", "name:i ensemble:i filename:s",
    views("states") + f""" SELECT name, e AS ensemble, arg_min(filename, ({_u(str(SEED), 'name, e, filename')}, filename)) AS filename
    FROM states, range(1, 6) AS r(e) WHERE month(fdate) = 4 GROUP BY 1, 2""",
)
def state_month_draw(spark, d):
    """Saved states of one month drawn with replacement."""
    return E.state_by_month(I.states(spark, d), ["name"], 4, 5, SEED, portable=True)


_REQUESTS = """, q AS (SELECT DISTINCT c_custkey AS name, DATE '1998-01-01' + CAST(c_custkey % 900 AS INTEGER) AS fdate FROM customer),
    k AS (SELECT name, fdate AS d, min(filename) AS filename FROM states GROUP BY 1, 2),
    n AS (SELECT q.name, q.fdate, k.d, k.filename, row_number() OVER (PARTITION BY q.name, q.fdate
    ORDER BY abs(q.fdate - k.d), k.d) AS rn FROM q LEFT JOIN k USING (name))"""


def _requests(spark, d):
    c = I.table(spark, d, "customer")
    day = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int"))
    return c.select(F.col("c_custkey").alias("name"), day.alias("fdate"))


@query(
    "nearest_state", "name:i fdate:d found_fdate:d filename:s",
    views("states") + _REQUESTS + " SELECT name, fdate, d AS found_fdate, filename FROM n WHERE rn = 1 AND d IS NOT NULL",
)
def nearest_state(spark, d):
    """Saved state closest in time to each request."""
    out = nearest_date(_requests(spark, d), I.states(spark, d), ["name"], "filename")
    return out.filter(F.col("found_fdate").isNotNull())


@query(
    "exact_state", "name:i fdate:d filename:s",
    views("states") + """, q AS (SELECT name, min(fdate) AS fdate FROM states GROUP BY 1 UNION
    SELECT c_custkey, DATE '1999-05-05' FROM customer), k AS (SELECT name, fdate, min(filename) AS filename FROM states GROUP BY 1, 2)
    SELECT q.name, q.fdate, coalesce(filename, '') AS filename FROM q LEFT JOIN k USING (name, fdate)""",
)
def exact_state(spark, d):
    """State of exactly the requested date, empty when there is none."""
    s = I.states(spark, d)
    first = s.groupBy("name").agg(F.min("fdate").alias("fdate"))
    extra = I.table(spark, d, "customer").select(
        F.col("c_custkey").alias("name"), F.lit("1999-05-05").cast("date").alias("fdate")
    )
    asked = first.union(extra).distinct()
    known = s.groupBy("name", "fdate").agg(F.min("filename").alias("filename"))
    out = asked.join(known, ["name", "fdate"], "left")
    return out.withColumn("filename", F.coalesce("filename", F.lit("")))


@query(
    "warm_up_choice", "name:i fdate:d filename:s start:d",
    views("states") + _REQUESTS + """ SELECT name, fdate, CASE WHEN d >= fdate - INTERVAL 12 MONTH THEN filename ELSE '' END AS filename,
    CAST(CASE WHEN d IS NULL OR d < fdate - INTERVAL 12 MONTH THEN fdate - INTERVAL 12 MONTH ELSE d END AS DATE) AS start
    FROM n WHERE rn = 1""",
)
def warm_up_choice(spark, d):
    """State and start date of deterministic initialisation."""
    out = E.warm_up_choice(_requests(spark, d), I.states(spark, d), ["name"])
    return out.withColumn("filename", F.coalesce("filename", F.lit("")))


@query(
    "perturbed_forcings", "gid:i fdate:d ensemble:i prec:f tmax:f tmin:f wind:f",
    views("daily") + f""", f AS (SELECT gid, fdate, rainf AS prec, rainf + 10 AS tmax, rainf - 5 AS tmin,
    runoff / 1000 AS wind FROM daily), p AS (SELECT *, {_z(f'{SEED}p', 'gid, fdate, e')} AS zp,
    {_z(f'{SEED}t', 'gid, fdate, e')} AS zt FROM f, range(1, 4) AS r(e)),
    m AS (SELECT *, 0.5 * (tmax + tmin) + 2.0 * zt AS t FROM p)
    SELECT gid, fdate, e AS ensemble, CASE WHEN prec > 0 THEN prec + abs(prec * 0.25) * zp ELSE prec END AS prec,
    2 * t - tmin AS tmax, 2 * t - tmax AS tmin, wind FROM m""", digits=5,
)
def perturbed_forcings(spark, d):
    """Three members of perturbed weather."""
    return E.perturb(_forcing(spark, d), 3, SEED, portable=True)


@query("perturb_spread", "gid:i mean_ratio:f n:i")
def perturb_spread(spark, d):
    """Mean of perturbed over original rain per cell, default generator."""
    base = _forcing(spark, d)
    # A cell and day is one row, so each member carries its original; rows without a key are in no ratio.
    out = E.perturb(base, 5, SEED, original="p0").dropna(subset=["gid", "fdate"])
    return out.groupBy("gid").agg(
        F.avg(F.col("prec") / F.col("p0")).alias("mean_ratio"), F.count("*").alias("n")
    )


_SUMS = """, s AS (SELECT gid, year(fdate) AS yr, sum(rainf) AS psum FROM daily
    WHERE month(fdate) IN (4, 5, 6) GROUP BY 1, 2)"""


@query("season_sums", "gid:i yr:i psum:f", views("daily") + _SUMS + " SELECT * FROM s")
def season_sums(spark, d):
    """Seasonal accumulation per cell and year."""
    return T.season_sums(I.daily(spark, d), [4, 5, 6], ["gid"], "rainf")


_CDF = _SUMS + """, c AS (SELECT count(DISTINCT yr) AS n FROM s),
    r AS (SELECT gid, yr, psum, n, row_number() OVER (PARTITION BY gid ORDER BY psum, yr) AS rid FROM s, c),
    g AS (SELECT *, rid // (n // 3 + 1) + 1 AS pg FROM r),
    w AS (SELECT g.gid, yr, psum, 1.0 / (n / 3.0) * prob / 100.0 AS weight FROM g JOIN terciles t ON t.gid = g.gid
    AND leadtime = 1 AND ['below', 'normal', 'above'][pg] = tercile),
    v AS (SELECT gid, yr, psum, weight / sum(weight) OVER (PARTITION BY gid) AS weight FROM w),
    q AS (SELECT *, CASE WHEN lead(yr) OVER o IS NULL THEN 1.0 ELSE sum(weight) OVER o END AS w1 FROM v
    WINDOW o AS (PARTITION BY gid ORDER BY psum, yr)),
    f AS (SELECT *, coalesce(lag(w1) OVER (PARTITION BY gid ORDER BY psum, yr), 0) AS w2 FROM q)"""


@query("year_strata", "gid:i yr:i rid:i pg:i",
       views("daily", "terciles") + _CDF + " SELECT gid, yr, rid, pg FROM g")
def year_strata(spark, d):
    """Rank of each year and its tercile group."""
    sums = T.season_sums(I.daily(spark, d), [4, 5, 6], ["gid"], "rainf")
    n = sums.agg(F.count_distinct("yr")).scalar()
    return T.strata(T.rank_years(sums, ["gid"]), n)


@query("year_cdf", "gid:i yr:i psum:f w1:f w2:f",
       views("daily", "terciles") + _CDF + " SELECT gid, yr, psum, w1, w2 FROM f")
def year_cdf(spark, d):
    """Cumulative tercile weights of the climatology years."""
    climate = I.daily(spark, d).withColumnRenamed("rainf", "value")
    return T.resampling_cdf(climate, I.terciles(spark, d), [4, 5, 6], ["gid"])


@query(
    "year_cdf_raw", "gid:i yr:i w1:f",
    views("daily", "terciles") + _CDF + " SELECT gid, yr, sum(weight) OVER (PARTITION BY gid ORDER BY psum) AS w1 FROM w",
)
def year_cdf_raw(spark, d):
    """The same without rescaling the unequal strata."""
    climate = I.daily(spark, d).withColumnRenamed("rainf", "value")
    return T.resampling_cdf(climate, I.terciles(spark, d), [4, 5, 6], ["gid"], normalise=False)


_DRAWS = _CDF + f""", e AS (SELECT e, {_u(str(SEED), 'e')} AS s FROM range(1, 16) AS r(e)),
    h AS (SELECT gid, e, yr FROM f, e WHERE s >= w2 AND s < w1)"""


@query("tercile_years", "gid:i ens:i yr:i",
       views("daily", "terciles") + _DRAWS + " SELECT gid, e AS ens, yr FROM h")
def tercile_years(spark, d):
    """One climatology year per cell and member by inverse CDF."""
    climate = I.daily(spark, d).withColumnRenamed("rainf", "value")
    return T.resample(climate, I.terciles(spark, d), [4, 5, 6], 15, SEED, ["gid"], portable=True)


@query(
    "tercile_forcings", "gid:i ens:i yr:i fdate:d rainf:f",
    views("daily", "terciles") + _DRAWS + """ SELECT h.gid, e AS ens, yr, fdate, rainf FROM h JOIN daily ON daily.gid = h.gid
    AND fdate BETWEEN make_date(yr, 4, 1) AND make_date(yr, 4, 1) + 89""",
)
def tercile_forcings(spark, d):
    """Daily forcings of the drawn years."""
    base = I.daily(spark, d)
    climate = base.withColumn("cell", F.col("gid")).withColumnRenamed("rainf", "value")
    probs = I.terciles(spark, d).withColumnRenamed("gid", "cell")
    drawn = T.resample(climate, probs, [4, 5, 6], 15, SEED, ["cell"], portable=True)
    mapping = base.select("gid").distinct().withColumn("cell", F.col("gid"))
    return T.drawn_forcings(base, mapping, drawn, 4, 1, 89, ["cell"])


@query(
    "coarse_climatology", "row:i col:i fdate:d value:f",
    views("grid_daily") + """ SELECT CAST(floor((90 - lat) / 2.5 + 1e-9) AS BIGINT) AS row,
    CAST(floor((lon + 180) / 2.5 + 1e-9) AS BIGINT) AS col, fdate, avg(value) AS value FROM grid_daily GROUP BY 1, 2, 3""",
)
def coarse_climatology(spark, d):
    """Daily climatology averaged on the 2.5 degree forecast grid."""
    from cellcast.operators.grid import regrid_average

    return regrid_average(I.grid_daily(spark, d), 2.5, ["fdate"])


@query(
    "rebuilt_temperature", "gid:i fdate:d ensemble:i tmax:f tmin:f wind:f",
    views("daily") + f""", y AS (SELECT DISTINCT year(fdate) AS year FROM daily), i AS (SELECT year FROM y
    WHERE (SELECT count(*) FROM y) <= 2 OR (year > (SELECT min(year) FROM y) AND year < (SELECT max(year) FROM y))),
    p AS (SELECT arg_min(year, ({_u(str(SEED), 'year')}, year)) AS yr FROM i),
    a AS (SELECT gid, fdate - DATE '2001-02-01' AS o, fdate, rainf AS temp FROM daily
    WHERE fdate BETWEEN DATE '2001-02-01' AND DATE '2001-05-31'),
    h AS (SELECT gid, fdate - make_date(yr, 2, 1) AS o, rainf + 10 AS tmax, rainf - 5 AS tmin, runoff / 1000 AS wind
    FROM daily, p WHERE year(fdate) = yr AND fdate >= make_date(yr, 2, 1))
    SELECT a.gid, a.fdate, e AS ensemble, temp + e + 0.5 * (tmax - tmin) AS tmax, temp + e - 0.5 * (tmax - tmin) AS tmin,
    wind FROM a LEFT JOIN h USING (gid, o), range(1, 4) AS r(e)""",
)
def rebuilt_temperature(spark, d):
    """Extremes from forecast means and the range of a past year."""
    history = _forcing(spark, d)
    ahead = I.daily(spark, d).filter("fdate between date'2001-02-01' and date'2001-05-31'")
    ahead = members(ahead.select("gid", "fdate", "rainf"), 3)
    forecast = ahead.select("gid", "fdate", "ensemble", (F.col("rainf") + F.col("ensemble")).alias("temp"))
    years = E.interior_years(history.select(F.year("fdate").alias("year")).distinct())
    year = E.pick_year(years, SEED, portable=True)
    return E.rebuild_temperature(forecast, history, year, F.lit("2001-02-01").cast("date"))


@query(
    "multi_source", "ensemble:i dataset:s n:i total:f",
    """WITH s AS (SELECT ['chirps', 'trmm', 'gpm'][l_orderkey % 3 + 1] AS dataset, l_quantity AS v FROM lineitem),
    m AS (SELECT e, ['chirps', 'trmm', 'gpm'][(e - 1) % 3 + 1] AS dataset FROM range(1, 8) AS r(e))
    SELECT e AS ensemble, dataset, count(*) AS n, sum(v) AS total FROM m JOIN s USING (dataset) GROUP BY 1, 2""",
)
def multi_source(spark, d):
    """Seven members over three precipitation sources."""
    names = F.array(F.lit("chirps"), F.lit("trmm"), F.lit("gpm"))
    li = I.table(spark, d, "lineitem")
    per_set = li.groupBy(F.get(names, (F.col("l_orderkey") % 3).cast("int")).alias("dataset")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("total")
    )
    return E.multi_source_ensemble(per_set, ["chirps", "trmm", "gpm"], 7)


@query(
    "season_rows", "gid:i n:i",
    views("daily") + " SELECT gid, count(*) AS n FROM daily WHERE month(fdate) >= 11 OR month(fdate) <= 2 GROUP BY 1",
)
def season_rows(spark, d):
    """Rows in a month range that wraps over new year."""
    s = I.daily(spark, d).filter(in_month_range(F.col("fdate"), 11, 2))
    return s.groupBy("gid").agg(F.count("*").alias("n"))
