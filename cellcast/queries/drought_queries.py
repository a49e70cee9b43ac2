"""Drought indices and series operators on supplier-day series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cellcast.functions import gamma, scalars
from cellcast.functions.dates import dekad_start
from cellcast.operators import drought, series as S
from cellcast.operators.grid import between, mask_by_first_date
from cellcast.queries import inputs as I
from cellcast.queries.inputs import views
from cellcast.queries.registry import query

START, END = "1996-01-01", "2000-12-31"
CELL = ["gid"]

_SEVERITY = """, s AS (SELECT gid, fdate, avg(v) OVER (PARTITION BY gid ORDER BY fdate
    RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND CURRENT ROW) AS m FROM t),
    r AS (SELECT gid, fdate, rank() OVER (PARTITION BY gid ORDER BY m) - 1 AS lo,
    count(*) OVER (PARTITION BY gid, m) AS ties, count(*) OVER (PARTITION BY gid) AS n FROM s)
    SELECT gid, fdate, 100.0 - (lo + lo + ties + 1) * 50.0 / n AS value FROM r"""


@query(
    "severity_soil", "gid:i fdate:d value:f",
    views("layered") + ", t AS (SELECT gid, fdate, sum(soil_moist) AS v FROM layered GROUP BY 1, 2)"
    + _SEVERITY,
)
def severity_soil(spark, d):
    """Severity of layer-summed soil moisture per cell and day."""
    # The layer sum folds into the aggregation that builds the series.
    return drought.severity(I.layer_total(spark, d), "soil_moist")


@query(
    "severity_runoff_period", "gid:i fdate:d value:f",
    views("daily") + ", t AS (SELECT gid, fdate, runoff AS v FROM daily)" + _SEVERITY
    + f" WHERE fdate BETWEEN DATE '{START}' AND DATE '{END}'",
)
def severity_runoff_period(spark, d):
    """Severity of runoff: ranks over all dates, output on the period only."""
    return drought.severity(I.daily(spark, d), "runoff", START, END)


_DRY = """, b AS (SELECT gid, fdate, rainf AS v, {threshold} OVER (PARTITION BY gid) AS t,
    row_number() OVER (PARTITION BY gid ORDER BY fdate) AS rn,
    min(rainf) OVER (PARTITION BY gid ORDER BY fdate ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)
    AS lowest FROM daily),
    w AS (SELECT *, lowest > t AND rn >= {r} AS wet FROM b),
    i AS (SELECT *, sum(CASE WHEN wet THEN 1 ELSE 0 END) OVER (PARTITION BY gid ORDER BY fdate)
    AS island FROM w),
    c AS (SELECT *, sum(CASE WHEN NOT wet AND rn >= {r} THEN 1 ELSE 0 END)
    OVER (PARTITION BY gid, island ORDER BY fdate) AS days FROM i)
    SELECT gid, fdate, sum(CASE WHEN days = {n} AND NOT wet AND rn >= {r} THEN 1 ELSE 0 END)
    OVER (PARTITION BY gid ORDER BY fdate) AS value FROM c"""


@query("dry_spells", "gid:i fdate:d value:f",
       views("daily") + _DRY.format(threshold="avg(rainf)", back=1, r=2, n=14))
def dry_spells(spark, d):
    """Running number of 14-day dry spells, recovery after two wet days."""
    return drought.dry_spells(I.daily(spark, d))


@query("dry_spells_median", "gid:i fdate:d value:f",
       views("daily") + _DRY.format(threshold="median(rainf)", back=2, r=3, n=5))
def dry_spells_median(spark, d):
    """Dry spells with the median as threshold, other durations."""
    return drought.dry_spells(I.daily(spark, d), duration=5, recovery=3, threshold=F.median)


_SMDI = """, c AS (SELECT gid, fdate, soil_moist AS v,
    median(soil_moist) OVER (PARTITION BY gid) AS mid, max(soil_moist) OVER (PARTITION BY gid) AS top
    FROM layered WHERE layer = 2),
    p AS (SELECT gid, fdate, mid, top, median(v) OVER (PARTITION BY gid ORDER BY fdate
    RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS sw,
    row_number() OVER (PARTITION BY gid ORDER BY fdate) AS rn
    FROM c WHERE fdate BETWEEN DATE '{a}' AND DATE '{b}'),
    q AS (SELECT gid, fdate, rn, (sw - mid) / nullif(top - mid, 0) * 100.0 / 50.0 AS sd FROM p)"""


@query(
    "smdi_vector", "gid:i fdate:d value:f",
    views("layered") + _SMDI.format(a=START, b=END) + """,
    o AS (SELECT gid, fdate, CASE WHEN rn <= 7 THEN lead(sd, 7) OVER w
    WHEN rn = 8 THEN sd + 0.5 * lead(sd, 6) OVER w ELSE sd END AS r
    FROM q WINDOW w AS (PARTITION BY gid ORDER BY fdate))
    SELECT gid, fdate, greatest(-4.0, least(4.0, r)) AS value FROM o WHERE r IS NOT NULL""",
)
def smdi_vector(spark, d):
    """Soil moisture deficit index, one-shot form."""
    out = drought.smdi(I.layered(spark, d), start=START, end=END)
    return out.filter(F.col("value").isNotNull())


@query(
    "smdi_recursive", "gid:i fdate:d value:f",
    views("layered") + _SMDI.format(a=START, b=END) + """,
    x AS (SELECT gid, fdate, rn, CASE WHEN rn <= 7 THEN lead(sd, 7) OVER w ELSE sd END AS x
    FROM q WINDOW w AS (PARTITION BY gid ORDER BY fdate)),
    f AS (SELECT gid, fdate, rn, x AS r FROM x WHERE rn <= 7
    UNION ALL SELECT x.gid, x.fdate, x.rn, x.x + 0.5 * f.r FROM f JOIN x
    ON x.gid = f.gid AND x.rn = f.rn + 1 WHERE x.rn > 7 AND f.rn >= 7)
    SELECT gid, fdate, greatest(-4.0, least(4.0, r)) AS value FROM f WHERE r IS NOT NULL""",
)
def smdi_recursive(spark, d):
    """Soil moisture deficit index with a true half-weight recursion."""
    out = drought.smdi(I.layered(spark, d), start=START, end=END, mode="recursive")
    return out.filter(F.col("value").isNotNull())


_ROLL = """, m AS (SELECT gid, fdate, {v} AS v,
    avg({v}) OVER w AS mean, count({v}) OVER w AS n,
    row_number() OVER (PARTITION BY gid ORDER BY fdate) AS rn FROM daily
    WINDOW w AS (PARTITION BY gid ORDER BY fdate ROWS BETWEEN {back} PRECEDING AND CURRENT ROW))"""


@query(
    "rolling_month_mean", "gid:i fdate:d value:f",
    views("daily") + _ROLL.format(v="rainf", back=29)
    + " SELECT gid, fdate, mean AS value FROM m WHERE n = 30",
)
def rolling_month_mean(spark, d):
    """Mean of 30 rows, present once the window is full."""
    out = S.add_rolling_rows_mean(I.daily(spark, d), CELL, 30, "rainf", "value")
    return out.filter(F.col("value").isNotNull())


@query(
    "rolling_week_median", "gid:i fdate:d value:f",
    views("daily") + """ SELECT gid, fdate, median(rainf) OVER (PARTITION BY gid ORDER BY fdate
    RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS value FROM daily""",
)
def rolling_week_median(spark, d):
    out = I.daily(spark, d)
    return out.withColumn("value", S.rolling_days_median(F.col("rainf"), CELL, 7))


@query(
    "rolling_dekad_mean", "gid:i fdate:d value:f",
    views("daily") + """ SELECT gid, fdate, avg(rainf) OVER (PARTITION BY gid ORDER BY fdate
    RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND CURRENT ROW) AS value FROM daily""",
)
def rolling_dekad_mean(spark, d):
    out = I.daily(spark, d)
    return out.withColumn("value", S.rolling_days_mean(F.col("rainf"), CELL, 10))


_THOM = """, x AS (SELECT gid, avg(mean) AS a, avg(ln(mean)) AS l, count(*) AS n FROM m
    WHERE n = {rows} AND rn > {rows} AND mean > 0 GROUP BY gid),
    y AS (SELECT gid, n, a, ln(a) - l AS g FROM x),
    z AS (SELECT gid, n, a, (1 + sqrt(1 + 4 * g / 3)) / (4 * g) AS shape FROM y WHERE g > 1e-12)
    SELECT gid, n, shape, a / shape AS scale FROM z"""


@query(
    "spi_gamma_parameters", "gid:i n:i shape:f scale:f",
    views("daily") + _ROLL.format(v="rainf", back=89) + _THOM.format(rows=90), digits=4,
)
def spi_gamma_parameters(spark, d):
    """Closed-form gamma parameters of the three-month precipitation means."""
    means = S.add_rolling_rows_mean(I.daily(spark, d), CELL, 90, "rainf", "pm")
    means = means.withColumn("rn", F.row_number().over(S.by_date(CELL))).filter("rn > 90")
    return drought.thom_parameters(means).filter(F.col("shape").isNotNull())


@query("spi3", "gid:i fdate:d value:f method:s")
def spi3(spark, d):
    """Three-month precipitation index, maximum-likelihood fit."""
    out = drought.spi(I.daily(spark, d), 3)
    return out.filter(F.col("value").isNotNull())


def _polynomial(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for k in coefficients[1:]:
        out = f"({out} * {x} + {k!r})"
    return out


_MID_R = "((p - 0.5) * (p - 0.5))"
_LOW_T, _HIGH_T = "sqrt(-2 * ln(p))", "sqrt(-2 * ln(1 - p))"
_QUANTILE = f"""CASE WHEN p <= 0 THEN -9 WHEN p >= 1 THEN 9
    WHEN p < 0.02425 THEN {_polynomial(gamma._TAIL_TOP, _LOW_T)} / {_polynomial(gamma._TAIL_BOTTOM, _LOW_T)}
    WHEN p > 0.97575 THEN -{_polynomial(gamma._TAIL_TOP, _HIGH_T)} / {_polynomial(gamma._TAIL_BOTTOM, _HIGH_T)}
    ELSE {_polynomial(gamma._MIDDLE_TOP, _MID_R)} * (p - 0.5) / {_polynomial(gamma._MIDDLE_BOTTOM, _MID_R)} END"""

# The distribution function in SQL is the plain power series, summed as exponentials.
_CLOSED = """, u AS (SELECT gid, fdate, mean FROM m WHERE n = {rows} AND rn > {rows}),
    x AS (SELECT gid, avg(mean) AS a, avg(ln(mean)) AS l FROM u WHERE mean > 0 GROUP BY gid),
    y AS (SELECT gid, a, ln(a) - l AS g FROM x),
    z AS (SELECT gid, a, (1 + sqrt(1 + 4 * g / 3)) / (4 * g) AS shape FROM y WHERE g > 1e-12),
    c AS (SELECT u.gid, fdate, shape, mean / (a / shape) AS q FROM u JOIN z USING (gid)),
    p AS (SELECT gid, fdate, least(1.0, list_sum(list_transform(range(0, 600),
    lambda k: exp((shape + k) * ln(q) - q - lgamma(shape + k + 1))))) AS p FROM c),
    spi AS (SELECT gid, fdate, greatest(-3.09, least(3.09, {quantile})) AS value FROM p)"""


@query(
    "spi1_closed_form", "gid:i fdate:d value:f method:s",
    views("daily") + _ROLL.format(v="rainf", back=29) + _CLOSED.format(rows=30, quantile=_QUANTILE)
    + " SELECT gid, fdate, value, 'thom' AS method FROM spi", digits=5,
)
def spi1_closed_form(spark, d):
    """One-month precipitation index, closed-form fit as native aggregates."""
    out = drought.spi(I.daily(spark, d), 1, fit="thom")
    return out.filter(F.col("value").isNotNull())


@query("sri6", "gid:i fdate:d value:f method:s")
def sri6(spark, d):
    """Six-month runoff index inside a period."""
    out = drought.sri(
        I.daily(spark, d), 6, start=date(1995, 1, 1), end=date(2001, 12, 31), fit="mle"
    )
    return out.filter(F.col("value").isNotNull())


_DEKAD = """date_add(date_trunc('month', {0})::DATE,
    CAST(least((day({0}) - 1) // 10, 2) * 10 AS INTEGER))"""


@query(
    "dekad_mean", "gid:i dekad:d value:f",
    views("daily") + f" SELECT gid, CAST({_DEKAD.format('fdate')} AS DATE) AS dekad, avg(rainf) AS value "
    "FROM daily GROUP BY 1, 2",
)
def dekad_mean(spark, d):
    """Mean of each ten-day period per cell."""
    return S.dekad_mean(I.daily(spark, d), CELL, "rainf").withColumnRenamed("rainf", "value")


_SCORE = """, {p}k AS (SELECT gid, CAST(""" + _DEKAD.format("fdate") + """ AS DATE) AS dekad,
    avg(v) AS v FROM {p}t GROUP BY 1, 2),
    {p}h AS (SELECT gid, dekad, {head} AS v FROM {p}k{join}),
    {p}z AS (SELECT gid, dekad, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z
    FROM {p}h WINDOW w AS (PARTITION BY gid)),
    {p}j AS (SELECT t.gid, t.fdate, s.z FROM {p}t AS t LEFT JOIN {p}z AS s ON s.gid = t.gid AND s.dekad = t.fdate
    WHERE t.fdate BETWEEN DATE '{a}' AND DATE '{b}'),
    {p}f AS (SELECT gid, fdate, last_value(z IGNORE NULLS) OVER (PARTITION BY gid ORDER BY fdate
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {p}j)"""


@query(
    "fapar_score", "gid:i fdate:d value:f",
    views("daily") + ", t AS (SELECT gid, fdate, runoff AS v FROM daily)"
    + _SCORE.format(p="", head="v", join="", a=START, b=END)
    + " SELECT * FROM f WHERE value IS NOT NULL",
)
def fapar_score(spark, d):
    """Standardised dekad radiation carried on daily dates."""
    out = drought.fapar_score(I.daily(spark, d), "runoff", START, END)
    return out.filter(F.col("value").isNotNull())


def soils(spark, d):
    """(gid, ksat, depth_mm) read by position from a soil line built for each supplier.

    Positions 13-14 (from one) hold conductivities, 23-24 layer depths.
    """
    s = I.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    tokens = [F.lit("1")] * 12
    ksat = [(k % 7 * 90 + 20).cast("string"), (k % 5 * 300 + 10).cast("string")]
    between_ = [F.lit("0.5")] * 8
    depth = [F.lit("0.25"), F.lit("0.75")]
    line = F.concat_ws(" ", *tokens, *ksat, *between_, *depth)
    parsed = scalars.soil_line_fields(line)
    return s.select(k.alias("gid"), parsed["ksat"].alias("ksat"), parsed["depth_mm"].alias("depth_mm"))


_SOILS = """, soil AS (SELECT s_suppkey AS gid,
    ((s_suppkey % 7) * 90 + 20 + (s_suppkey % 5) * 300 + 10) / 2.0 AS ksat, 1000.0 AS depth_mm
    FROM supplier),
    classes AS (SELECT """ + ", ".join(f"unnest({list(v)})::DOUBLE AS {n}" for n, v in (
        ("ks", scalars.SOIL_KSAT_CM_PER_HOUR), ("n", scalars.SOIL_POROSITY), ("psi", scalars.SOIL_AIR_ENTRY), ("b", scalars.SOIL_EXPONENT),
    )) + """,
    unnest(range(0, 11)) AS id),
    classed AS (SELECT gid, depth_mm, n, psi, b, id FROM (SELECT s.*, c.*, row_number() OVER
    (PARTITION BY s.gid ORDER BY abs(c.ks * 240.0 - s.ksat), c.id) AS rn FROM soil s, classes c)
    WHERE rn = 1)"""


@query("soil_class", "gid:i class_id:i ksat:f",
       "WITH x AS (SELECT 1)" + _SOILS + " SELECT classed.gid, id AS class_id, ksat FROM classed JOIN soil USING (gid)")
def soil_class(spark, d):
    """Texture class by nearest conductivity from parsed soil lines."""
    s = soils(spark, d).withColumn("_c", scalars.soil_class(F.col("ksat")))
    return s.select("gid", F.col("_c.class_id").alias("class_id"), "ksat")


@query(
    "suction_score", "gid:i fdate:d value:f",
    views("layered") + ", t AS (SELECT gid, fdate, sum(soil_moist) AS v FROM layered WHERE layer < 3 GROUP BY 1, 2)"
    + _SOILS
    + _SCORE.format(
        p="", head="ln(psi * pow((v / depth_mm) / n, -b))", join=" JOIN classed USING (gid)", a=START, b=END
    )
    + " SELECT * FROM f WHERE value IS NOT NULL",
)
def suction_score(spark, d):
    """Standardised soil suction of the two upper layers."""
    out = drought.suction_score(I.layered(spark, d), soils(spark, d), start=START, end=END)
    return out.filter(F.col("value").isNotNull())


@query("combined_index", "gid:i fdate:d value:i")
def combined_index(spark, d):
    """Combined drought category from precipitation, suction and vegetation scores."""
    base = I.daily(spark, d)
    return drought.combined_index(
        drought.spi(base, 3),
        drought.suction_score(I.layered(spark, d), soils(spark, d)),
        drought.fapar_score(base, "runoff"),
    )


_ALWAYS = {"a": "1900-01-01", "b": "2100-01-01"}


_COMBINED = (
    views("daily", "layered") + _ROLL.format(v="rainf", back=89) + _CLOSED.format(rows=90, quantile=_QUANTILE)
    + ", st AS (SELECT gid, fdate, sum(soil_moist) AS v FROM layered WHERE layer < 3 GROUP BY 1, 2)" + _SOILS
    + _SCORE.format(p="s", head="ln(psi * pow((v / depth_mm) / n, -b))", join=" JOIN classed USING (gid)", **_ALWAYS)
    + ", qt AS (SELECT gid, fdate, runoff AS v FROM daily)"
    + _SCORE.format(p="q", head="v", join="", **_ALWAYS)
    + """ SELECT gid, fdate, CASE WHEN spi.value < -1 AND qf.value < -1 AND sf.value > 1 THEN 4
    WHEN spi.value < -1 AND qf.value < -1 THEN 3 WHEN spi.value < -1 AND qf.value > 1 THEN 2
    WHEN spi.value < -1 THEN 1 ELSE 0 END AS value
    FROM daily JOIN sf USING (gid, fdate) JOIN qf USING (gid, fdate) LEFT JOIN spi USING (gid, fdate)"""
)


@query("combined_index_closed_form", "gid:i fdate:d value:i", _COMBINED)
def combined_index_closed_form(spark, d):
    """Combined drought category with the closed-form precipitation fit."""
    base = I.daily(spark, d)
    return drought.combined_index(
        drought.spi(base, 3, fit="thom"),
        drought.suction_score(I.layered(spark, d), soils(spark, d)),
        drought.fapar_score(base, "runoff"),
    )


@query(
    "combined_level", "gid:i fdate:d value:i",
    views("daily") + """, s AS (SELECT gid, fdate,
    (rainf - avg(rainf) OVER w) / nullif(stddev_samp(rainf) OVER w, 0) AS spi,
    (runoff - avg(runoff) OVER w) / nullif(stddev_samp(runoff) OVER w, 0) AS sma
    FROM daily WINDOW w AS (PARTITION BY gid))
    SELECT gid, fdate, CASE WHEN spi < -1 AND 2 * spi + sma < -1 AND -sma > 0.5 * 1 + 0.5 THEN 4
    WHEN spi < -1 AND 2 * spi + sma < -1 THEN 3 WHEN spi < -1 AND 2 * spi + sma > 1 THEN 2
    WHEN spi < -1 THEN 1 ELSE 0 END AS value FROM s""",
)
def combined_level(spark, d):
    """Category rule alone, on scores that SQL can compute too."""
    base = I.daily(spark, d)
    s = base.select(
        "gid", "fdate", S.standardise(F.col("rainf"), CELL).alias("spi"),
        S.standardise(F.col("runoff"), CELL).alias("sma"),
    )
    level = drought.combined_level(F.col("spi"), -F.col("sma"), 2 * F.col("spi") + F.col("sma"))
    return s.withColumn("value", level)


def _closed_index(value: str, months: int) -> str:
    rows = 30 * months
    return views("daily") + _ROLL.format(v=value, back=rows - 1) + _CLOSED.format(rows=rows, quantile=_QUANTILE) + " SELECT gid, fdate, value FROM spi"


_ALL_INDICES = {
    "spi1": _closed_index("rainf", 1), "spi3": _closed_index("rainf", 3), "sri3": _closed_index("runoff", 3),
    "severity": views("daily") + ", t AS (SELECT gid, fdate, rainf AS v FROM daily)" + _SEVERITY,
    "dryspells": views("daily") + _DRY.format(threshold="avg(rainf)", back=1, r=2, n=14),
    "smdi": views("layered") + _SMDI.format(**_ALWAYS) + """, o AS (SELECT gid, fdate, CASE WHEN rn <= 7 THEN lead(sd, 7) OVER w
    WHEN rn = 8 THEN sd + 0.5 * lead(sd, 6) OVER w ELSE sd END AS r FROM q WINDOW w AS (PARTITION BY gid ORDER BY fdate))
    SELECT gid, fdate, greatest(-4.0, least(4.0, r)) AS value FROM o WHERE r IS NOT NULL""",
    "cdi": _COMBINED,
}


@query(
    "all_indices", "gid:i fdate:d index:s value:f", " UNION ALL ".join(
        f"""SELECT gid, fdate, '{name}' AS "index", CAST(value AS DOUBLE) AS value FROM ({sql}) AS part""" for name, sql in _ALL_INDICES.items()
    ), digits=5,
)
def all_indices(spark, d):
    """Every index in one tall table from shared inputs."""
    layers = I.layered(spark, d)
    base = I.daily(spark, d)
    series = base.withColumns({"soil_moist": F.col("rainf"), "par": F.col("runoff")})
    names = ["spi1", "spi3", "sri3", "severity", "dryspells", "smdi", "cdi"]
    out = drought.run_indices(
        names, series, layers, soils(spark, d), series, fit="thom", materialise=True
    )
    return out.filter(F.col("value").isNotNull())


@query(
    "standardise", "gid:i fdate:d value:f",
    views("daily") + """ SELECT gid, fdate, (rainf - avg(rainf) OVER w) /
    nullif(stddev_samp(rainf) OVER w, 0) AS value FROM daily WINDOW w AS (PARTITION BY gid)""",
)
def standardise(spark, d):
    return I.daily(spark, d).withColumn("value", S.standardise(F.col("rainf"), CELL))


@query(
    "climatology_stats", "gid:i mean:f median:f top:f low:f spread:f",
    views("daily") + """ SELECT gid, avg(rainf) AS mean, median(rainf) AS median, max(rainf) AS top,
    min(rainf) AS low, stddev_samp(rainf) AS spread FROM daily GROUP BY gid""",
)
def climatology_stats(spark, d):
    return I.daily(spark, d).groupBy("gid").agg(
        F.avg("rainf").alias("mean"), F.median("rainf").alias("median"),
        F.max("rainf").alias("top"), F.min("rainf").alias("low"),
        F.stddev_samp("rainf").alias("spread"),
    )


@query(
    "percentile_of_score", "gid:i fdate:d value:f",
    views("daily") + """ SELECT gid, fdate, (2 * (rank() OVER (PARTITION BY gid ORDER BY rainf) - 1)
    + count(*) OVER (PARTITION BY gid, rainf) + 1) * 50.0 / count(*) OVER (PARTITION BY gid) AS value
    FROM daily""",
)
def percentile_of_score(spark, d):
    return S.percentile_of_score(I.daily(spark, d), CELL, "rainf", "value")


@query(
    "forward_fill", "gid:i fdate:d value:f",
    views("daily") + """, g AS (SELECT gid, fdate, CASE WHEN rainf > 40 THEN rainf END AS v FROM daily),
    f AS (SELECT gid, fdate, last_value(v IGNORE NULLS) OVER (PARTITION BY gid ORDER BY fdate
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM g)
    SELECT * FROM f WHERE value IS NOT NULL""",
)
def forward_fill(spark, d):
    """Carry the last high value forward."""
    gaps = I.daily(spark, d).withColumn("v", F.when(F.col("rainf") > 40, F.col("rainf")))
    out = gaps.withColumn("value", S.forward_fill(F.col("v"), CELL))
    return out.filter(F.col("value").isNotNull())


@query(
    "gap_filled_years", "gid:i fdate:d value:f",
    views("daily") + """, span AS (SELECT gid, min(fdate) AS a, max(fdate) AS b FROM daily GROUP BY gid),
    days AS (SELECT gid, CAST(unnest(generate_series(make_date(year(a), 1, 1)::TIMESTAMP,
    make_date(year(b), 12, 31)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS fdate FROM span)
    SELECT days.gid, days.fdate, coalesce(rainf, -9999.0) AS value
    FROM days LEFT JOIN daily USING (gid, fdate)""",
)
def gap_filled_years(spark, d):
    """Whole calendar years with -9999 on days without a value."""
    one = I.daily(spark, d).select("gid", "fdate", F.col("rainf").alias("value"))
    return S.gap_fill_years(one, CELL, -9999.0)


@query(
    "mask_by_first_date", "row:i col:i n:i",
    views("grid_daily") + """, alive AS (SELECT DISTINCT row, col FROM grid_daily
    WHERE fdate = (SELECT min(fdate) FROM grid_daily))
    SELECT g.row, g.col, count(*) AS n FROM grid_daily g SEMI JOIN alive USING (row, col) GROUP BY 1, 2""",
)
def mask_first_date(spark, d):
    """Days per cell, for the cells that have data on the first date of the table."""
    kept = mask_by_first_date(I.grid_daily(spark, d), ["row", "col"])
    return kept.groupBy("row", "col").agg(F.count("*").alias("n"))


@query(
    "thinned_dates", "status:s fdate:d",
    """WITH RECURSIVE o AS (SELECT DISTINCT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS fdate
    FROM orders), k AS (SELECT status, min(fdate) AS fdate FROM o GROUP BY status
    UNION ALL SELECT * FROM (SELECT k.status, (SELECT min(o.fdate) FROM o WHERE o.status = k.status
    AND o.fdate >= k.fdate + 7) AS fdate FROM k) WHERE fdate IS NOT NULL)
    SELECT status, fdate FROM k""",
)
def thinned_dates(spark, d):
    """Weekly thinning of observation dates per product."""
    o = I.table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("fdate")
    )
    return S.thin_dates(o, ["status"], 7)


@query(
    "cumulative_events", "gid:i fdate:d value:i",
    views("daily") + """ SELECT gid, fdate, sum(CASE WHEN rainf > 45 THEN 1 ELSE 0 END)
    OVER (PARTITION BY gid ORDER BY fdate) AS value FROM daily""",
)
def cumulative_events(spark, d):
    event = F.when(F.col("rainf") > 45, 1).otherwise(0)
    return I.daily(spark, d).withColumn("value", S.cumulative(event, CELL))


@query(
    "clipped_index", "gid:i fdate:d value:f",
    views("daily") + """ SELECT gid, fdate, greatest(-3.09, least(3.09, (rainf - 25) / 7.0)) AS value
    FROM daily WHERE fdate BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
)
def clipped_index(spark, d):
    """Date range filter and the index bounds."""
    rows = between(I.daily(spark, d), START, END)
    return rows.withColumn("value", scalars.clip_index((F.col("rainf") - 25) / 7.0))


@query(
    "dekad_calendar", "fdate:d dekad:d n:i",
    views("daily") + f" SELECT fdate, CAST({_DEKAD.format('fdate')} AS DATE) AS dekad, count(*) AS n "
    "FROM daily GROUP BY 1, 2",
)
def dekad_calendar(spark, d):
    rows = I.daily(spark, d).groupBy("fdate").agg(F.count("*").alias("n"))
    return rows.withColumn("dekad", dekad_start(F.col("fdate")))
