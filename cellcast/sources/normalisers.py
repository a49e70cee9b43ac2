"""Product normalisers: landed raw rows to standard daily cells.

Raw rows are (fdate or ts, lat, lon, raw, ...). Each function returns
(var, dataset, fdate, lat, lon, value) plus the product's own keys, with missing data as
NULL. ``NORMALISERS`` maps a product name to its function; users add their own entries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import date, timedelta
from string import Formatter
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions import dates as D
from cellcast.functions import scalars as S
from cellcast.operators import grid
from cellcast.operators.common import read_existing

BBox = tuple[float, float, float, float]
NORMALISERS: dict[str, Callable[..., DataFrame]] = {}


def normaliser(name: str):
    """Register a product function under its name."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        NORMALISERS[name] = fn
        return fn

    return add


def normalise(product: str, raw: DataFrame, bbox: BBox | None = None, **options) -> DataFrame:
    return NORMALISERS[product](raw, bbox=bbox, **options)


def _emit(
    df: DataFrame, var: str, dataset: str, value: Column, extra: Sequence[str] = ()
) -> DataFrame:
    return df.select(
        F.lit(var).alias("var"),
        F.lit(dataset).alias("dataset"),
        "fdate",
        "lat",
        "lon",
        value.alias("value"),
        *extra,
    )


def _scaled(var: str, dataset: str, res: float, convert: Callable[[Column], Column]):
    """Daily product that needs only a subset and a point-wise conversion."""

    def run(raw: DataFrame, bbox: BBox | None = None) -> DataFrame:
        return _emit(grid.subset_bbox(raw, res, bbox), var, dataset, convert(F.col("raw")))

    return run


_same = lambda v: v
NORMALISERS["chirps"] = _scaled("precip", "chirps", 0.05, _same)
NORMALISERS["cmorph"] = _scaled("precip", "cmorph", 0.25, S.per_hour_to_per_day)
NORMALISERS["persiann"] = _scaled("precip", "persiann", 0.25, S.per_hour_to_per_day)
NORMALISERS["rfe2"] = _scaled("precip", "rfe2", 0.10, _same)
NORMALISERS["trmm"] = _scaled("precip", "trmm", 0.25, _same)


@normaliser("gpm")
def gpm(raw: DataFrame, bbox: BBox | None = None, scale: float = 0.1) -> DataFrame:
    """29999 is missing; stored in tenths. Pass ``scale=2.4`` to read rates per hour."""
    value = F.when(F.col("raw") != 29999, F.col("raw") * scale)
    return _emit(grid.subset_bbox(raw, 0.10, bbox), "precip", "gpm", value)


# File-name variable and the variable it is stored as.
PRISM_VARIABLES = {"ppt": "precip", "tmax": "tmax", "tmin": "tmin"}


@normaliser("prism")
def prism(
    raw: DataFrame,
    bbox: BBox | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Date and variable come from the file name (``..._<var>_..._yyyymmdd_bil.*``)."""
    name = F.element_at(F.split("path", "/"), -1)
    code = F.regexp_extract(name, r"(ppt|tmax|tmin)", 1)
    var = F.lit(None).cast("string")
    for short, long in PRISM_VARIABLES.items():
        var = F.when(code == short, F.lit(long)).otherwise(var)
    dated = raw.withColumn("fdate", D.date_in_text(name, r"_(\d{8})_")).withColumn("var", var)
    kept = grid.subset_bbox(grid.between(dated, start, end), 0.04, bbox)
    return kept.filter(F.col("var").isNotNull() & F.col("fdate").isNotNull()).select(
        "var", F.lit("prism").alias("dataset"), "fdate", "lat", "lon", F.col("raw").alias("value")
    )


@normaliser("ncep")
def ncep(raw: DataFrame, bbox: BBox | None = None) -> DataFrame:
    """Rows (field, fdate, lat, lon, raw) with field tmax, tmin, u or v.

    The two wind parts meet in one aggregation per cell and day; no self-join.
    """
    sub = grid.subset_bbox(raw, 1.875, bbox)
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("raw")))
    wide = sub.groupBy("fdate", "lat", "lon").agg(
        S.kelvin_to_celsius(pick("tmax")).alias("tmax"),
        S.kelvin_to_celsius(pick("tmin")).alias("tmin"),
        S.wind_speed(pick("u"), pick("v")).alias("wind"),
    )
    return _unpivot(wide, "ncep", ("tmax", "tmin", "wind"))


def _unpivot(wide: DataFrame, dataset: str, names: Sequence[str]) -> DataFrame:
    tall = wide.unpivot(["fdate", "lat", "lon"], list(names), "var", "value")
    return tall.filter(F.col("value").isNotNull()).select(
        "var", F.lit(dataset).alias("dataset"), "fdate", "lat", "lon", "value"
    )


@normaliser("merra")
def merra(raw: DataFrame, bbox: BBox | None = None) -> DataFrame:
    """Hourly rows (ts, lat, lon, t2m, u10m, v10m) to daily extremes and mean wind."""
    sub = grid.subset_bbox(raw, 0.5, bbox)
    wide = sub.groupBy(F.to_date("ts").alias("fdate"), "lat", "lon").agg(
        S.kelvin_to_celsius(F.max("t2m")).alias("tmax"),
        S.kelvin_to_celsius(F.min("t2m")).alias("tmin"),
        F.avg(S.wind_speed(F.col("u10m"), F.col("v10m"))).alias("wind"),
    )
    return _unpivot(wide, "merra", ("tmax", "tmin", "wind"))


@normaliser("amsre")
def amsre(raw: DataFrame, bbox: BBox | None = None) -> DataFrame:
    """Rows (orbit, fdate, lat, lon, raw): the descending pass overlays the ascending one,
    then values of magnitude 9999 are missing and the rest are thousandths."""
    pick = lambda o: F.max(F.when(F.col("orbit") == o, F.col("raw")))
    merged = grid.subset_bbox(raw, 0.25, bbox).groupBy("fdate", "lat", "lon").agg(
        F.coalesce(pick("D"), pick("A")).alias("raw")
    )
    value = F.when(F.abs("raw") != 9999, F.col("raw") / 1000.0)
    return _emit(merged, "soilmoist", "amsre", value)


# Fixed value: first day of the SMOS product.
SMOS_START = date(2010, 1, 12)


def smos_window(start: date, end: date, days_available: int) -> tuple[date, date]:
    """Requested days cut to what the product holds."""
    last = SMOS_START + timedelta(days=days_available - 1)
    return max(start, SMOS_START), min(end, last)


@normaliser("smos")
def smos(raw: DataFrame, bbox: BBox | None = None, res: float = 0.25) -> DataFrame:
    """Rows (day_index, lat, lon, raw), moved to a regular grid by nearest neighbour.

    The target axes start at the corner rounded to a tenth of a degree.
    """
    sub = grid.subset_bbox(raw, res, bbox).filter(F.col("day_index") >= 0)
    start = F.lit(SMOS_START.isoformat()).cast("date")
    cells = sub.select(
        F.date_add(start, F.col("day_index").cast("int")).alias("fdate"),
        "lat", "lon", F.col("raw").alias("value"),
    )
    ends = cells.agg(
        F.round(F.max("lat"), 1).alias("a"), F.round(F.min("lat"), 1).alias("b"),
        F.round(F.min("lon"), 1).alias("c"), F.round(F.max("lon"), 1).alias("d"),
    )

    def axis(low: str, high: str, start_from: str, sign: int, name: str) -> DataFrame:
        steps = F.round((F.col(high) - F.col(low)) / res).cast("int")
        k = F.explode(F.sequence(F.lit(0), steps)).alias("k")
        return ends.select(start_from, k).select(
            F.round(F.col(start_from) + sign * F.col("k") * res, 6).alias(name)
        )

    moved = grid.regrid_rectilinear(
        cells, axis("b", "a", "a", -1, "lat"), axis("c", "d", "c", 1, "lon")
    )
    return _emit(moved, "soilmoist", "smos", F.col("value"))


@normaliser("smap")
def smap(raw: DataFrame, bbox: BBox | None = None, enhanced: bool = False) -> DataFrame:
    """0.36 degree product, or the 0.09 degree one when ``enhanced``; longitudes wrap."""
    res, name = (0.09, "smape") if enhanced else (0.36, "smap")
    sub = grid.subset_bbox(grid.wrap_longitude(raw), res, bbox)
    return _emit(sub, "soilmoist", name, F.col("raw"))


@normaliser("smape")
def smape(raw: DataFrame, bbox: BBox | None = None) -> DataFrame:
    return smap(raw, bbox, enhanced=True)


@normaliser("grace")
def grace(raw: DataFrame, bbox: BBox | None = None, scaling: DataFrame | None = None) -> DataFrame:
    """Multiply by the static scaling grid (lat, lon, factor), matched by cell index."""
    place = lambda df: grid.with_index(df, 90.0, -180.0, 1.0)
    factors = place(scaling).select("row", "col", "factor")
    sub = place(grid.subset_bbox(raw, 1.0, bbox))
    joined = sub.join(factors, ["row", "col"])
    return _emit(joined, "tws", "grace", F.col("raw") * F.col("factor"))


def _mosaic(
    raw: DataFrame, res: float, bbox: BBox | None, valid_below: float, scale: float
) -> DataFrame:
    """Overlay tiles (the highest ``tile_order`` wins), then mask and scale."""
    sub = grid.subset_bbox(raw, res, bbox)
    merged = grid.union_latest(sub, ["fdate", "lat", "lon"], "tile_order", "raw")
    value = F.when(F.col("raw") < valid_below, F.col("raw") * scale)
    return merged.select("fdate", "lat", "lon", value.alias("value"))


@normaliser("mcd15")
def mcd15(raw: DataFrame, bbox: BBox | None = None, res: float = 0.005) -> DataFrame:
    """Leaf area: valid below 101, tenths, averaged on the target grid."""
    merged = _mosaic(raw, 0.005, bbox, 101, 0.1)
    gridded = grid.regrid_average(merged, res, ["fdate"])
    return _emit(gridded, "lai", "modis", F.col("value"))


@normaliser("mod10")
def mod10(raw: DataFrame, bbox: BBox | None = None) -> DataFrame:
    return _emit(_mosaic(raw, 0.005, bbox, 101, 1.0), "snow", "mod10", F.col("value"))


@normaliser("modscag")
def modscag(raw: DataFrame, bbox: BBox | None = None) -> DataFrame:
    return _emit(_mosaic(raw, 0.01, bbox, 101, 1.0), "snow", "modscag", F.col("value"))


@normaliser("mod16")
def mod16(raw: DataFrame, bbox: BBox | None = None) -> DataFrame:
    return _emit(_mosaic(raw, 0.01, bbox, 32701, 0.1), "evap", "mod16", F.col("value"))


@normaliser("iri")
def iri(raw: DataFrame, bbox: BBox | None = None, var: str = "precip") -> DataFrame:
    """Rows (months, lat, lon, prob) where prob[lead][tercile] is a nested array of
    3 leads by (below, normal, above)."""
    sub = grid.subset_bbox(grid.wrap_longitude(raw), 2.5, bbox)
    leads = sub.select(
        D.months_since_1960(F.col("months")).alias("fdate"), "lat", "lon",
        F.posexplode("prob").alias("_lead", "_probs"),
    )
    tall = leads.select(
        "fdate", "lat", "lon", (F.col("_lead") + 1).alias("leadtime"),
        F.posexplode("_probs").alias("_t", "prob"),
    )
    names = F.array(F.lit("below"), F.lit("normal"), F.lit("above"))
    return tall.select(
        F.lit(var).alias("var"), F.lit("iri").alias("dataset"), "fdate", "lat", "lon",
        "leadtime", F.get(names, F.col("_t")).alias("tercile"), "prob",
    )


@normaliser("nmme")
def nmme(raw: DataFrame, bbox: BBox | None = None) -> DataFrame:
    """Rows (path, variable, ensemble, lat, lon, raw); date from the end of the file name,
    temperatures from kelvin."""
    day = D.date_in_text(F.col("path"), r"(\d{8})\.tif$")
    sub = grid.subset_bbox(raw, 0.5, bbox).withColumn("fdate", day)
    hot = F.col("variable") == "Temperature"
    return sub.select(
        F.when(hot, "tmax").otherwise("precip").alias("var"),
        F.lit("nmme").alias("dataset"),
        "fdate", "lat", "lon",
        F.when(hot, S.kelvin_to_celsius(F.col("raw"))).otherwise(F.col("raw")).alias("value"),
        "ensemble",
    )


def user_dataset(
    spark: SparkSession,
    options: dict[str, str],
    start: date,
    end: date,
    bbox: BBox | None = None,
) -> DataFrame | None:
    """Dataset described by ``path``, ``res`` and ``table`` ('var.dataset').

    ``path`` is a pattern with {0} year, {1} month and {2} day, each with a format such as {1:02d} or without. It becomes one
    glob over the years, months and days of the window, and a row's date is that of its path. A pattern without all
    three leaves the date to the rows' own ``fdate``. None when an option is missing or no path matches.
    """
    if any(k not in options for k in ("path", "res", "table")):
        return None
    var, dataset = options["table"].split(".")
    glob, pattern, fields = path_glob(options["path"], start, end)
    raw = read_existing(spark, glob, ignoreMissingFiles="true", recursiveFileLookup="true")
    if raw is None:
        return None
    if len(fields) == 3:
        part = lambda f: F.regexp_extract("_metadata.file_path", pattern, fields[f])
        raw = raw.withColumn("fdate", F.concat_ws("-", part(0), part(1), part(2)).try_cast("date"))
    sub = grid.subset_bbox(raw.filter(F.col("fdate").between(start, end)), float(options["res"]), bbox)
    return _emit(sub, var, dataset, F.col("raw"))


def path_glob(path: str, start: date, end: date) -> tuple[str, str, dict[int, int]]:
    """A glob for a path pattern in a window of dates, a regular expression for its paths, and the group of each field."""
    days = [start + timedelta(days=k) for k in range((end - start).days + 1)]
    values = [sorted({d.year for d in days}), sorted({d.month for d in days}), sorted({d.day for d in days})]
    glob, pattern, fields, groups = "", "", {}, 0
    for literal, field, spec, _ in Formatter().parse(path):
        glob += re.sub(r"([*?\[\]{}\\])", r"\\\1", literal)
        # Paths are matched from the folder of the first field on, written as in an address.
        known = quote(literal, safe="/=:@!$&'()*+,;~-._")
        pattern += re.escape(known if pattern else known[known.rfind("/"):] if "/" in known else known)
        if field is not None:
            texts = [format(v, spec) for v in values[int(field)]]
            glob += "{" + ",".join(texts) + "}"
            pattern += "(" + "|".join(sorted(texts, key=len, reverse=True)) + ")"
            groups += 1
            fields.setdefault(int(field), groups)
    return glob, pattern + "(?:/|$)", fields
