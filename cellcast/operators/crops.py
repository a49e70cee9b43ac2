"""Crop inputs, growth outputs and yield statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions import scalars
from cellcast.functions.dates import doy_to_date, fixed_year
from cellcast.operators import spatial
from cellcast.operators.common import members
from cellcast.operators.ensemble import cycle_variants, draw_rows
from cellcast.operators.series import gap_fill_years

WEATHER = ("net_short", "net_long", "rainf", "tmax", "tmin")

# Fertiliser amounts by days after planting.
FERTILISER = [(0, 60.0), (30, 70.0), (45, 80.0)]
FERTILISER_MATERIAL = {"maize": "001", "rice": "014"}
# Rice irrigation as (days after the simulation start, operation, amount).
RICE_IRRIGATION = [
    (0, "IR010", 0.0), (0, "IR008", 2.0), (0, "IR009", 20.0), (0, "IR011", 5.0),
    (6, "IR009", 100.0), (6, "IR011", 30.0), (10, "IR009", 150.0), (10, "IR011", 50.0),
]
# Genetic coefficients of each crop, in file order.
CULTIVAR_PARAMETERS = {
    "maize": ["p1", "p2", "p5", "g2", "g3", "phint"],
    "rice": ["p1", "p2r", "p5", "p2o", "g1", "g2", "g3", "g4"],
}


def pivot_weather(zonal: DataFrame, keys: Sequence[str], net_sign: int = -1) -> DataFrame:
    """One row per area and day from tall (var, value) rows; radiation is the net of the two.

    ``net_sign`` -1 subtracts the long-wave part, +1 adds it. The variable list is fixed, so
    the pivot needs no extra pass to find its columns.
    """
    picked = lambda v: F.avg(F.when(F.col("var") == v, F.col("value"))).alias(v)
    wide = zonal.filter(F.col("var").isin(list(WEATHER))).groupBy(*keys).agg(
        *[picked(v) for v in WEATHER]
    )
    return wide.withColumn("radiation", F.col("net_short") + net_sign * F.col("net_long"))


def weather_table(weather: DataFrame, count: int, ensemble: str | None = None, crop: str = "maize") -> DataFrame:
    """Daily crop weather for every member: radiation in MJ, rain, extremes, mean temperature.

    When fewer weather members exist than crop members, they are used in turn.
    """
    if crop == "rice":
        weather = weather.withColumn("fdate", fixed_year(F.col("fdate")))
    if ensemble is None:
        out = members(weather, count, "member")
    else:
        sized = weather.withColumn("_n", F.max(ensemble).over(Window.partitionBy("area", "fdate")))
        turns = F.sequence(F.col(ensemble), F.lit(count), F.col("_n"))
        out = sized.filter(F.col(ensemble) <= count).withColumn("member", F.explode(turns))
    return out.select(
        "area",
        "member",
        "fdate",
        scalars.watts_to_megajoules(F.col("radiation")).alias("srad"),
        "tmax",
        "tmin",
        F.col("rainf").alias("rain"),
    )


def weather_means(table: DataFrame) -> DataFrame:
    """Mean of all daily extremes per area and member."""
    return table.groupBy("area", "member").agg(
        ((F.avg("tmax") + F.avg("tmin")) / 2.0).alias("tavg")
    )


def leaf_area(zonal: DataFrame, scaled: bool = True) -> DataFrame:
    """Leaf-area series per area over whole years; -9999 where nothing was seen.

    Satellite values are stored times ten (``scaled``); model values are member means.
    """
    value = F.col("value") / 10.0 if scaled else F.col("value")
    daily = zonal.groupBy("area", "fdate").agg(F.avg(value).alias("value"))
    return gap_fill_years(daily, ["area"], -9999.0)


def planting_dates(samples: DataFrame, crop: str, start: str, end: str) -> DataFrame:
    """Planting dates per area inside the simulation period, in order.

    ``samples`` carries (area, type, doy). An area with none inside gets its latest date
    before the start.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    dates = samples.filter((F.col("type") == crop) & F.col("doy").isNotNull()).select(
        "area", doy_to_date(F.year(a), F.col("doy")).alias("pdate")
    ).distinct()
    whole = Window.partitionBy("area")
    inside = F.col("pdate").between(a, b)
    dates = dates.withColumn("_any", F.max(inside).over(whole)).withColumn(
        "_last", F.max(F.when(F.col("pdate") < a, F.col("pdate"))).over(whole)
    )
    kept = dates.filter(inside | (~F.col("_any") & (F.col("pdate") == F.col("_last"))))
    order = whole.orderBy("pdate")
    return kept.select("area", "pdate", F.row_number().over(order).alias("season"))


def interpolate_layers(
    moisture: Column, depths: Column, bottoms: Column, compat: bool = False
) -> Column:
    """Volume fractions at the midpoints of new layers.

    ``moisture`` (mm) and ``depths`` (m) are arrays per model layer, ``bottoms`` the lower
    edges of the profile layers in cm. Linear between model midpoints, constant outside.
    Layers without a value are left out; the result is NULL only where no layer has one.
    Model midpoints add up all layers above; ``compat`` uses only the layer just above.
    """
    fraction = F.zip_with(moisture, depths, lambda m, d: m / F.nullif(1000.0 * d, F.lit(0.0)))

    def middle(d: Column, i: Column) -> Column:
        above = F.aggregate(F.slice(depths, F.lit(1), i), F.lit(0.0), lambda acc, x: acc + x)
        if compat:
            above = F.when(i > 0, F.get(depths, i - 1)).otherwise(F.lit(0.0))
        return 100.0 * (above + d / 2.0)

    points = F.arrays_zip(
        F.transform(depths, middle).alias("z"), fraction.alias("u")
    )
    points = F.filter(points, lambda p: p["u"].isNotNull())
    upper = lambda i: F.when(i > 0, F.get(bottoms, i - 1)).otherwise(F.lit(0.0))

    def value_at(bottom: Column, i: Column) -> Column:
        at = upper(i) + (bottom - upper(i)) / 2.0
        low = F.try_element_at(F.filter(points, lambda p: p["z"] <= at), F.lit(-1))
        high = F.get(F.filter(points, lambda p: p["z"] > at), 0)
        slope = (high["u"] - low["u"]) / F.nullif(high["z"] - low["z"], F.lit(0.0))
        return (
            F.when(low.isNull(), F.get(points, 0)["u"])
            .when(high.isNull(), F.try_element_at(points, F.lit(-1))["u"])
            .otherwise(low["u"] + slope * (at - low["z"]))
        )

    return F.transform(bottoms, value_at)


def moisture_table(daily: DataFrame, layers: int, cell: Sequence[str] = ("area",)) -> DataFrame:
    """Every day of each year with its day of year; layers without data are -9999."""
    span = daily.select(*cell, F.year("fdate").alias("_y")).distinct()
    first = F.make_date(F.col("_y"), F.lit(1), F.lit(1))
    last = F.make_date(F.col("_y"), F.lit(12), F.lit(31))
    days = span.withColumn("fdate", F.explode(F.sequence(first, last))).drop("_y")
    out = days.join(daily, [*cell, "fdate"], "left")
    filler = F.array_repeat(F.lit(-9999.0), layers)
    return out.select(
        *cell,
        "fdate",
        F.dayofyear("fdate").alias("doy"),
        F.coalesce("layers", filler).alias("layers"),
    )


def cropland_areas(
    cover: DataFrame, membership: DataFrame, threshold: float = 0.1
) -> DataFrame:
    """Mean crop fraction per area, kept when it reaches the threshold."""
    means = spatial.zonal_mean(cover, membership, keys=())
    return means.filter(F.col("value") >= threshold)


def attach_geometry(growth: DataFrame, areas: DataFrame) -> DataFrame:
    """Geometry text by area id; growth rows of unknown areas keep NULL."""
    return growth.join(areas.select(F.col("area").alias("gid"), "wkt"), "gid", "left")


def season_best(growth: DataFrame, keys: Sequence[str] = ("gid", "ensemble")) -> DataFrame:
    """Highest grain weight per area and member with its date (latest on a tie).

    An aggregate, not a window: partial maxima travel instead of whole groups.
    """
    best = growth.groupBy(*keys).agg(F.max(F.struct("gwad", "fdate")).alias("_b"))
    return best.select(*keys, F.col("_b.gwad").alias("gwad"), F.col("_b.fdate").alias("fdate"))


def yield_table(growth: DataFrame, crop: str, keep_min: bool = False) -> DataFrame:
    """Maximum, mean and spread over members of the season's best, per area."""
    return _yield_stats(season_best(growth), crop, keep_min)


def _yield_stats(best: DataFrame, crop: str, keep_min: bool) -> DataFrame:
    stats = [
        F.max("gwad").alias("max_yield"),
        F.avg("gwad").alias("avg_yield"),
        F.coalesce(F.stddev_samp("gwad"), F.lit(0.0)).alias("std_yield"),
        F.max("fdate").alias("fdate"),
    ]
    if keep_min:
        stats.append(F.min("gwad").alias("min_yield"))
    return best.groupBy("gid").agg(*stats).withColumn("crop", F.lit(crop))


def yield_export(
    growth: DataFrame, crop: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Yield statistics of the bests that fall in a date range (filtered after the best is
    chosen), with the true minimum next to the spread."""
    best = season_best(growth)
    if start:
        best = best.filter(F.col("fdate") >= F.lit(start).cast("date"))
    if end:
        best = best.filter(F.col("fdate") <= F.lit(end).cast("date"))
    return _yield_stats(best, crop, keep_min=True)


def zonal_wide(zonal: DataFrame, areas: Sequence[int]) -> DataFrame:
    """One row per date, one column per area (p1, p2, ... in the order given)."""
    column = lambda k, a: F.avg(F.when(F.col("area") == a, F.col("value"))).alias(f"p{k}")
    return zonal.groupBy("fdate").agg(*[column(k, a) for k, a in enumerate(areas, 1)])


def schedules(plantings: DataFrame, crop: str = "maize") -> DataFrame:
    """Default fertiliser and irrigation dates for (area, pdate, start) rows."""
    entry = lambda day, kind, code, amount: F.struct(
        day.alias("fdate"), F.lit(kind).alias("kind"), F.lit(code).alias("code"),
        F.lit(amount).alias("amount"),
    )
    material = FERTILISER_MATERIAL[crop]
    rows = [
        entry(F.date_add(F.col("pdate"), lag), "fertiliser", material, kg) for lag, kg in FERTILISER
    ]
    if crop == "rice":
        rows += [
            entry(F.date_add(F.col("start"), lag), "irrigation", code, mm)
            for lag, code, mm in RICE_IRRIGATION
        ]
    else:
        rows.append(entry(F.col("start"), "irrigation", "", 0.0))
    out = plantings.withColumn("_e", F.explode(F.array(*rows)))
    return out.select("area", "pdate", "_e.*")


def sample_profiles(
    candidates: DataFrame, count: int, seed: int, portable: bool = False
) -> DataFrame:
    """Soil profiles drawn with replacement, ``count`` members per area."""
    return draw_rows(candidates, ["area"], "profile", count, seed, portable)


def cultivar_ensemble(variants: DataFrame, crop: str, count: int = 40) -> DataFrame:
    """Members 1..count from the variants that have all parameters of the crop."""
    needed = CULTIVAR_PARAMETERS[crop]
    out = cycle_variants(variants, needed, ["variant"], count)
    return out.select("ensemble", F.lit(crop).alias("crop"), *needed)


def cultivar_lookup(areas: DataFrame, zones: DataFrame, finest: float = 1.0) -> DataFrame:
    """Cultivar zone of each area: one whose box meets the area, else the nearest centroid.

    ``zones`` carries (zone, bbox, centroid). The smallest zone id wins when several meet.
    """
    frames = zones.select("zone", F.col("bbox").alias("tile_box"))
    meet = spatial.boxes_touching(areas, frames, finest).groupBy("area").agg(
        F.min("zone").alias("zone")
    )
    direct = areas.select("area").join(meet, "area").withColumn("how", F.lit("meets"))
    rest = areas.join(meet.select("area"), "area", "left_anti").select(
        "area", F.col("centroid.x").alias("ax"), F.col("centroid.y").alias("ay")
    )
    spots = zones.select(
        "zone", F.col("centroid.x").alias("zx"), F.col("centroid.y").alias("zy")
    )
    near = spatial.nearest_join(rest, spots, ("ax", "ay"), ("zx", "zy"), "zone", finest=finest)
    return direct.select("area", "zone", "how").unionByName(
        near.select("area", "zone", F.lit("nearest").alias("how"))
    )
