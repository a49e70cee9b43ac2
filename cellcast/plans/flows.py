"""The four flows: update, nowcast, forecast, export.

The hydrology and crop simulators are outside this package. Their inputs are produced here
as tables (forcings, crop weather) and their outputs arrive as tables (``sim``, ``growth``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.operators import (
    assimilation, crops, drought, ensemble, grid, loads, spatial, terciles,
)
from cellcast.sources.normalisers import BBox, normalise
from cellcast.session import cut_lineage
from cellcast.sources.tables import delivery_keys, write_cells


def update(
    spark: SparkSession,
    product: str,
    raw: DataFrame,
    path: str,
    bbox: BBox | None = None,
    targets: Sequence[float] = (),
    source_res: float | None = None,
    **options,
) -> None:
    """Normalise landed rows, replace their deliveries, and keep one regridded table per target.

    A delivery is a variable, product, member and date; whatever else is stored for the date stays.
    """
    cells = normalise(product, raw, bbox, **options)
    if targets:
        cells = cut_lineage(cells)  # read by every target, normalised once
    write_cells(cells, f"{path}/{product}")
    for res in targets:
        out = grid.regrid(cells, source_res, res, delivery_keys(cells))
        write_cells(out, f"{path}/{product}_{int(1.0 / res)}")


def basin(soils: DataFrame, areas: DataFrame, resolution: float) -> DataFrame:
    """Soil cells of one resolution inside the basin polygons."""
    here = soils.filter(F.abs(F.col("resolution") - resolution) < 1e-6)
    inside = spatial.points_in_areas(here, areas)
    return inside.dropDuplicates(["gid"]).drop("area", "resolution")


def forcings(
    cells: DataFrame, index: DataFrame, start: str, end: str
) -> DataFrame:
    """Wide daily forcings of basin cells from tall cells with a ``var`` column.

    All four variables are read in one pass and pivoted in the same aggregation.
    """
    daily = grid.between(cells, start, end).join(index.select("gid", "row", "col"), ["row", "col"])
    pick = lambda v: F.max(F.when(F.col("var") == v, F.col("value")))
    return daily.groupBy("gid", "fdate").agg(
        pick("precip").alias("prec"), pick("tmax").alias("tmax"),
        pick("tmin").alias("tmin"), pick("wind").alias("wind"),
    )


def check_forcings(table: DataFrame, index: DataFrame, start: date, end: date) -> DataFrame:
    """Completeness per variable; the caller stops when one is not complete."""
    cells = index.agg(F.count_distinct("gid").alias("n")).scalar()
    days = (end - start).days + 1
    return loads.completeness(table, cells, days, ["prec", "tmax", "tmin", "wind"])


def nowcast_products(
    sim: DataFrame, names: Sequence[str], start: date, end: date, soils: DataFrame | None = None,
    fit: str = "mle", materialise: bool = True,
) -> DataFrame:
    """Requested drought indices from a tall simulation table, in one tall result.

    The wide daily series is built in one pass over ``sim`` and checkpointed for all indices.
    """
    first = F.col("layer").isNull()
    pick = lambda v: F.max(F.when((F.col("var") == v) & first, F.col("value"))).alias(v)
    moist = F.sum(F.when(F.col("var") == "soil_moist", F.col("value"))).alias("soil_moist")
    series = sim.groupBy("gid", "fdate").agg(pick("rainf"), pick("runoff"), pick("par"), moist)
    layered = sim.filter((F.col("var") == "soil_moist") & F.col("layer").isNotNull()).select(
        "gid", "fdate", "layer", F.col("value").alias("soil_moist")
    )
    return drought.run_indices(
        names, series, layered, soils, series, fit=fit, start=start, end=end,
        materialise=materialise,
    )


def ensemble_products(sim: DataFrame) -> DataFrame:
    """Mean and spread of every saved variable, date, cell and layer."""
    return ensemble.ensemble_summary(sim, ["name", "var", "fdate", "gid", "layer"])


def assimilate(
    sim: DataFrame, observations: DataFrame, method: str = "letkf", **options
) -> DataFrame:
    """(gid, fdate, ensemble, x, xa) of the analysis at the observation dates."""
    states = assimilation.state_vector(sim)
    dates = observations.select("fdate").distinct()
    due = states.join(dates, "fdate", "left_semi")
    analysed = assimilation.analyse(due, observations, method, **options)
    return assimilation.unpack_members(analysed, ["gid", "fdate"])


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table if it was written to its end, else nothing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def assimilation_cycle(
    sim: DataFrame,
    observe: Callable[[DataFrame, date], DataFrame],
    dates: Iterable[date],
    path: str,
    method: str = "letkf",
    **options,
) -> DataFrame:
    """Analyses at ``dates`` in order, each from a background that carries the analyses before it.

    ``sim`` is the run without observations: (gid, fdate, layer, ensemble, value). The background of a date is its
    layers times what earlier analyses made of the cell and member, the product of analysis over background so far. ``observe``
    gives the observations of a date, with what the background predicts for them: (fdate, ha, d, e), and lon and lat where
    ``method`` is 'local' (then ``sim`` carries them too and ``options`` go to ``analyse_local``).

    Every date leaves two tables under ``path``: its updated layers and, last, the factors (gid, ensemble, factor). A date whose factors
    are there is not computed again, so an interrupted run goes on where it stopped. The result has the updated layers of all
    dates: (gid, layer, ensemble, value, background, fdate). The loop is over analysis dates only, which a calendar bounds.
    A cell without rows on a date keeps its factor; one whose background is zero, too.
    """
    spark = sim.sparkSession
    factors: DataFrame | None = None
    parts = []
    spot = [c for c in ("lon", "lat") if c in sim.columns]
    for day in sorted(set(dates)):
        place = f"{path.rstrip('/')}/fdate={day.isoformat()}"
        parts.append(f"{place}/layers")
        done = _stored(spark, f"{place}/factors")
        if done is None:
            now = sim.filter(F.col("fdate") == F.lit(day))
            if factors is None:
                background = now.withColumn("_f", F.lit(1.0))
            else:
                background = now.join(factors.withColumnRenamed("factor", "_f"), ["gid", "ensemble"], "left")
            background = background.withColumn("_f", F.coalesce("_f", F.lit(1.0))).withColumn("value", F.col("value") * F.col("_f"))
            seen = observe(background.drop("_f"), day)
            states = assimilation.state_vector(background, ["gid", *spot])
            if method == "local":
                analysed = assimilation.analyse_local(states, seen, **options)
            else:
                analysed = assimilation.analyse(states, seen, method, **options)
            members = background.select("gid", "ensemble", "_f").distinct()
            ranked = members.withColumn("_i", F.row_number().over(Window.partitionBy("gid").orderBy("ensemble")))
            new = assimilation.unpack_members(analysed, ["gid"]).withColumnRenamed("ensemble", "_i")
            # The arrays hold a cell's members in order.
            change = F.coalesce(F.col("xa") / F.nullif("x", F.lit(0.0)), F.lit(1.0))
            ratios = ranked.join(new, ["gid", "_i"]).select("gid", "ensemble", "_f", change.alias("_change"))
            ratios = cut_lineage(ratios)
            updated = background.drop("_f").join(ratios.drop("_f"), ["gid", "ensemble"])
            updated.select(
                "gid", "layer", "ensemble", (F.col("value") * F.col("_change")).alias("value"), F.col("value").alias("background")
            ).write.mode("overwrite").parquet(f"{place}/layers")
            fresh = ratios.select("gid", "ensemble", (F.col("_f") * F.col("_change")).alias("factor"))
            if factors is not None:
                fresh = fresh.unionByName(factors.join(fresh, ["gid", "ensemble"], "left_anti"))
            fresh.write.mode("overwrite").parquet(f"{place}/factors")
            done = spark.read.parquet(f"{place}/factors")
        factors = done
    kinds = {f.name: f.dataType.simpleString() for f in sim.schema}
    schema = f"gid {kinds['gid']}, layer {kinds['layer']}, ensemble {kinds['ensemble']}, value double, background double"
    if not parts:
        return spark.createDataFrame([], f"{schema}, fdate date")
    dated = F.to_date(F.regexp_extract(F.input_file_name(), r"fdate=([0-9-]{10})/layers", 1))
    return spark.read.schema(schema).parquet(*parts).withColumn("fdate", dated)


def forecast_forcings(
    method: str,
    history: DataFrame,
    start: date,
    end: date,
    count: int,
    seed: int,
    probabilities: DataFrame | None = None,
    coarse: DataFrame | None = None,
    fine_to_coarse: DataFrame | None = None,
    forecast: DataFrame | None = None,
    lead_months: int = 3,
) -> DataFrame:
    """Forecast weather by 'esp', 'iri' or 'nmme'."""
    days = (end - start).days + 1
    if method == "esp":
        # Members get whole seasons only, so all have equal lengths.
        years = ensemble.whole_seasons(history, start.month, start.day, days)
        chosen = ensemble.esp_years(years, count, seed)
        return ensemble.member_forcings(history, chosen, start.month, start.day, days)
    if method == "iri":
        months = [(start.month - 1 + k) % 12 + 1 for k in range(lead_months)]
        whole = ensemble.whole_seasons(history, start.month, start.day, days)
        at = F.year("fdate") - F.when(F.month("fdate") < start.month, 1).otherwise(0)
        pool = coarse.withColumn("year", at).join(whole, "year", "left_semi").drop("year")
        drawn = terciles.resample(pool, probabilities, months, count, seed)
        return terciles.drawn_forcings(
            history, fine_to_coarse, drawn, start.month, start.day, days - 1
        )
    if method == "nmme":
        years = ensemble.interior_years(history.select(F.year("fdate").alias("year")).distinct())
        year = ensemble.pick_year(years, seed)
        first = F.lit(start.isoformat()).cast("date")
        return ensemble.rebuild_temperature(forecast, history, year, first)
    raise ValueError(f"unknown forecast method {method}")


def crop_weather(
    cells: DataFrame, areas: DataFrame, res: float, top: float, left: float, members: int, crop: str = "maize",
) -> DataFrame:
    """Daily crop weather per area and member from tall weather cells: means of the whole tiles that touch an area."""
    zonal = spatial.whole_tile_mean(cells, areas, res, top, left, keys=["var", "fdate"])
    return crops.weather_table(crops.pivot_weather(zonal, ["area", "fdate"]), members, crop=crop)
