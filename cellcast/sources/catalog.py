"""Static catalogues as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Variable, dataset, first year, last year (0 = still running), days between
# maps, cell size in degrees, coverage, use (IN input, AS assimilated, FC forecast).
PRODUCTS = [
    ("precip", "chirps", 1981, 0, 1, 0.05, "Africa", "IN"),
    ("precip", "trmm", 1998, 0, 1, 0.25, "Global", "IN"),
    ("precip", "rfe2", 2001, 0, 1, 0.10, "Africa", "IN"),
    ("precip", "cmorph", 1998, 0, 1, 0.25, "Global", "IN"),
    ("precip", "gpm", 2014, 0, 1, 0.10, "Global", "IN"),
    ("meteorology", "ncep", 1981, 0, 1, 1.875, "Global", "IN"),
    ("meteorology", "prism", 1981, 0, 1, 0.04, "CONUS", "IN"),
    ("soilmoist", "amsre", 2002, 2011, 1, 0.25, "Global", "AS"),
    ("soilmoist", "smos", 2009, 0, 1, 0.25, "Global", "AS"),
    ("soilmoist", "smap", 2015, 0, 1, 0.36, "Global", "AS"),
    ("evap", "mod16", 2000, 0, 8, 0.01, "Global", "AS"),
    ("tws", "grace", 2002, 0, 30, 1.0, "Global", "AS"),
    ("snow", "mod10", 2001, 0, 1, 0.005, "Global", "AS"),
    ("snow", "modscag", 2001, 0, 1, 0.01, "Global", "AS"),
    ("lai", "modis", 2002, 0, 8, 0.005, "Global", "AS"),
    ("meteorology", "iri", 2000, 0, 30, 2.5, "Global", "FC"),
    ("meteorology", "nmme", 2000, 0, 1, 0.5, "Global", "FC"),
]
PRODUCT_SCHEMA = (
    "variable string, dataset string, first_year int, last_year int, step_days int, "
    "resolution double, coverage string, mode string"
)

# Output variables that have one column per soil layer.
LAYERED = ["soil_moist", "soil_temp", "smliqfrac", "smfrozfrac"]


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRODUCTS, PRODUCT_SCHEMA)


def satellite_tiles(spark: SparkSession) -> DataFrame:
    """Longitude/latitude boxes of the 36 x 18 sinusoidal tiles, from the projection itself.

    A tile spans 10 equatorial degrees; x = lon * cos(lat). The box of a tile runs over its
    edge latitudes, where the cosine is extreme. Tiles that miss the globe are left out.
    """
    ids = spark.range(36 * 18).select(
        (F.col("id") / 36).cast("int").alias("v"), (F.col("id") % 36).cast("int").alias("h")
    )
    top, bottom = 90 - 10 * F.col("v"), 80 - 10 * F.col("v")
    west, east = (F.col("h") - 18) * 10.0, (F.col("h") - 17) * 10.0
    # Widest parallel of the tile: the edge nearest the equator.
    near = F.least(F.abs(top), F.abs(bottom))
    far = F.greatest(F.abs(top), F.abs(bottom))
    inner = F.when(west >= 0, west).otherwise(-east)
    reach = 180.0 * F.cos(F.radians(near.cast("double")))
    tiles = ids.withColumn("_inner", inner).filter(inner < reach - 1e-9)
    # Near the edge of the globe only part of the tile is land-bearing sphere: the farthest
    # latitude at which the inner edge still lies on it.
    limit = F.degrees(F.acos(F.least(F.lit(1.0), F.col("_inner") / 180.0)))
    reached = F.least(far.cast("double"), limit)
    cos_near, cos_far = F.cos(F.radians(near.cast("double"))), F.cos(F.radians(reached))
    lon = lambda x, c: F.when(c > 1e-12, x / c).otherwise(F.signum(x) * 180.0)
    bound = lambda x: F.greatest(F.lit(-180.0), F.least(F.lit(180.0), x))
    west_lon = F.least(lon(west, cos_near), lon(west, cos_far))
    east_lon = F.greatest(lon(east, cos_near), lon(east, cos_far))
    north = top > 0
    box = F.struct(
        bound(west_lon).alias("xmin"),
        F.when(north, near.cast("double")).otherwise(-reached).alias("ymin"),
        bound(east_lon).alias("xmax"),
        F.when(north, reached).otherwise(-near.cast("double")).alias("ymax"),
    )
    return tiles.select("h", "v", box.alias("tile_box"))


def tile_of(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(h, v) of the tile under a point."""
    h = F.floor(18 + lon * F.cos(F.radians(lat)) / 10)
    return h.cast("int"), F.floor((90 - lat) / 10).cast("int")
