"""Regular-grid operators on tall cell tables.

A cell is found by integer index arithmetic, never by comparing coordinates, so every
lookup is an equi-join or a plain column expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.operators.common import spread
from cellcast.schema import NODATA

# A hair of a cell: keeps 0.30000000000000004 / 0.1 on the right side of an edge.
_EPS = 1e-9


def row_of(lat: Column, top: float, res: float) -> Column:
    """Row index counted down from the centre latitude of the first row."""
    return F.floor((F.lit(top) - lat) / F.lit(res) + F.lit(0.5 + _EPS)).cast("int")


def col_of(lon: Column, left: float, res: float) -> Column:
    """Column index counted right from the centre longitude of the first column."""
    return F.floor((lon - F.lit(left)) / F.lit(res) + F.lit(0.5 + _EPS)).cast("int")


def with_index(df: DataFrame, top: float, left: float, res: float) -> DataFrame:
    return df.withColumn("row", row_of(F.col("lat"), top, res)).withColumn(
        "col", col_of(F.col("lon"), left, res)
    )


def subset_bbox(
    cells: DataFrame, res: float, bbox: tuple[float, float, float, float] | None
) -> DataFrame:
    """Cells whose box overlaps (minlon, minlat, maxlon, maxlat); edge cells are kept.

    The comparisons are bare column-to-literal, so the scan can skip row groups.
    """
    if bbox is None:
        return cells
    west, south, east, north = bbox
    half = res / 2.0
    return cells.filter(
        (F.col("lat") > south - half)
        & (F.col("lat") < north + half)
        & (F.col("lon") > west - half)
        & (F.col("lon") < east + half)
    )


def wrap_longitude(cells: DataFrame) -> DataFrame:
    """Longitudes above 180 become negative."""
    return cells.withColumn(
        "lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    )


def order_index(cells: DataFrame, dataset: Sequence[str] = ()) -> DataFrame:
    """Row by falling latitude and column by rising longitude, for any rectilinear grid.

    The ranking runs over distinct axis values only (thousands at most), not over cells.
    """

    def axis(name: str, out: str, order: Column) -> DataFrame:
        values = cells.select(*dataset, name).distinct()
        window = Window.partitionBy(*(dataset or [F.lit(0)])).orderBy(order)
        return values.withColumn(out, F.row_number().over(window) - 1)

    rows = axis("lat", "row", F.col("lat").desc())
    cols = axis("lon", "col", F.col("lon").asc())
    base = cells.drop("row", "col")
    return base.join(rows, [*dataset, "lat"]).join(cols, [*dataset, "lon"])


def resample_method(target: Column, source: Column) -> Column:
    """'near' for equal resolution, 'bilinear' for a finer target, else 'average'."""
    return (
        F.when(F.abs(target - source) < _EPS, F.lit("near"))
        .when(target < source, F.lit("bilinear"))
        .otherwise(F.lit("average"))
    )


def regrid_average(
    cells: DataFrame,
    res: float,
    keys: Sequence[str],
    top: float = 90.0,
    left: float = -180.0,
    value: str = "value",
) -> DataFrame:
    """Mean of the cell centres that fall in each target cell; ``top``/``left`` are edges."""
    row = F.floor((F.lit(top) - F.col("lat")) / res + _EPS).cast("int")
    col = F.floor((F.col("lon") - F.lit(left)) / res + _EPS).cast("int")
    out = cells.groupBy(*keys, row.alias("row"), col.alias("col")).agg(
        F.avg(value).alias(value)
    )
    return _with_centres(out, res, top, left).filter(F.col(value).isNotNull())


def _with_centres(df: DataFrame, res: float, top: float, left: float) -> DataFrame:
    return df.withColumn("lat", F.lit(top) - (F.col("row") + 0.5) * res).withColumn(
        "lon", F.lit(left) + (F.col("col") + 0.5) * res
    )


def _scatter(
    cells: DataFrame, res: float, reach: float, top: float, left: float
) -> DataFrame:
    """Repeat each source cell for the target centres within ``reach`` degrees of it."""

    def span(position: Column) -> Column:
        first = F.ceil((position - reach) / res - 0.5 - _EPS).cast("int")
        last = F.floor((position + reach) / res - 0.5 + _EPS).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    out = cells.withColumn("row", F.explode(span(F.lit(top) - F.col("lat"))))
    out = out.withColumn("col", F.explode(span(F.col("lon") - F.lit(left))))
    dy = F.abs(F.lit(top) - (F.col("row") + 0.5) * res - F.col("lat"))
    dx = F.abs(F.lit(left) + (F.col("col") + 0.5) * res - F.col("lon"))
    return out.withColumn("_dy", dy).withColumn("_dx", dx)


def regrid_bilinear(
    cells: DataFrame,
    source_res: float,
    res: float,
    keys: Sequence[str],
    top: float = 90.0,
    left: float = -180.0,
    value: str = "value",
) -> DataFrame:
    """Bilinear interpolation to a finer grid.

    Every source cell scatters its weight to the targets around it and the weights are
    summed with map-side combine: one shuffle, no neighbour join. A target is produced
    only when a source cell with data contains its centre; at edges the weights that
    exist are rescaled.
    """
    known = cells.filter(F.col(value).isNotNull())
    near = _scatter(known, res, source_res, top, left)
    near = near.withColumn(
        "_w", (1 - F.col("_dy") / source_res) * (1 - F.col("_dx") / source_res)
    )
    half = source_res / 2.0 + _EPS
    held = (F.col("_dy") <= half) & (F.col("_dx") <= half)
    out = (
        near.filter(F.col("_w") > _EPS)
        .groupBy(*keys, "row", "col")
        .agg(
            (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value),
            F.max(held).alias("_held"),
        )
        .filter("_held")
        .drop("_held")
    )
    return _with_centres(out, res, top, left)


def regrid_nearest(
    cells: DataFrame,
    source_res: float,
    res: float,
    keys: Sequence[str],
    top: float = 90.0,
    left: float = -180.0,
    value: str = "value",
) -> DataFrame:
    """Value of the source cell that contains each target centre (nearest centre)."""
    near = _scatter(cells, res, source_res / 2.0, top, left)
    picked = near.groupBy(*keys, "row", "col").agg(
        F.min(
            F.struct((F.col("_dy") * F.col("_dy") + F.col("_dx") * F.col("_dx")).alias("d"),
                     F.col(value).alias("v"))
        ).alias("_best")
    )
    out = picked.withColumn(value, F.col("_best.v")).drop("_best")
    return _with_centres(out, res, top, left)


def regrid(
    cells: DataFrame, source_res: float, res: float, keys: Sequence[str], **grid
) -> DataFrame:
    """Pick the form by resolution: equal - nearest, finer - bilinear, coarser - average."""
    if abs(res - source_res) < _EPS:
        return regrid_nearest(cells, source_res, res, keys, **grid)
    if res < source_res:
        return regrid_bilinear(cells, source_res, res, keys, **grid)
    return regrid_average(cells, res, keys, **grid)


def axis_nearest(
    sources: DataFrame, targets: DataFrame, name: str, dataset: Sequence[str] = ()
) -> DataFrame:
    """Closest source coordinate for every target coordinate of one axis.

    Both inputs are distinct axis values. The last source at or below and the first at or
    above come from one ordered pass; the lower one wins a tie.
    """
    both = sources.select(*dataset, F.col(name), F.col(name).alias("_src")).unionByName(
        targets.select(*dataset, F.col(name), F.lit(None).cast("double").alias("_src"))
    )
    window = Window.partitionBy(*(dataset or [F.lit(0)])).orderBy(F.col(name))
    below = F.last("_src", True).over(window.rangeBetween(Window.unboundedPreceding, 0))
    above = F.first("_src", True).over(window.rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_below", below).withColumn("_above", above)
    choice = (
        F.when(F.col("_below").isNull(), F.col("_above"))
        .when(F.col("_above").isNull(), F.col("_below"))
        .when(F.col(name) - F.col("_below") <= F.col("_above") - F.col(name), F.col("_below"))
        .otherwise(F.col("_above"))
    )
    return found.filter(F.col("_src").isNull()).select(
        *dataset, F.col(name).alias(f"target_{name}"), choice.alias(name)
    )


def regrid_rectilinear(
    cells: DataFrame, target_lats: DataFrame, target_lons: DataFrame
) -> DataFrame:
    """Nearest-neighbour regrid of a rectilinear grid.

    On such a grid the nearest cell is the nearest row crossed with the nearest column, so
    two small axis maps replace a search over all pairs of cells.
    """
    lat_map = axis_nearest(cells.select("lat").distinct(), target_lats, "lat")
    lon_map = axis_nearest(cells.select("lon").distinct(), target_lons, "lon")
    out = cells.join(lat_map, "lat").join(lon_map, "lon").drop("lat", "lon")
    return out.withColumnRenamed("target_lat", "lat").withColumnRenamed("target_lon", "lon")


def tile_id(row: Column, col: Column, tiles_down: int, size: int = 10) -> Column:
    """Tile number, left to right then top to bottom as by upper-left corner.

    ``tiles_down`` is the number of tile rows; arithmetic replaces a global ranking, which
    would pull the whole table through one task.
    """
    return (F.floor(col / size) * F.lit(tiles_down) + F.floor(row / size) + 1).cast("long")


def tile_rank(cells: DataFrame, size: int = 10) -> DataFrame:
    """Gap-free tile numbers by (left, top) corner, in two passes over the distinct tiles.

    Tiles are counted per column of tiles and ranked inside their column; a column begins after the tiles of all columns left of
    it. These beginnings are running sums over one short array (as many entries as the grid has columns of tiles).
    """
    tiled = cells.withColumn("tile_x", F.floor(F.col("col") / size).cast("int")).withColumn(
        "tile_y", F.floor(F.col("row") / size).cast("int")
    )
    tiles = tiled.select("tile_x", "tile_y").distinct()
    counts = tiles.groupBy("tile_x").agg(F.count("*").alias("n"))
    columns = counts.agg(F.sort_array(F.collect_list(F.struct("tile_x", "n"))).alias("_c"))
    before = F.transform(
        F.sequence(F.lit(1), F.size("_c")),
        lambda i: F.struct(
            F.element_at("_c", i)["tile_x"].alias("tile_x"),
            F.aggregate(F.slice("_c", F.lit(1), i - 1), F.lit(0).cast("long"), lambda acc, c: acc + c["n"]).alias("before"),
        ),
    )
    starts = columns.filter(F.size("_c") > 0).select(F.explode(before).alias("_s")).select("_s.*")
    inside = F.row_number().over(Window.partitionBy("tile_x").orderBy("tile_y"))
    ranks = tiles.withColumn("_r", inside).join(starts, "tile_x")
    ranks = ranks.select("tile_x", "tile_y", (F.col("before") + F.col("_r")).alias("tile"))
    return tiled.join(ranks, ["tile_x", "tile_y"])


#: Cells of one chunk of a grid that is filled up.
CHUNK = 1 << 16


def dense_grid(
    points: DataFrame, res: float, keys: Sequence[str], nodata: float = NODATA
) -> DataFrame:
    """Scatter points on the full grid spanned by each key; empty cells get ``nodata``.

    Points carry (lat, lon, value). When two points share a cell the greatest
    (lat, lon, value) is kept, so the answer does not depend on row order. Cells of a key are numbered row by row; the numbers are
    cut into chunks of ``CHUNK`` that are dealt to tasks before any cell is made, so one large grid is made by all of them.
    """
    top_left = points.groupBy(*keys).agg(
        F.max("lat").alias("_top"),
        F.min("lat").alias("_bottom"),
        F.min("lon").alias("_left"),
        F.max("lon").alias("_right"),
    )
    steps = lambda a, b: F.floor((a - b) / res + _EPS).cast("int")
    sized = top_left.withColumn("_cols", (steps(F.col("_right"), F.col("_left")) + 1).cast("long"))
    sized = sized.withColumn("_last", F.col("_cols") * (steps(F.col("_top"), F.col("_bottom")) + 1) - 1)
    chunks = sized.select(*keys, "_cols", "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(CHUNK).cast("long"))).alias("_at"))
    # A chunk is a small row that becomes many: adaptive execution would merge them by size.
    cells = spread(chunks, *keys, "_at").select(*keys, "_cols", F.explode(F.sequence("_at", F.least(F.col("_at") + CHUNK - 1, F.col("_last")))).alias("_i"))
    whole = (F.col("_i") - F.col("_i") % F.col("_cols")) / F.col("_cols")
    grid = cells.select(*keys, F.round(whole).cast("int").alias("row"), (F.col("_i") % F.col("_cols")).cast("int").alias("col"))
    placed = (
        points.join(top_left, list(keys))
        .withColumn("row", steps(F.col("_top"), F.col("lat")))
        .withColumn("col", steps(F.col("lon"), F.col("_left")))
        .groupBy(*keys, "row", "col")
        .agg(F.max(F.struct("lat", "lon", "value")).alias("_p"))
    )
    out = grid.join(placed, [*keys, "row", "col"], "left")
    return out.select(
        *keys, "row", "col", F.coalesce(F.col("_p.value"), F.lit(nodata)).alias("value")
    )


def index_table(basin: DataFrame, top: float, left: float, res: float, size: int = 10) -> DataFrame:
    """(gid, row, col, tile) of every basin cell on one grid, computed once per grid."""
    out = with_index(basin.select("gid", "lat", "lon"), top, left, res)
    tiles = out.withColumn("tile_x", F.floor(F.col("col") / size).cast("int"))
    return tiles.withColumn("tile_y", F.floor(F.col("row") / size).cast("int"))


def value_at_cells(
    cells: DataFrame, index: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Daily values at basin cells: date filter first, then an equi-join on (row, col)."""
    daily = between(cells, start, end)
    return daily.join(index.select("gid", "row", "col"), ["row", "col"]).select(
        "gid", "fdate", "value"
    )


def between(
    df: DataFrame, start: str | None = None, end: str | None = None, day: str = "fdate"
) -> DataFrame:
    """Inclusive date range; partition filters when the table is partitioned by date."""
    if start is not None:
        df = df.filter(F.col(day) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(day) <= F.lit(end).cast("date"))
    return df


def sample_points(
    cells: DataFrame, points: DataFrame, top: float, left: float, res: float
) -> DataFrame:
    """Value of the cell under each (lon, lat) point; points off the grid drop out."""
    placed = with_index(points, top, left, res)
    return placed.join(cells.drop("lat", "lon"), ["row", "col"])


def union_sum(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Overlay by sum, for example soil layers on one date."""
    return cells.groupBy(*keys).agg(F.sum(value).alias(value))


def union_latest(
    cells: DataFrame, keys: Sequence[str], priority: str, value: str = "value"
) -> DataFrame:
    """Overlay where the input with the highest priority wins (mosaic of tiles)."""
    known = cells.filter(F.col(value).isNotNull())
    best = known.groupBy(*keys).agg(
        F.max(F.struct(F.col(priority), F.col(value))).alias("_best")
    )
    return best.select(*keys, F.col(f"_best.{value}").alias(value))


def mask_by_first_date(series: DataFrame, cell: Sequence[str], value: str = "value") -> DataFrame:
    """Keep the cells that have a value on the first date of the table."""
    first = series.agg(F.min("fdate")).scalar()
    alive = series.filter((F.col("fdate") == first) & F.col(value).isNotNull())
    return series.join(alive.select(*cell).distinct(), list(cell), "left_semi")


def pixel_centroids(cells: DataFrame) -> DataFrame:
    """(lon, lat, value) of the cells with data."""
    kept = [c for c in cells.columns if c not in ("row", "col", "lat", "lon", "value")]
    return cells.filter(F.col("value").isNotNull()).select(*kept, "lon", "lat", "value")


def grid_catalog(cells: DataFrame, keys: Sequence[str] = ("var", "dataset")) -> DataFrame:
    """Resolution of every table: the smallest step between neighbouring latitudes."""
    lats = cells.select(*keys, "lat").distinct()
    window = Window.partitionBy(*keys).orderBy("lat")
    steps = lats.withColumn("_step", F.col("lat") - F.lag("lat").over(window))
    steps = steps.filter(F.col("_step") > _EPS)
    return steps.groupBy(*keys).agg(F.round(F.min("_step"), 6).alias("resolution"))


def find_tables(
    catalog: DataFrame, var: str, prefix: str, resolution: float
) -> DataFrame:
    """Tables of a variable whose name starts with ``prefix`` at a resolution."""
    return catalog.filter(
        (F.col("var") == var)
        & F.col("dataset").startswith(prefix)
        & (F.abs(F.col("resolution") - resolution) < 1e-6)
    )


def nearest_resolution(catalog: DataFrame, wanted: Column | float, keys: Sequence[str]) -> DataFrame:
    """Available resolution closest to the wanted one; the finer wins a tie."""
    target = wanted if isinstance(wanted, Column) else F.lit(wanted)
    gap = F.struct(F.abs(F.col("resolution") - target), F.col("resolution"))
    return catalog.groupBy(*keys).agg(F.min_by("resolution", gap).alias("resolution"))


def closest_of(wanted: Column, options: Column) -> Column:
    """Element of an array of resolutions closest to the wanted one; the finer wins a tie."""
    gaps = F.transform(
        options, lambda r: F.struct(F.round(F.abs(r - wanted), 9).alias("gap"), r.alias("r"))
    )
    return F.array_min(gaps)["r"]
