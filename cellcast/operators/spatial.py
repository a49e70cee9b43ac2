"""Joins between areas, points and grid cells.

No join here compares all pairs. Polygon joins meet on an integer grid bin before the exact
test; nearest-neighbour joins descend a pyramid of bins and drop every branch that cannot
hold the answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellcast.functions import geometry
from cellcast.operators import quadtree


def _bin(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("int")


def area_bins(areas: DataFrame, size: float, grow: Column | float = 0.0) -> DataFrame:
    """Repeat each area for the bins its bounding box (grown by ``grow``) touches."""
    pad = grow if isinstance(grow, Column) else F.lit(float(grow))
    low = lambda c: _bin(F.col(f"bbox.{c}") - pad, size)
    high = lambda c: _bin(F.col(f"bbox.{c}") + pad, size)
    return areas.withColumn("bx", F.explode(F.sequence(low("xmin"), high("xmax")))).withColumn(
        "by", F.explode(F.sequence(low("ymin"), high("ymax")))
    )


def points_in_areas(points: DataFrame, areas: DataFrame, size: float = 1.0) -> DataFrame:
    """Points (lon, lat) strictly inside areas; ``areas`` carries gid as ``area`` and edges."""
    return quadtree.points_inside(points, areas, size)


def boxes_touching(areas: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """Pairs (area, tile) whose boxes overlap.

    ``tiles`` carries a ``tile_box`` struct. Both sides meet in every bin they share; a pair
    is kept only in the first such bin, so no distinct is needed.
    """
    left = area_bins(areas.select("area", "bbox"), size)
    right = area_bins(
        tiles.withColumnRenamed("tile_box", "bbox"), size
    ).withColumnRenamed("bbox", "tile_box")
    both = left.join(right, ["bx", "by"])
    overlap = (
        (F.col("bbox.xmin") <= F.col("tile_box.xmax"))
        & (F.col("bbox.xmax") >= F.col("tile_box.xmin"))
        & (F.col("bbox.ymin") <= F.col("tile_box.ymax"))
        & (F.col("bbox.ymax") >= F.col("tile_box.ymin"))
    )
    first = lambda c: _bin(F.greatest(F.col(f"bbox.{c}"), F.col(f"tile_box.{c}")), size)
    only_once = (F.col("bx") == first("xmin")) & (F.col("by") == first("ymin"))
    return both.filter(overlap & only_once).drop("bx", "by")


def grid_frame(cell_index: DataFrame, res: float | None = None) -> DataFrame:
    """One row (top, left, res, rows, cols) of the grid that (row, col, lat, lon) cells lie on.

    Rows run south and columns east. The spacing is read from the cells; cells that all lie in one
    row and one column show none and need ``res``.
    """
    ends = cell_index.agg(*[f(c).alias(f"{c}_{n}") for c in ("row", "col", "lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda c: F.col(f"{c}_hi") - F.col(f"{c}_lo")
    step = F.coalesce(span("lat") / F.nullif(span("row"), F.lit(0)), span("lon") / F.nullif(span("col"), F.lit(0)))
    return ends.withColumn("res", F.lit(res).cast("double") if res is not None else step.cast("double")).select(
        (F.col("lat_hi") + F.col("res") * F.col("row_lo")).alias("top"), (F.col("lon_lo") - F.col("res") * F.col("col_lo")).alias("left"), "res"
    )


def zonal_membership(
    cell_index: DataFrame, areas: DataFrame, size: float = 1.0, res: float | None = None
) -> DataFrame:
    """(area, row, col) of the cell centres inside each area, from the distinct cells.

    An area without any centre, as one smaller than a cell, gets the cell that holds its centroid, if
    the grid has it. The spacing is that of the grid; ``res`` is needed only where the index is a single cell.
    """
    inside = points_in_areas(cell_index.select("row", "col", "lat", "lon"), areas, size).select("area", "row", "col")
    kept = areas.select("area", "centroid", F.lit(1).alias("_k")).join(inside, "area", "left")
    # One row: the corner and the spacing of the grid.
    placed = kept.join(F.broadcast(grid_frame(cell_index, res).withColumn("_k", F.lit(1))), "_k")
    # Half-open cells: a centroid on an edge belongs to one of them.
    row = F.floor((F.col("top") - F.col("centroid.y")) / F.col("res") + 0.5).cast("int")
    col = F.floor((F.col("centroid.x") - F.col("left")) / F.col("res") + 0.5).cast("int")
    kinds = {f.name: f.dataType for f in cell_index.schema if f.name in ("row", "col")}
    named = placed.select(
        "area", F.coalesce("row", row.cast(kinds["row"])).alias("row"), F.coalesce("col", col.cast(kinds["col"])).alias("col")
    )
    return named.join(cell_index.select("row", "col"), ["row", "col"], "left_semi").select("area", "row", "col")


def zonal_mean(
    cells: DataFrame, membership: DataFrame, keys: Sequence[str] = ("fdate",)
) -> DataFrame:
    """Clipped mean per area and key; membership is built once and joined on (row, col)."""
    joined = cells.join(membership, ["row", "col"])
    return joined.groupBy("area", *keys).agg(F.avg("value").alias("value"))


# Part of a tile by which an edge is followed beyond the tiles it is reckoned to meet; the exact test decides.
_FOLLOW = 1e-9


def tile_box(step: float, top: float, left: float) -> Column:
    """Box of the tile (tile_y, tile_x); ``top`` and ``left`` are the corner of tile (0, 0)."""
    x0 = F.lit(left) + F.col("tile_x") * step
    y1 = F.lit(top) - F.col("tile_y") * step
    return F.struct(x0.alias("xmin"), (y1 - step).alias("ymin"), (x0 + step).alias("xmax"), y1.alias("ymax"))


def _edge_tiles(edges: DataFrame, step: float, top: float, left: float) -> DataFrame:
    """(area, tile_y, tile_x) of the tiles that an edge (area, x1, y1, x2, y2) meets, their sides included.

    An edge is cut at the rows of tiles, so it is tried on about as many tiles as it is long.
    """
    c = F.col
    u = lambda x: (c(x) - left) / step
    v = lambda y: (F.lit(top) - c(y)) / step
    whole = lambda x: F.floor(x).cast("int")
    placed = edges.withColumns({"_u": u("x1"), "_v": v("y1"), "_du": u("x2") - u("x1"), "_dv": v("y2") - v("y1")})
    low, high = F.least(c("_v"), c("_v") + c("_dv")), F.greatest(c("_v"), c("_v") + c("_dv"))
    rows = placed.withColumn("tile_y", F.explode(F.sequence(whole(low - _FOLLOW), whole(high + _FOLLOW))))

    def at(height: Column, level: float) -> Column:
        """Place across at which the edge reaches a height, or its nearer end; for a level edge the end ``level``."""
        share = F.least(F.greatest((height - c("_v")) / F.nullif(c("_dv"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return c("_u") + c("_du") * F.when(c("_dv") != 0, share).otherwise(F.lit(level))

    one, two = at(c("tile_y") - _FOLLOW, 0.0), at(c("tile_y") + 1 + _FOLLOW, 1.0)
    first, last = whole(F.least(one, two) - _FOLLOW), whole(F.greatest(one, two) + _FOLLOW)
    tried = rows.withColumn("tile_x", F.explode(F.sequence(first, last))).withColumn("_t", tile_box(step, top, left))
    # Apart along an axis, or with all corners on one side of the edge's line.
    side = lambda x, y: (c("x2") - c("x1")) * (c(f"_t.{y}") - c("y1")) - (c("y2") - c("y1")) * (c(f"_t.{x}") - c("x1"))
    sides = [side(x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    meets = (
        (F.least("x1", "x2") <= c("_t.xmax")) & (F.greatest("x1", "x2") >= c("_t.xmin"))
        & (F.least("y1", "y2") <= c("_t.ymax")) & (F.greatest("y1", "y2") >= c("_t.ymin"))
        & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    )
    return tried.filter(meets).select("area", "tile_y", "tile_x")


def tiles_touching(areas: DataFrame, tiles: DataFrame, step: float, top: float, left: float) -> DataFrame:
    """Pairs (area, tile_y, tile_x) of tiles that share a point with an area, rims included.

    A tile meets an edge of the area, or it lies inside as a whole and so does its middle. ``tiles`` are distinct (tile_y, tile_x).
    Areas without edges or with coordinates that are not finite touch nothing.
    """
    finite = F.forall("edges", lambda e: F.coalesce(
        F.abs(e["x1"]) + F.abs(e["y1"]) + F.abs(e["x2"]) + F.abs(e["y2"]) < F.lit(math.inf), F.lit(False)
    ))
    # An area that is stored twice has each edge twice.
    edges = areas.filter(finite).select("area", F.explode("edges").alias("_e")).select("area", "_e.*").distinct()
    shapes = edges.groupBy("area").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    box = tiles.select("tile_y", "tile_x", tile_box(step, top, left).alias("_t"))
    middles = box.select(
        "tile_y", "tile_x", ((F.col("_t.xmin") + F.col("_t.xmax")) / 2).alias("lon"), ((F.col("_t.ymin") + F.col("_t.ymax")) / 2).alias("lat")
    )
    within = points_in_areas(middles, shapes, step).select("area", "tile_y", "tile_x")
    return _edge_tiles(edges, step, top, left).unionByName(within).distinct()


def whole_tile_mean(
    cells: DataFrame,
    areas: DataFrame,
    res: float,
    top: float,
    left: float,
    size: int = 10,
    keys: Sequence[str] = ("fdate",),
    boxes: bool = False,
) -> DataFrame:
    """Mean over areas of the means of whole tiles touching them (no clip).

    Tile means are taken first: 100 cells become one row before anything is joined. A tile touches an area that it
    shares a point with; with ``boxes`` it is enough that it meets the area's bounding box.
    """
    tiled = cells.withColumn("tile_y", F.floor(F.col("row") / size).cast("int")).withColumn(
        "tile_x", F.floor(F.col("col") / size).cast("int")
    )
    means = tiled.groupBy("tile_y", "tile_x", *keys).agg(F.avg("value").alias("tile_mean"))
    step, upper, outer = res * size, top + res / 2, left - res / 2
    tiles = tiled.select("tile_y", "tile_x").distinct()
    if boxes:
        frames = tiles.withColumn("tile_box", tile_box(step, upper, outer))
        touching = boxes_touching(areas, frames, step).select("area", "tile_y", "tile_x")
    else:
        touching = tiles_touching(areas, tiles, step, upper, outer)
    joined = means.join(touching, ["tile_y", "tile_x"])
    return joined.groupBy("area", *keys).agg(F.avg("tile_mean").alias("value"))


# Pyramid of square bins over the box of the points: every level divides a bin into 4 x 4.
_SPLIT = 4


def _pyramid_level(finer: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tight boxes of a level from those of the next finer one."""
    up = lambda c: F.floor(F.col(c) / _SPLIT).cast("int").alias(c)
    return finer.groupBy(*by, up("bx"), up("by")).agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"),
    )


def _root(where: DataFrame, finest: float) -> tuple[Callable[[Column, Column], dict[str, Column]], int]:
    """Bin numbers of a place at the finest level, and the depth of a pyramid over the box of all (px, py)."""
    box = where.agg(*[f(c) for c in ("px", "py") for f in (F.min, F.max)]).first()
    x0, x1, y0, y1 = [0.0 if v is None else float(v) for v in box]
    root = max(x1 - x0, y1 - y0, finest) * (1 + 1e-9)
    depth = min(15, max(0, math.ceil(math.log(root / finest, _SPLIT))))  # bins stay 32-bit; any depth is exact
    size = root / _SPLIT**depth
    return lambda x, y: {"bx": _bin(x - x0, size), "by": _bin(y - y0, size)}, depth


def _levels(spots: DataFrame, by: Sequence[str], depth: int) -> list[DataFrame]:
    """Tight boxes of the occupied bins of (px, py, bx, by), from the root bin down."""
    levels = [
        spots.groupBy(*by, "bx", "by").agg(
            F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")
        )
    ]
    for _ in range(depth):
        levels.insert(0, _pyramid_level(levels[0], by))
    return levels


def _gap(low: Column, high: Column, at: Column) -> Column:
    return F.greatest(low - at, at - high, F.lit(0.0))


def _reach(low: Column, high: Column, at: Column) -> Column:
    return F.greatest(F.abs(at - low), F.abs(at - high))


def _prune(frontier: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keep branches whose closest possible point beats every branch's farthest one."""
    tx, ty = F.col("tx"), F.col("ty")
    gx, gy = _gap(F.col("x0"), F.col("x1"), tx), _gap(F.col("y0"), F.col("y1"), ty)
    rx, ry = _reach(F.col("x0"), F.col("x1"), tx), _reach(F.col("y0"), F.col("y1"), ty)
    scored = frontier.withColumn("_lo", gx * gx + gy * gy).withColumn("_hi", rx * rx + ry * ry)
    window = Window.partitionBy(*by, "tx", "ty")
    scored = scored.withColumn("_cut", F.min("_hi").over(window))
    return scored.filter(F.col("_lo") <= F.col("_cut") * (1 + 1e-12)).select(
        *by, "tx", "ty", "bx", "by"
    )


def nearest_join(
    targets: DataFrame,
    points: DataFrame,
    target_xy: tuple[str, str],
    point_xy: tuple[str, str],
    point_key: str,
    by: Sequence[str] = (),
    finest: float = 0.25,
    digits: int | None = None,
) -> DataFrame:
    """Exact nearest point for every target (planar degrees), smallest key on a tie.

    Distinct target and point positions descend a pyramid of bins whose root is the box of all
    points, whatever their coordinates; targets may lie anywhere. Each level is one equi-join on
    the parent bin followed by a bound on the distance, and coarser levels are rolled up from the
    finest. The number of branches alive per target stays small whatever the point density, and
    no target meets all points. ``finest`` is the last bin size: take about the spacing of the
    points. With ``digits`` distances that agree to so many decimals are a tie. Returns the target columns, ``point_key`` and ``distance``; both are NULL for a target
    without coordinates or without any point under its ``by`` values.
    """
    keys = list(by)
    where = points.select(
        *keys,
        F.col(point_xy[0]).cast("double").alias("px"),
        F.col(point_xy[1]).cast("double").alias("py"),
        F.col(point_key).alias("_key"),
    ).filter(F.col("px").isNotNull() & F.col("py").isNotNull())
    place, depth = _root(where, finest)
    bins = place(F.col("px"), F.col("py"))
    spots = where.groupBy(*keys, "px", "py").agg(F.min("_key").alias("_key")).withColumns(bins)
    asked = targets.select(
        *keys,
        F.col(target_xy[0]).cast("double").alias("tx"),
        F.col(target_xy[1]).cast("double").alias("ty"),
    ).distinct()

    levels = _levels(spots, keys, depth)
    # All points share the root bin, so the descent starts one level below it.
    frontier = asked.withColumn("bx", F.lit(0)).withColumn("by", F.lit(0))
    for boxes in levels[1:]:
        up = lambda c: F.floor(F.col(c) / _SPLIT).cast("int")
        boxes = boxes.withColumn("parent_x", up("bx")).withColumn("parent_y", up("by"))
        parents = frontier.withColumnsRenamed({"bx": "parent_x", "by": "parent_y"})
        frontier = _prune(parents.join(boxes, [*keys, "parent_x", "parent_y"]), keys)
    dx, dy = F.col("px") - F.col("tx"), F.col("py") - F.col("ty")
    away = F.sqrt(dx * dx + dy * dy)
    order = away if digits is None else F.round(away, digits)
    best = (
        frontier.join(spots, [*keys, "bx", "by"])
        .groupBy(*keys, "tx", "ty")
        .agg(F.min(F.struct(order.alias("_o"), F.col("_key"), away.alias("d"))).alias("_b"))
        .select(
            *keys,
            "tx",
            "ty",
            F.col("_b._key").alias(point_key),
            F.col("_b.d").alias("distance"),
        )
    )
    placed = targets.withColumn("tx", F.col(target_xy[0]).cast("double")).withColumn(
        "ty", F.col(target_xy[1]).cast("double")
    )
    return placed.join(best, [*keys, "tx", "ty"], "left").drop("tx", "ty")


#: Points expected on a tile and day, targets of a tile that go together, and parts the days are dealt to.
_PER_TILE, _BLOCK, _PARTS = 8, 4096, 16
_PAIRS = 2**20  # distances held at once


def _nearest_rows(by: str, digits: int | None):
    """Function of (targets, candidates) tables of a group: every target on every day with its nearest candidate."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([(by, "ascending"), ("_key", "ascending")])
        day = right.column(by).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(np.diff(day, prepend=-1)), len(day)] if len(day) else [0]
        x, y, px, py = (t.column(c).to_numpy() for t, names in ((left, ("tx", "ty")), (right, ("px", "py"))) for c in names)
        picks, away = [np.empty(0, np.int64)], [np.empty(0)]
        for a, b in zip(cuts, cuts[1:]):
            step = max(1, _PAIRS // (b - a))
            for k in range(0, len(x), step):
                square = (px[a:b] - x[k : k + step, None]) ** 2 + (py[a:b] - y[k : k + step, None]) ** 2
                best = square.argmin(1)
                least = np.sqrt(square[np.arange(len(best)), best])
                if digits is not None:
                    # Distances that agree to so many decimals are a tie: the smallest key comes first.
                    tied = np.flatnonzero((square <= ((least + 2 * 10.0**-digits) ** 2)[:, None]).sum(1) > 1)
                    best[tied] = np.round(np.sqrt(square[tied]), digits).argmin(1)
                picks.append(a + best)
                away.append(np.sqrt(square[np.arange(len(best)), best]))
        found = pa.array(np.concatenate(picks))
        whole = left.drop_columns(["tx", "ty", "_tx", "_ty", "_block", "_part"])
        out = whole.take(pa.array(np.tile(np.arange(len(x)), len(cuts) - 1)))
        distance = pa.array(np.concatenate(away), from_pandas=True)
        for name, values in ((by, right.column(by).take(found)), ("_key", right.column("_key").take(found)), ("distance", distance)):
            out = out.append_column(name, values)
        return out

    return rows


def nearest_on_days(
    targets: DataFrame,
    points: DataFrame,
    target_xy: tuple[str, str],
    point_xy: tuple[str, str],
    point_key: str,
    by: str = "fdate",
    finest: float = 0.25,
    digits: int | None = None,
) -> DataFrame:
    """``nearest_join`` of every target on every day of the points, without a row per target and day in any shuffle.

    Targets of a tile go together. With d the distance from the middle of the tile's targets to the nearest point of a day and r
    the radius of their circle, the nearest point of each of them is within d + 2 r of the middle: ``nearest_join`` gives d per tile
    and day, and only the points in that circle meet the targets. Tiles hold a few points a day, so circles do too. A circle takes
    bins of a size near its own, so a tile far from all points meets as few bins as others.
    Returns the target columns, ``by``, ``point_key`` and ``distance``, NULL as in ``nearest_join``.
    """
    number = lambda c, name: F.col(c).cast("double").alias(name)
    where = points.select(by, number(point_xy[0], "px"), number(point_xy[1], "py"), F.col(point_key).alias("_key"))
    where = where.filter(F.col(by).isNotNull())
    located = where.filter("px IS NOT NULL AND py IS NOT NULL")
    seen = located.agg(
        F.count("*"), F.approx_count_distinct(by), F.approx_count_distinct(F.xxhash64(_bin(F.col("px"), finest), _bin(F.col("py"), finest))),
    ).first()
    count, days, bins = (max(1, v) for v in seen)
    tile = math.sqrt(_PER_TILE * bins * days / count) * finest
    days_row = where.agg(F.collect_set(by).alias("_days")).withColumn("_k", F.lit(1))  # no longer than the calendar
    on_days = lambda df: df.withColumn("_k", F.lit(1)).join(F.broadcast(days_row), "_k").withColumn(by, F.explode("_days")).drop("_k", "_days")

    at = lambda c, size: F.floor(F.col(c) / size).cast("long")
    placed = targets.select("*", number(target_xy[0], "tx"), number(target_xy[1], "ty"))
    known = placed.filter("tx IS NOT NULL AND ty IS NOT NULL").withColumn("_tx", at("tx", F.lit(tile))).withColumn("_ty", at("ty", F.lit(tile)))
    low, high = (lambda c: F.min(c).alias(f"{c}0")), (lambda c: F.max(c).alias(f"{c}1"))
    tiles = known.groupBy("_tx", "_ty").agg(low("tx"), high("tx"), low("ty"), high("ty"), F.ceil(F.count("*") / _BLOCK).alias("_blocks"))
    half = lambda c: (F.col(f"{c}1") - F.col(f"{c}0")) / 2
    tiles = tiles.select(
        "_tx", "_ty", "_blocks", (F.col("tx0") + half("tx")).alias("_x"), (F.col("ty0") + half("ty")).alias("_y"),
        F.sqrt(half("tx") * half("tx") + half("ty") * half("ty")).alias("_r"),
    )
    centres = nearest_join(on_days(tiles), where, ("_x", "_y"), ("px", "py"), "_key", [by], finest).drop("_key")
    # A little more than the circle, for rounding and for ties.
    centres = centres.withColumn("_reach", (F.col("distance") + 2 * F.col("_r")) * (1 + 1e-9) + 1e-7)
    centres = centres.withColumn("_level", F.greatest(F.ceil(F.log2(F.col("_reach") / (2 * tile))), F.lit(0)).cast("int"))
    size = F.lit(tile) * F.pow(F.lit(2.0), F.col("_level"))
    covers = lambda c: F.explode(F.sequence(*[F.floor((F.col(c) + k * F.col("_reach")) / size).cast("long") for k in (-1, 1)]))
    circles = centres.filter("distance IS NOT NULL").withColumn("_bx", covers("_x")).withColumn("_by", covers("_y"))
    spots = located.groupBy(by, "px", "py").agg(F.min("_key").alias("_key"))
    spots = spots.join(circles.select(by, "_level").distinct(), by)
    spots = spots.withColumn("_bx", at("px", size)).withColumn("_by", at("py", size))
    dx, dy = F.col("px") - F.col("_x"), F.col("py") - F.col("_y")
    met = circles.join(spots, [by, "_level", "_bx", "_by"]).filter(dx * dx + dy * dy <= F.col("_reach") * F.col("_reach"))
    empty = [F.lit(None).cast(met.schema[c].dataType).alias(c) for c in ("px", "py", "_key")]
    met = met.select("_tx", "_ty", "_blocks", by, "px", "py", "_key").unionByName(
        centres.filter("distance IS NULL").select("_tx", "_ty", "_blocks", by, *empty)
    )
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    met = met.withColumn("_block", blocks).withColumn("_part", F.pmod(F.xxhash64(by), F.lit(_PARTS)).cast("int")).drop("_blocks")
    held = known.join(tiles.select("_tx", "_ty", "_blocks"), ["_tx", "_ty"])
    held = held.withColumn("_block", F.pmod(F.xxhash64(*targets.columns), F.col("_blocks"))).drop("_blocks")
    held = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    group = ["_tx", "_ty", "_block", "_part"]
    layout = T.StructType([*targets.schema, met.schema[by], met.schema["_key"], T.StructField("distance", T.DoubleType())])
    layout = T.StructType([T.StructField(f.name, f.dataType) for f in layout])
    # Both sides come from the tiles; fresh names keep their keys apart.
    own = [f"{c}_of" for c in group]
    met = met.select(by, "px", "py", "_key", *[F.col(c).alias(n) for c, n in zip(group, own)])
    found = held.groupBy(*group).cogroup(met.groupBy(*own)).applyInArrow(_nearest_rows(by, digits), layout)
    lone = on_days(placed.filter("tx IS NULL OR ty IS NULL").drop("tx", "ty"))
    lone = lone.withColumn("_key", F.lit(None).cast(layout["_key"].dataType)).withColumn("distance", F.lit(None).cast("double"))
    return found.unionByName(lone).withColumnRenamed("_key", point_key)


def nearest_known_value(
    cells: DataFrame, index: DataFrame, keys: Sequence[str] = ("fdate",), res: float = 0.25
) -> DataFrame:
    """Value at basin cells, or at the nearest cell with data where that one has none.

    ``index`` carries (gid, row, col); ``cells`` keeps empty cells as NULL rows. Exact hits
    are settled by an equi-join; only the misses search, and only on dates that have misses.
    """
    known = cells.filter(F.col("value").isNotNull())
    spots = index.select("gid", "row", "col")
    hits = known.join(spots, ["row", "col"]).select("gid", *keys, "value")
    empty = cells.filter(F.col("value").isNull()).join(spots, ["row", "col"])
    empty = empty.select("gid", *keys, "lat", "lon")
    near = known.join(empty.select(*keys).distinct(), list(keys), "left_semi").withColumn(
        "_cell", F.struct("row", "col", "value")
    )
    found = nearest_join(
        empty, near, ("lon", "lat"), ("lon", "lat"), "_cell", by=keys, finest=res
    )
    filled = found.filter(F.col("_cell").isNotNull()).select("gid", *keys, F.col("_cell.value").alias("value"))
    return hits.unionByName(filled)


def bins_near(areas: DataFrame, levels: list[DataFrame], step: float) -> DataFrame:
    """(area, bx, by): the finest bins that may hold a point of each area's lowest ring.

    Branch and bound: with r half the diagonal of a bin's box and d the distance from its middle to the polygon, the points
    of the bin are at d - r to d + r. Some point is no farther than the smallest d + r of an area, so its lowest ring ends
    at the next whole step; bins that begin beyond are dropped with all below them.
    """
    shapes = areas.select("area", "edges")
    frontier = areas.select("area", F.lit(0).alias("bx"), F.lit(0).alias("by"))
    up = lambda c: F.floor(F.col(c) / _SPLIT).cast("int")
    for boxes in levels[1:]:
        boxes = boxes.withColumn("parent_x", up("bx")).withColumn("parent_y", up("by"))
        parents = frontier.withColumnsRenamed({"bx": "parent_x", "by": "parent_y"})
        met = parents.join(boxes, ["parent_x", "parent_y"]).join(shapes, "area")
        width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        middle = (F.col("x0") + width / 2, F.col("y0") + height / 2)
        scored = met.select(
            "area", "bx", "by", geometry.distance_to(*middle, F.col("edges")).alias("_d"),
            (F.sqrt(width * width + height * height) / 2).alias("_r"),
        )
        nearest = F.min(F.col("_d") + F.col("_r")).over(Window.partitionBy("area"))
        end = F.greatest(F.ceil(nearest / step), F.lit(1)) * step * (1 + 1e-9)
        frontier = scored.withColumn("_end", end).filter(F.col("_d") - F.col("_r") <= F.col("_end")).select("area", "bx", "by")
    return frontier


def within_growing_buffer(
    areas: DataFrame,
    points: DataFrame,
    step: float = 0.1,
    finest: float = 0.25,
    size: float = 1.0,
) -> DataFrame:
    """Points inside each area's bounding box, else in the smallest buffer that has any.

    The buffer grows in whole ``step``s of distance to the polygon: ring = ceil(distance / step), and the lowest ring
    is kept whole. Only the points of the bins that ``bins_near`` leaves are looked at, however far away they lie.
    Points without coordinates are in no buffer; an area has no row if there are no points.
    """
    shapes = areas.select("area", "edges", "bbox", "centroid")
    binned = points.withColumn("bx", _bin(F.col("lon"), size)).withColumn(
        "by", _bin(F.col("lat"), size)
    )
    in_box = (
        F.col("lon").between(F.col("bbox.xmin"), F.col("bbox.xmax"))
        & F.col("lat").between(F.col("bbox.ymin"), F.col("bbox.ymax"))
    )
    inside = binned.join(area_bins(shapes, size), ["bx", "by"]).filter(in_box)
    inside = inside.withColumn("ring", F.lit(0).cast("long"))
    misses = shapes.join(inside.select("area").distinct(), "area", "left_anti")
    xy = (F.col("lon").cast("double"), F.col("lat").cast("double"))
    where = points.select(xy[0].alias("px"), xy[1].alias("py")).filter("px IS NOT NULL AND py IS NOT NULL")
    place, depth = _root(where, finest)
    levels = _levels(where.withColumns(place(F.col("px"), F.col("py"))), (), depth)
    placed = points.filter("lon IS NOT NULL AND lat IS NOT NULL").withColumns(place(*xy))
    near = placed.join(bins_near(misses, levels, step), ["bx", "by"]).join(misses.select("area", "edges"), "area")
    away = geometry.distance_to(F.col("lon"), F.col("lat"), F.col("edges"))
    ringed = near.withColumn("ring", F.greatest(F.ceil(away / step), F.lit(1)).cast("long"))
    lowest = ringed.groupBy("area").agg(F.min("ring").alias("ring"))
    outside = ringed.join(lowest, ["area", "ring"])
    kept = [*points.columns, "area", "ring"]
    return inside.select(*kept).unionByName(outside.select(*kept))
