"""Polygons as quadtree covers, and point tests on them.

A cover holds the quads a polygon meets. A quad without edges is inside as a whole; a boundary quad carries the
edges near it and what all other edges add to the even-odd count of its points, so a test reads a handful of edges however many
the polygon has, and gives what the test on all edges gives:

* edges above, below or left of the quad are never counted;
* an edge right of it is counted at height y iff one of its ends is above y, so edges that follow each other cancel at the vertex
  they share. Only the ends of whole runs remain: a constant for those above the quad, a short list of heights otherwise.

Quads are split until they hold ``MOST`` edges at most, ``DEEPEST`` is reached or the cover would grow beyond the size of its
polygon. Leaves lie on every ``STEP``-th level, so a point asks few levels, and only those present in its bin of ``size`` degrees.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellcast.functions import geometry

MOST, STEP, DEEPEST, SPARE = 16, 2, 12, 1024
#: Relative width of the rim in which an edge still belongs to a quad.
RIM = 1e-12
_EDGE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


class _Polygon:
    """Edges of one polygon and the quads made from them."""

    def __init__(self, edges: np.ndarray):
        # A level edge never crosses a level ray.
        self.edges = edges[edges[:, 1] != edges[:, 3]]
        x1, y1, x2, y2 = self.edges.T
        slope = (x2 - x1) / (y2 - y1)
        scale = 1.0 + float(np.abs(self.edges).max(initial=0.0))
        self.rim = RIM * scale
        # What rounding can do to a place on an edge.
        rim = self.rim + np.abs(slope) * scale * 1e-14
        self.facts = np.stack([
            x1, y1, y2, np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2), slope, rim,
        ])

    def box(self) -> tuple[float, float, float, float]:
        _, _, _, left, right, low, high, _, _ = self.facts
        return left.min(), low.min(), right.max(), high.max()

    def restrict(self, level, qx, qy, size, near, heights, base):
        """Edges, heights and constant of a quad from those of the quad around it."""
        side = size / 2.0**level
        x0, y0 = qx * side - self.rim, qy * side - self.rim
        x1, y1 = (qx + 1) * side + self.rim, (qy + 1) * side + self.rim
        if len(near):
            xa, ya, yb, left, right, low, high, slope, rim = self.facts[:, near]
            # The part of each edge at the quad's heights.
            one = xa + slope * (np.maximum(y0, low) - ya)
            two = xa + slope * (np.minimum(y1, high) - ya)
            present = (high >= y0) & (low <= y1)
            beyond = present & (np.maximum(np.minimum(one, two), left) - rim > x1)
            if beyond.any():
                heights = np.concatenate([heights, ya[beyond], yb[beyond]])
            near = near[present & ~beyond & (np.minimum(np.maximum(one, two), right) + rim >= x0)]
        if len(heights):
            base = (base + int((heights > y1).sum())) % 2
            inner, counts = np.unique(heights[(heights <= y1) & (heights >= y0)], return_counts=True)
            heights = inner[counts % 2 == 1]
        return near, heights, base

    def below(self, quads: list[tuple], level: int, size: float) -> list[tuple]:
        """The quads on a deeper level that may hold inner points, from quads not yet restricted."""
        out, todo = [], list(quads)
        while todo:
            at, qx, qy, near, heights, base = todo.pop()
            near, heights, base = self.restrict(at, qx, qy, size, near, heights, base)
            if not len(near) and not len(heights) and not base:
                continue
            if at == level:
                out.append((at, qx, qy, near, heights, base))
            else:
                todo += [(at + 1, 2 * qx + i, 2 * qy + j, near, heights, base) for i in (0, 1) for j in (0, 1)]
        return out

    def leaves(self, size: float) -> list[tuple]:
        """(level, qx, qy, edges, heights, base) of the cover.

        The quad with most edges is split first. Splitting ends where none holds more than ``MOST`` and, as long thin
        shapes would be cut without end, where there are twice as many quads as edges.
        """
        if not len(self.edges):
            return []
        box = self.box()
        extent = max(box[2] - box[0], box[3] - box[1], size)
        top = -math.ceil(math.log2(extent / size))
        cells = [math.floor(v / (size / 2.0**top)) for v in box]
        every, none = np.arange(len(self.edges)), np.empty(0)
        roots = [(top, x, y, every, none, 0) for x in range(cells[0], cells[2] + 1) for y in range(cells[1], cells[3] + 1)]
        number = itertools.count()
        rank = lambda q: (-len(q[3]) - len(q[4]), next(number), q)
        heap = [rank(q) for q in self.below(roots, 0, size)]
        heapq.heapify(heap)
        done: list[tuple] = []
        room = 2 * len(self.edges) + SPARE
        while heap and -heap[0][0] > MOST and len(heap) + len(done) < room:
            _, _, quad = heapq.heappop(heap)
            level, qx, qy, *held = quad
            if level >= DEEPEST:
                done.append(quad)
                continue
            parts = [(level + 1, 2 * qx + i, 2 * qy + j, *held) for i in (0, 1) for j in (0, 1)]
            for part in self.below(parts, level + STEP, size):
                heapq.heappush(heap, rank(part))
        done += [q for *_, q in heap]
        return [(level, qx, qy, self.edges[near], heights, base) for level, qx, qy, near, heights, base in done]


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def cover(areas: DataFrame, size: float = 1.0) -> DataFrame:
    """(area, _level, _qx, _qy, _bx, _by, _edges, _heights, _base) for every quad of every area (area, edges)."""
    names = ["_level", "_qx", "_qy", "_bx", "_by", "_edges", "_heights", "_base"]
    kinds = "_level int, _qx long, _qy long, _bx long, _by long, _edges " + _EDGE + ", _heights array<double>, _base int"
    schema = T.StructType([T.StructField("area", areas.schema["area"].dataType), *T.StructType.fromDDL(kinds).fields])

    def batch(keys: pa.Array, quads: list[tuple]) -> pa.RecordBatch:
        at, level, qx, qy, edges, heights, base = zip(*quads)
        flat = np.concatenate(edges) if edges else np.empty((0, 4))
        struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], ["x1", "y1", "x2", "y2"])
        whole = [pa.array(v, pa.int64()) for v in (qx, qy, [x >> k for x, k in zip(qx, level)], [y >> k for y, k in zip(qy, level)])]
        columns = [
            keys.take(pa.array(at)), pa.array(level, pa.int32()), *whole, _lists(edges, struct),
            _lists(heights, pa.array(np.concatenate(heights), pa.float64())), pa.array(base, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["area", *names])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quads: list[tuple] = []
            for i in range(b.num_rows):
                ring = b.column(1)[i]
                if not ring.is_valid or not len(ring):
                    continue
                parts = ring.values
                edges = np.stack([parts.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], 1)
                if not np.isfinite(edges).all():
                    continue
                for leaf in _Polygon(edges).leaves(size):
                    quads.append((i, *leaf))
                    if len(quads) == 4096:
                        yield batch(b.column(0), quads)
                        quads = []
            if quads:
                yield batch(b.column(0), quads)

    return areas.select("area", F.col("edges").cast(_EDGE).alias("edges")).mapInArrow(build, schema)


def points_inside(points: DataFrame, areas: DataFrame, size: float = 1.0, salts: int = 16) -> DataFrame:
    """Rows of ``points`` (lon, lat) with the ``area`` they lie in, one row per pair.

    Points first meet the levels present in their bin, which drops those far from all areas; then each
    meets the one quad it lies in per level. Quads are repeated over ``salts``, so a crowded quad is worked on by several tasks.
    Rows without coordinates and areas without edges or with coordinates that are not finite match nothing.
    """
    quads = cover(areas, size)
    own = points.columns
    levels = quads.groupBy("_bx", "_by").agg(F.collect_set("_level").alias("_levels"))
    bin_ = lambda c: F.floor(F.col(c).cast("double") / F.lit(size)).alias(f"_b{'x' if c == 'lon' else 'y'}")
    near = points.select("*", bin_("lon"), bin_("lat")).join(levels, ["_bx", "_by"])
    side = F.lit(size) / F.pow(F.lit(2.0), F.col("_level"))
    asked = near.select(*own, F.explode("_levels").alias("_level")).select(
        "*", F.floor(F.col("lon").cast("double") / side).alias("_qx"), F.floor(F.col("lat").cast("double") / side).alias("_qy"),
        F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int").alias("_salt"),
    )
    salted = quads.drop("_bx", "_by").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = asked.join(salted, ["_level", "_qx", "_qy", "_salt"])
    y = F.col("lat").cast("double")
    count = geometry.crossings(F.col("lon").cast("double"), y, F.col("_edges"))
    count = count + F.size(F.filter("_heights", lambda h: h > y)) + F.col("_base")
    return met.filter(count % 2 == 1).select(*own, "area")
