"""Table scans, appended raster tables and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.operators.grid import between
from cellcast.operators.loads import replace_dates
from cellcast.schema import NODATA


def scan_dates(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Date-range scan; a partition filter on date-partitioned tables."""
    return between(spark.read.parquet(path), start, end)


def append_typed(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Append tables of one shape and stamp each with its type (crop calendars)."""
    out = None
    for kind, df in parts:
        stamped = df.withColumn("type", F.lit(kind))
        out = stamped if out is None else out.unionByName(stamped)
    return out


#: What tells deliveries of one date apart, as far as a table has it.
DELIVERY_KEYS = ("dataset", "var", "ensemble", "fdate")


def delivery_keys(cells: DataFrame) -> list[str]:
    return [k for k in DELIVERY_KEYS if k in cells.columns]


def write_cells(cells: DataFrame, path: str) -> None:
    """Cell tables are partitioned by delivery: a late one replaces itself only.

    Other variables, products and members stored for the same date stay. Inside files rows lie tile by tile
    where the table has tiles.
    """
    replace_dates(cells, path, delivery_keys(cells), [c for c in ("tile", "rid") if c in cells.columns])


def write_derived(df: DataFrame, table: str) -> None:
    """Create or replace a derived table (ensemble mean, spread)."""
    df.write.mode("overwrite").saveAsTable(table)


def write_series_csv(wide: DataFrame, path: str) -> None:
    """Date-by-polygon text table, sorted by date over all files."""
    wide.orderBy("fdate").write.mode("overwrite").option("header", "true").csv(path)


def write_grids(cells: DataFrame, path: str, start: str | None = None, end: str | None = None) -> None:
    """One folder per date with (row, col, value); gaps are written as the nodata number."""
    out = between(cells, start, end).select(
        "fdate", "row", "col", F.coalesce("value", F.lit(NODATA)).alias("value")
    )
    replace_dates(out, path, ["fdate"])


def write_features(yields: DataFrame, areas: DataFrame, path: str) -> None:
    """Yield statistics with their geometry text as JSON lines."""
    shaped = yields.join(areas.select(F.col("area").alias("gid"), "wkt"), "gid", "left")
    shaped.select(
        "gid",
        "wkt",
        F.col("avg_yield").alias("average"),
        F.col("max_yield").alias("maximum"),
        F.col("min_yield").alias("minimum"),
        F.col("std_yield").alias("spread"),
    ).write.mode("overwrite").json(path)
