"""Incremental loads: windows, replacement, completeness, output stamping."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.operators.common import read_existing


def load_windows(existing: DataFrame, today: Column | str, key: Sequence[str]) -> DataFrame:
    """Next load window per dataset: the day after the newest date, up to ``today``."""
    end = F.lit(today).cast("date") if isinstance(today, str) else today
    newest = existing.groupBy(*key).agg(F.max("fdate").alias("newest"))
    return newest.filter(F.col("newest") < end).select(
        *key, F.date_add("newest", 1).alias("start"), end.alias("end")
    )


def resolve_windows(requests: DataFrame, windows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Configured start/end override the computed window; ``status`` says what is skipped."""
    both = requests.select(
        *key, F.col("start").alias("_cs"), F.col("end").alias("_ce")
    ).join(windows, list(key), "left")
    start = F.coalesce("_cs", "start")
    end = F.coalesce("_ce", "end")
    ok = start.isNotNull() & end.isNotNull()
    return both.select(
        *key,
        start.alias("start"),
        end.alias("end"),
        F.when(ok, "load").otherwise("skip").alias("status"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace all rows of ``old`` with the same keys.

    The replaced keys are made distinct first, so one key with many rows costs nothing extra.
    """
    return by_keys(old, new, keys, "left_anti").unionByName(new.select(*old.columns))


def by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on the distinct keys of ``right``; NULL keys equal each other."""
    there = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(there, same, how)


def replace_dates(
    df: DataFrame, path: str, partitions: Sequence[str] = ("fdate",), order: Sequence[str] = ()
) -> None:
    """Write by date, replacing only the partitions present (dynamic partition overwrite).

    The rebalance hint lets Spark cut a date that holds too many rows into several files and
    merge small ones, so neither a hot date nor tiny files slow the write.
    """
    dealt = df.hint("rebalance", *[F.col(p) for p in partitions])
    if order:
        dealt = dealt.sortWithinPartitions(*partitions, *order)
    (
        dealt.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def upsert_table(
    spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partition: str = "fdate"
) -> None:
    """Keyed upsert into a date-partitioned table, rewriting only the touched dates."""
    dates = new.select(partition).distinct()
    stored = spark.read.parquet(path)
    touched = stored.join(dates, partition, "left_semi").select(*new.columns)
    replace_dates(upsert(touched, new, keys), path, [partition])


def fill_stamp(df: DataFrame, **stamps) -> DataFrame:
    """Give a value to stamp columns where they are NULL or absent."""
    for name, value in stamps.items():
        have = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(have, F.lit(value)))
    return df


def drop_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Remove an inclusive date range (before the new rows of that range are added)."""
    inside = F.col("fdate").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.filter(~inside)


def simulation_output(
    raw: DataFrame, start: Column, skip: int = 0, ensemble: int | None = None, tiles: int | None = None
) -> DataFrame:
    """Stamp simulator rows for storage: drop warm-up days, set member, wrap tile ids."""
    out = raw.filter(F.col("fdate") >= F.date_add(start, skip))
    if ensemble is not None:
        out = fill_stamp(out, ensemble=ensemble)
    if tiles is not None and "rid" in raw.columns:
        out = out.withColumn("rid", F.pmod(F.col("rid") + tiles, F.lit(tiles)) + 1)
    return out


def needs_rewrite(columns: Sequence[str], ensemble: bool) -> bool:
    """A stored table without a member column cannot take ensemble output."""
    return ensemble and "ensemble" not in columns


def rewrite_with_member(spark: SparkSession, path: str, member: int, target: str) -> bool:
    """Copy a table that has no member column to ``target`` with one; whether there was a need to."""
    stored = spark.read.parquet(path)
    if not needs_rewrite(stored.columns, True):
        return False
    stamped = fill_stamp(stored, ensemble=member)
    replace_dates(stamped, target, [c for c in ("ensemble", "fdate") if c in stamped.columns])
    return True


LEDGER = "version long, data string, stored timestamp"


def publish(df: DataFrame, root: str, partitions: Sequence[str] = ("fdate",)) -> int:
    """Store ``df`` as the next version of the table at ``root``; returns its number.

    Rows go to a folder of their own first. A ledger of one-row files then names it: such a file appears whole or not at
    all, so ``current`` gives the old version or the new one, never both. Folders of old versions stay for those
    who still read them. Of writers that end at the same number the later one counts.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    known = read_existing(spark, f"{root}/versions", LEDGER)
    version = 1 + ((known.agg(F.max("version")).first()[0] or 0) if known is not None else 0)
    data = f"data-{uuid.uuid4().hex}"
    replace_dates(df, f"{root}/{data}", partitions)
    row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(data).alias("data"), F.current_timestamp().alias("stored"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version of a table stored by ``publish``; None where there is none."""
    root = root.rstrip("/")
    known = read_existing(spark, f"{root}/versions", LEDGER)
    newest = known and known.agg(F.max(F.struct("version", "stored", "data")).alias("v")).first()["v"]
    return spark.read.parquet(f"{root}/{newest['data']}") if newest else None


def add_member_column(spark: SparkSession, root: str, member: int, partitions: Sequence[str] = ("fdate",)) -> bool:
    """Replace a stored table that has no member column by one that has; readers may be on it. Whether there was a need to."""
    stored = current(spark, root)
    if stored is None or not needs_rewrite(stored.columns, True):
        return False
    publish(fill_stamp(stored, ensemble=member), root, ["ensemble", *partitions])
    return True


def completeness(series: DataFrame, cells: int | Column, days: int, variables: Sequence[str]) -> DataFrame:
    """Rows found and expected per forcing variable."""
    counts = series.agg(*[F.count(v).alias(v) for v in variables])
    pairs = ", ".join(f"'{v}', {v}" for v in variables)
    tall = counts.selectExpr(f"stack({len(variables)}, {pairs}) as (var, found)")
    expected = (cells if isinstance(cells, Column) else F.lit(cells)) * days
    return tall.withColumn("expected", expected.cast("long")).withColumn(
        "complete", (F.col("found") == F.col("expected")).cast("int")
    )


def missing_days(series: DataFrame, cell: Sequence[str], start: Column, end: Column) -> DataFrame:
    """(cell, day) pairs with no row between ``start`` and ``end``."""
    wanted = series.select(*cell).distinct().withColumn("fdate", F.explode(F.sequence(start, end)))
    return wanted.join(series.select(*cell, "fdate"), [*cell, "fdate"], "left_anti")


def forecast_complete(table: DataFrame, start: str, end: str, key: Sequence[str] = ()) -> DataFrame:
    """Distinct dates found against the days of the window."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    rows = table.filter(F.col("fdate").between(a, b)).select(*key, "fdate").distinct()
    return rows.groupBy(*key).agg(F.count("*").alias("found")).withColumn(
        "expected", (F.datediff(b, a) + 1).cast("long")
    ).withColumn("complete", (F.col("found") == F.col("expected")).cast("int"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last delivery of each key, by aggregation rather than by a window."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(order), *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (order, *rest)])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Top row per key under an order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")
