"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def keys(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def drop_nulls(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names))


def daily_series(
    raw: DataFrame, cell: Sequence[str], day: Column, **measures: Column
) -> DataFrame:
    """One row per (cell, fdate).

    This is the step that makes every per-cell window safe: whatever share of the raw rows
    one cell holds, partial aggregation shrinks it to at most one row per calendar day
    before the shuffle.
    """
    grouped = raw.groupBy(*cell, day.alias("fdate"))
    return grouped.agg(*[expr.alias(name) for name, expr in measures.items()])


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Hash-partition by key over all shuffle partitions.

    Adaptive execution merges small partitions by bytes; a stage that is heavy on CPU per
    row (fits, matrix steps) should keep them apart. It replaces the shuffle the following
    window or group needs anyway.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *by)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salts: int = 16,
    spread_by: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Equi-join for a coarse key: rows of ``big`` that share a key go to ``salts`` tasks.

    ``small`` must be unique on ``on``; it is repeated once per salt. ``spread_by`` names
    columns of ``big`` that differ between rows of one key.
    """
    spread = [F.col(c) for c in (spread_by or [c for c in big.columns if c not in on])]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def members(df: DataFrame, count: int, name: str = "ensemble") -> DataFrame:
    """Repeat every row for members 1..count."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(count))))


def calendar(df: DataFrame, start: Column, end: Column, name: str = "fdate") -> DataFrame:
    """Repeat every row for each day from ``start`` to ``end``."""
    return df.withColumn(name, F.explode(F.sequence(start, end)))


def read_existing(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame | None:
    """Parquet rows under a path or glob; None where nothing matches it."""
    reader = spark.read.options(**options)
    try:
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
