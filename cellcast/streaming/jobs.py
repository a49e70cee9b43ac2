"""Continuous versions of three batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellcast.functions import scalars
from cellcast.session import cut_lineage
from cellcast.operators.loads import by_keys, replace_dates, upsert
from cellcast.sources.tables import delivery_keys


def daily_ingest(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    normalise: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Files landing in a folder are merged into the cell table.

    Cells delivered again replace themselves, other cells of the same delivery stay: a date may be
    split over micro-batches, and a replayed one changes nothing. Only touched partitions are rewritten.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        del batch_id
        fresh = cut_lineage(normalise(batch))
        partitions = delivery_keys(fresh)
        place = [c for c in ("row", "col", "lat", "lon") if c in fresh.columns]
        try:
            stored = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            merged = fresh
        else:
            stored = stored.select(*[F.col(c).cast(fresh.schema[c].dataType).alias(c) for c in fresh.columns])
            touched = by_keys(stored, fresh, partitions, "left_semi")
            # Read to its end before its own partitions are written anew.
            merged = cut_lineage(upsert(touched, fresh, [*partitions, *place]))
        replace_dates(merged, path, partitions)

    return (
        spark.readStream.schema(schema)
        .parquet(landing)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_rollup(hourly: DataFrame, delay: str = "2 days") -> DataFrame:
    """Hourly weather to daily extremes and mean wind; days close ``delay`` after their end."""
    speed = scalars.wind_speed(F.col("u10m"), F.col("v10m"))
    rolled = (
        hourly.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "lat", "lon")
        .agg(
            F.max("t2m").alias("_hi"), F.min("t2m").alias("_lo"), F.avg(speed).alias("wind")
        )
    )
    return rolled.select(
        F.to_date("window.start").alias("fdate"), "lat", "lon",
        scalars.kelvin_to_celsius(F.col("_hi")).alias("tmax"),
        scalars.kelvin_to_celsius(F.col("_lo")).alias("tmin"),
        "wind",
    )


def dry_spell_counter(
    daily: DataFrame, duration: int = 14, recovery: int = 2
) -> DataFrame:
    """Live dry-spell count per cell from rows (gid, fdate, rainf, threshold).

    The state of a cell is four numbers: days seen, spell length, wet days in a row and
    spells so far. Days of a cell must arrive in date order across batches.
    """
    state_type = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("seen", "length", "wet", "spells")]
    )
    output = T.StructType(
        [daily.schema["gid"], T.StructField("fdate", T.DateType()),
         T.StructField("spells", T.LongType())]
    )

    def count(
        key: Any, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        seen, length, wet, spells = state.get if state.exists else (0, 0, 0, 0)
        days = pd.concat(list(frames)).sort_values("fdate")
        counts = []
        for rain, limit in zip(days["rainf"], days["threshold"]):
            seen += 1
            wet = wet + 1 if rain > limit else 0
            if seen >= recovery:
                length = 0 if wet >= recovery else length + 1
                spells += int(length == duration)
            counts.append(spells)
        state.update((seen, length, wet, spells))
        yield pd.DataFrame({"gid": key[0], "fdate": days["fdate"], "spells": counts})

    return daily.groupBy("gid").applyInPandasWithState(
        count, output, state_type, "append", GroupStateTimeout.NoTimeout
    )
