"""Drought indices on daily cell series.

Inputs are (gid, fdate, ...) with one row per cell and day. All indices partition by ``gid``
once; the fits reuse that partitioning. Outputs are (gid, fdate, value).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellcast.functions import scalars
from cellcast.functions.dates import dekad_start
from cellcast.functions.gamma import fit_profiles, fit_thom, standard_score
from cellcast.operators import series as S
from cellcast.operators.common import spread
from cellcast.operators.grid import between
from cellcast.session import cut_lineage

log = logging.getLogger(__name__)
CELL = ["gid"]
DAYS_PER_MONTH = 30
LIMIT = scalars.INDEX_LIMIT


def _add_months(day: date, months: int) -> date:
    year, month = divmod(day.month - 1 + months, 12)
    first_next = date(day.year + year + (month + 1) // 12, (month + 1) % 12 + 1, 1)
    last = (first_next - date(day.year + year, month + 1, 1)).days
    return date(day.year + year, month + 1, min(day.day, last))


def long_enough(duration: int, start: date, end: date) -> bool:
    """Does the period hold at least ``duration`` months."""
    if duration < 1:
        return False
    return (_add_months(start, duration) - start).days + 1 <= (end - start).days + 1


def thom_parameters(means: DataFrame, value: str = "pm") -> DataFrame:
    """Closed-form gamma parameters per cell from mean and mean log: two partial sums."""
    x = F.col(value)
    usable = F.when(x > 0, x)
    stats = means.groupBy("gid").agg(
        F.avg(usable).alias("_m"), F.avg(F.log(usable)).alias("_l"), F.count(usable).alias("n")
    )
    return stats.withColumn("_a", F.log("_m") - F.col("_l")).select(
        "gid", "n", *_thom(F.col("_a"), F.col("_m"))
    )


def _thom(gap: Column, mean: Column) -> list[Column]:
    safe = F.when(gap > 1e-12, gap)
    shape = (1 + F.sqrt(1 + 4 * safe / 3)) / (4 * safe)
    return [shape.alias("shape"), (mean / shape).alias("scale")]


@F.pandas_udf(T.DoubleType())
def gamma_score(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    """Bounded normal score of two-parameter gamma probabilities over an Arrow batch."""
    z = standard_score(x.to_numpy(), shape.to_numpy(), 0.0, scale.to_numpy(), LIMIT)
    return pd.Series(z)


# Declared non-deterministic so that a filter on the result is not pushed below it, which
# would run the function twice per row. The values themselves are deterministic.
gamma_score = gamma_score.asNondeterministic()


def _codes(cells: pa.Array) -> np.ndarray:
    """A number per distinct cell; -1 for none."""
    return cells.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _score_cells(t: pa.Table) -> pa.RecordBatch:
    """Fit the usable means of every cell in a table sorted by cell, and score all of its rows."""
    cells = t.column("gid").combine_chunks()
    x = t.column("pm").to_numpy()
    sample = t.column("usable").to_numpy() & np.isfinite(x)
    codes = _codes(cells)
    fresh = np.append(True, codes[1:] != codes[:-1])
    number = np.cumsum(fresh) - 1
    held, starts = np.unique(number[sample], return_index=True)
    params = np.full((3, number[-1] + 1), np.nan)
    how = np.full(number[-1] + 1, "none", object)
    if len(held):
        values = x[sample]
        *fitted, inner = fit_profiles(values, starts)
        params[:, held] = fitted
        how[held] = np.where(inner, "mle", "mle_edge")
        ends = np.append(starts[1:], len(values))
        for k in np.flatnonzero(np.isnan(fitted[0])):
            closed = fit_thom(values[starts[k] : ends[k]])
            how[held[k]] = "none" if closed is None else "thom"
            if closed is not None:
                params[:, held[k]] = closed
    z = standard_score(x, *params[:, number], LIMIT)
    columns = [cells, t.column("fdate").combine_chunks(), t.column("usable").combine_chunks(), pa.array(z), pa.array(how[number], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["gid", "fdate", "usable", "z", "method"])


#: Rows that are fitted together: a fit takes some hundred array steps however few cells it has.
ROWS_AT_ONCE = 2**17


def _score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells whole, many at once: rows wait for enough others, those of the last cell for the next round."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) < ROWS_AT_ONCE:
            continue
        table = pa.Table.from_batches(waiting)
        gid = _codes(table.column("gid").combine_chunks())
        others = np.flatnonzero(gid != gid[-1])
        if len(others):
            cut = int(others[-1]) + 1
            yield _score_cells(table.slice(0, cut))
            waiting = table.slice(cut).to_batches()
    if waiting:
        yield _score_cells(pa.Table.from_batches(waiting))


def standardised_index(
    series: DataFrame,
    duration: int,
    value: str,
    start: date | None = None,
    end: date | None = None,
    fit: str = "mle",
    compat: bool = False,
) -> DataFrame | None:
    """Standardised index of the mean over ``duration`` 30-day months.

    ``fit='mle'`` fits a three-parameter gamma per cell, all cells of an Arrow batch in the same array steps. ``method`` says 'mle' for an inner maximum, 'mle_edge' where the likelihood
    has none (left-skewed samples) and 'thom' where only the closed form exists;
    ``fit='thom'`` uses the closed form as native window aggregates. Rows before the first
    full window are NULL, or 0 with ``compat``. None when the period is too short.
    """
    if start is not None and end is not None:
        if not long_enough(duration, start, end):
            log.warning("period too short for a %s-month index", duration)
            return None
    rows = duration * DAYS_PER_MONTH
    bounded = between(
        series, start.isoformat() if start else None, end.isoformat() if end else None
    )
    bounded = bounded.select("gid", "fdate", value)
    if fit == "mle":
        bounded = spread(bounded, "gid")
    means = S.add_rolling_rows_mean(bounded, CELL, rows, value, "pm")
    means = means.withColumn("_rn", F.row_number().over(S.by_date(CELL)))
    # The first full window (row number = rows) is left out of the fit and of the output.
    means = means.withColumn("usable", (F.col("_rn") > rows) & F.col("pm").isNotNull())
    if fit == "mle":
        layout = "gid {0}, fdate {1}, usable boolean, z double, method string".format(
            *[series.schema[c].dataType.simpleString() for c in ("gid", "fdate")]
        )
        # The windows above have dealt and sorted the rows so; the sort is dropped from the plan.
        fitted = means.select("gid", "fdate", "pm", "usable").sortWithinPartitions("gid", "fdate")
        fitted = fitted.mapInArrow(_score_batches, layout)
    else:
        whole = Window.partitionBy("gid")
        x = F.when(F.col("usable") & (F.col("pm") > 0), F.col("pm"))
        stats = means.withColumn("_m", F.avg(x).over(whole)).withColumn(
            "_a", F.log("_m") - F.avg(F.log(x)).over(whole)
        )
        fitted = stats.select("*", *_thom(F.col("_a"), F.col("_m")))
        score = gamma_score(F.col("pm"), F.col("shape"), F.col("scale"))
        fitted = fitted.withColumn("z", score).withColumn("method", F.lit("thom"))
    z = F.when(~F.isnan("z"), F.col("z"))
    warm = F.lit(0.0) if compat else F.lit(None).cast("double")
    return fitted.select(
        "gid", "fdate", F.when(F.col("usable"), z).otherwise(warm).alias("value"), "method"
    )


def spi(series: DataFrame, duration: int, **options) -> DataFrame | None:
    """Standardised precipitation index from ``rainf``."""
    return standardised_index(series, duration, "rainf", **options)


def sri(series: DataFrame, duration: int, **options) -> DataFrame | None:
    """Standardised runoff index from ``runoff``."""
    return standardised_index(series, duration, "runoff", **options)


def severity(
    series: DataFrame,
    value: str = "soil_moist",
    start: str | None = None,
    end: str | None = None,
    cell: Sequence[str] = CELL,
) -> DataFrame:
    """100 minus the percentile rank of the 10-day mean among all stored dates.

    Layers must be summed beforehand; pass ``cell=['gid', 'ensemble']`` for ensembles.
    """
    smooth = series.select(*cell, "fdate", S.rolling_days_mean(F.col(value), cell, 10).alias("_s"))
    ranked = S.percentile_of_score(smooth, cell, "_s", "_pct")
    out = ranked.select(*cell, "fdate", (F.lit(100.0) - F.col("_pct")).alias("value"))
    return between(out, start, end)


def dry_spells(
    series: DataFrame,
    value: str = "rainf",
    duration: int = 14,
    recovery: int = 2,
    threshold: Callable[[Column], Column] = F.avg,
) -> DataFrame:
    """Running number of dry spells.

    The spell length grows each day and returns to zero once the last ``recovery`` days all
    exceed the cell's threshold; a spell counts when its length reaches ``duration``.
    ``threshold`` is any column aggregate.
    """
    order = S.by_date(CELL)
    base = series.select("gid", "fdate", F.col(value).alias("_v"))
    base = base.withColumn("_t", threshold(F.col("_v")).over(Window.partitionBy("gid")))
    base = base.withColumn("_rn", F.row_number().over(order))
    lowest = F.min("_v").over(order.rowsBetween(-(recovery - 1), 0))
    base = base.withColumn("_wet", (lowest > F.col("_t")) & (F.col("_rn") >= recovery))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    last_wet = F.max(F.when(F.col("_wet"), F.col("_rn"))).over(running)
    base = base.withColumn("_len", F.col("_rn") - F.coalesce(last_wet, F.lit(recovery - 1)))
    event = F.when(F.col("_len") == duration, 1).otherwise(0)
    return base.select("gid", "fdate", F.sum(event).over(running).cast("double").alias("value"))


def smdi(
    layered: DataFrame,
    value: str = "soil_moist",
    layer: int | None = 2,
    start: str | None = None,
    end: str | None = None,
    mode: str = "vector",
) -> DataFrame:
    """Soil moisture deficit index from the 7-day median of one layer.

    ``mode='vector'`` gives the numbers of a one-shot array assignment, where only the
    eighth day carries half of the day before; ``mode='recursive'`` carries half of the
    previous index on every day (a blocked scan, see ``series.half_carried``). Both are bounded to [-4, 4].
    """
    one = layered if layer is None else layered.filter(F.col("layer") == layer)
    whole = Window.partitionBy("gid")
    climate = one.select(
        "gid",
        "fdate",
        F.col(value).alias("_v"),
        F.median(value).over(whole).alias("_mid"),
        F.max(value).over(whole).alias("_max"),
    )
    period = between(climate, start, end)
    order = S.by_date(CELL)
    sw = S.rolling_days_median(F.col("_v"), CELL, 7)
    period = period.withColumn("_sw", sw).withColumn("_rn", F.row_number().over(order))
    spread = F.nullif(F.col("_max") - F.col("_mid"), F.lit(0.0))
    period = period.withColumn("_sd", (F.col("_sw") - F.col("_mid")) / spread * 100.0 / 50.0)
    ahead = F.lead("_sd", 7).over(order)
    if mode == "vector":
        carried = F.when(
            F.col("_rn") == 8, F.col("_sd") + 0.5 * F.lead("_sd", 6).over(order)
        ).otherwise(F.col("_sd"))
        raw = F.when(F.col("_rn") <= 7, ahead).otherwise(carried)
        out = period.select("gid", "fdate", raw.alias("_r"))
    else:
        kept = period.withColumn("_x", F.when(F.col("_rn") <= 7, ahead).otherwise(F.col("_sd")))
        later = kept.withColumn("_q", F.col("_rn") - 7)
        out = S.half_carried(later, "_x", "_q", "_r").select("gid", "fdate", "_r")
    limited = scalars.clip(F.col("_r"), -scalars.SMDI_LIMIT, scalars.SMDI_LIMIT)
    return out.select("gid", "fdate", limited.alias("value"))


def _dekad_score(
    daily: DataFrame,
    start: str | None,
    end: str | None,
    curve: Callable[[Column], Column] = lambda mean: mean,
) -> DataFrame:
    """Dekad means through ``curve``, standardised over all dates, carried on daily dates.

    Everything is a window over the cell: one shuffle and no join of dekads back to days.
    Mean and spread count each dekad once, at its first stored day. A dekad's score enters
    the daily series only on the day it starts, if that day is stored and in the period.
    """
    in_dekad, whole = Window.partitionBy("gid", "_dekad"), Window.partitionBy("gid")
    # Partitioned by cell up front: that serves the dekad windows and the cell windows alike.
    days = daily.repartition("gid").withColumn("_dekad", dekad_start(F.col("fdate")))
    days = days.withColumns(
        {
            "_mean": F.avg("value").over(in_dekad),
            "_first": F.col("fdate") == F.min("fdate").over(in_dekad),
        }
    )
    days = days.withColumn("_x", curve(F.col("_mean")))
    once = F.when(F.col("_first"), F.col("_x"))
    spread_of = F.nullif(F.stddev_samp(once).over(whole), F.lit(0.0))
    scored = days.select(
        "gid", "fdate", "_dekad", ((F.col("_x") - F.avg(once).over(whole)) / spread_of).alias("_z")
    )
    period = between(scored, start, end)
    entered = F.when(F.col("fdate") == F.col("_dekad"), F.col("_z"))
    return period.select("gid", "fdate", S.forward_fill(entered, CELL).alias("value"))


def suction_score(
    layered: DataFrame,
    soils: DataFrame,
    value: str = "soil_moist",
    layers: int = 3,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Standardised soil suction per day: layer sum, dekad mean, suction curve, z-score.

    ``soils`` carries (gid, ksat, depth_mm), usually the nearest soil line of each cell.
    """
    total = layered.filter(F.col("layer") < layers).groupBy("gid", "fdate").agg(
        F.sum(value).alias("value")
    )
    soil = soils.select("gid", "depth_mm", scalars.soil_class(F.col("ksat")).alias("_class"))
    head = lambda mean: scalars.suction_head(mean, F.col("depth_mm"), F.col("_class"))
    return _dekad_score(total.join(soil, "gid"), start, end, head)


def fapar_score(
    series: DataFrame, value: str = "par", start: str | None = None, end: str | None = None
) -> DataFrame:
    """Standardised dekad mean of absorbed radiation, carried on daily dates."""
    return _dekad_score(series.select("gid", "fdate", F.col(value).alias("value")), start, end)


def combined_index(spi3: DataFrame, suction: DataFrame, fapar: DataFrame) -> DataFrame:
    """Combined drought category 0..4; the highest condition that holds wins."""
    joined = (
        spi3.select("gid", "fdate", F.col("value").alias("_spi"))
        .join(suction.select("gid", "fdate", F.col("value").alias("_sma")), ["gid", "fdate"])
        .join(fapar.select("gid", "fdate", F.col("value").alias("_fpr")), ["gid", "fdate"])
    )
    return joined.select(
        "gid", "fdate", combined_level(F.col("_spi"), F.col("_sma"), F.col("_fpr")).alias("value")
    )


def combined_level(spi3: Column, suction: Column, fapar: Column) -> Column:
    deficit = F.coalesce(spi3 < -1, F.lit(False))
    stressed = F.coalesce(fapar < -1, F.lit(False))
    return (
        F.when(deficit & stressed & F.coalesce(suction > 1, F.lit(False)), 4)
        .when(deficit & stressed, 3)
        .when(deficit & F.coalesce(fapar > 1, F.lit(False)), 2)
        .when(deficit, 1)
        .otherwise(0)
    )


def index_duration(name: str, compat: bool = False) -> int:
    """Months in an index name; ``compat`` reads one digit only, so spi12 means 1."""
    digits = name[3:4] if compat else name[3:]
    return int(digits)


def run_indices(
    names: Sequence[str],
    series: DataFrame,
    layered: DataFrame | None = None,
    soils: DataFrame | None = None,
    par: DataFrame | None = None,
    fit: str = "mle",
    compat: bool = False,
    start: date | None = None,
    end: date | None = None,
    materialise: bool = False,
) -> DataFrame:
    """All requested indices as one tall table (gid, fdate, index, value).

    Each index reads its own columns. Set ``materialise`` when the inputs are aggregations
    of a larger table: they are then checkpointed once instead of being computed again for
    every index. Stored daily tables are better read directly. Indices whose period is too
    short are skipped, as are combined-index parts that are not given.
    """
    if materialise:
        shared = par is series
        series = cut_lineage(series)
        par = series if shared else par
        layered = cut_lineage(layered) if layered is not None else None
    first, last = (d.isoformat() if d else None for d in (start, end))
    options = {"fit": fit, "compat": compat, "start": start, "end": end}
    parts: list[DataFrame] = []
    for name in names:
        if name.startswith("spi") or name.startswith("sri"):
            months = index_duration(name, compat)
            part = (spi if name.startswith("spi") else sri)(series, months, **options)
        elif name == "severity":
            part = severity(series, "soil_moist", first, last)
        elif name == "dryspells":
            part = dry_spells(between(series, first, last))
        elif name == "smdi":
            part = smdi(layered, start=first, end=last)
        elif name == "cdi":
            given = soils is not None and par is not None and layered is not None
            wet = spi(series, 3, **options) if given else None
            part = None
            if wet is not None:
                part = combined_index(
                    wet,
                    suction_score(layered, soils, start=first, end=last),
                    fapar_score(par, start=first, end=last),
                )
        else:
            raise ValueError(f"unknown index {name}")
        if part is not None:
            parts.append(
                part.select(
                    "gid", "fdate", F.lit(name).alias("index"), F.col("value").cast("double")
                )
            )
    if not parts:
        raise ValueError("no index could be computed for this period")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
