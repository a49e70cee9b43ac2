"""Resampling of climatology years by seasonal tercile probabilities.

Stages: season sums per coarse cell and year, rank, strata, weights, cumulative weights,
one inverse-CDF draw per cell and member, forcings of the drawn years.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions import rng
from cellcast.functions.dates import season_start

# Order of the terciles.
TERCILE_GROUPS = {"below": 1, "normal": 2, "above": 3}


def season_sums(
    cells: DataFrame, months: Sequence[int], cell: Sequence[str], value: str = "value"
) -> DataFrame:
    """Accumulation per cell and year over the chosen months."""
    season = cells.filter(F.month("fdate").isin(list(months)))
    return season.groupBy(*cell, F.year("fdate").alias("yr")).agg(F.sum(value).alias("psum"))


def rank_years(sums: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Position of each year from driest to wettest; the earlier year wins a tie."""
    order = Window.partitionBy(*cell).orderBy("psum", "yr")
    return sums.withColumn("rid", F.row_number().over(order))


def strata(ranked: DataFrame, years: int | Column) -> DataFrame:
    """Tercile group by integer division of the rank: rid div (n div 3 + 1) + 1."""
    n = F.lit(years) if isinstance(years, int) else years
    width = F.floor(n / 3) + 1
    return ranked.withColumn("pg", (F.floor(F.col("rid") / width) + 1).cast("int"))


def tercile_group(tercile: Column) -> Column:
    group = F.lit(None).cast("int")
    for name, number in TERCILE_GROUPS.items():
        group = F.when(tercile == name, number).otherwise(group)
    return group


def year_weights(
    stratified: DataFrame,
    probabilities: DataFrame,
    years: int | Column,
    cell: Sequence[str],
    lead: int = 1,
    normalise: bool = True,
) -> DataFrame:
    """Weight of each year: tercile probability spread over a third of the years.

    The strata are not quite equal, so raw weights need not add to one; ``normalise``
    rescales them per cell, which makes every draw hit a year.
    """
    n = F.lit(years) if isinstance(years, int) else years
    chance = probabilities.filter(F.col("leadtime") == lead).select(
        *cell, tercile_group(F.col("tercile")).alias("pg"), "prob"
    )
    joined = stratified.join(chance, [*cell, "pg"])
    out = joined.withColumn("weight", F.lit(1.0) / (n / F.lit(3.0)) * F.col("prob") / 100.0)
    if normalise:
        whole = Window.partitionBy(*cell)
        total = F.nullif(F.sum("weight").over(whole), F.lit(0.0))
        out = out.withColumn("weight", F.col("weight") / total)
    return out


def year_cdf(weights: DataFrame, cell: Sequence[str], closed: bool = True) -> DataFrame:
    """Cumulative weights w1 over rising psum and where each year's interval starts (w2).

    ``closed`` gives touching intervals that end at exactly one, so every draw hits a year.
    Otherwise years with equal psum share w1 and w2 = w1 - weight, which can leave gaps.
    """
    if closed:
        order = Window.partitionBy(*cell).orderBy("psum", "yr")
        running = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
        last = F.lead("yr").over(order).isNull()
        out = weights.withColumn("w1", F.when(last, F.lit(1.0)).otherwise(running))
        return out.withColumn("w2", F.coalesce(F.lag("w1").over(order), F.lit(0.0)))
    order = Window.partitionBy(*cell).orderBy("psum")
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    out = weights.withColumn("w1", F.sum("weight").over(upto))
    return out.withColumn("w2", F.col("w1") - F.col("weight"))


def draw_years(
    cdf: DataFrame, cell: Sequence[str], count: int, seed: int, portable: bool = False
) -> DataFrame:
    """One year per cell and member: the year whose interval [w2, w1) holds the draw.

    The draw of a member is shared by all cells, so neighbouring cells tend to take the
    same year. A cell's years sit in one short sorted array, so each draw is a lookup
    instead of a range join.
    """
    spans = cdf.groupBy(*cell).agg(
        F.sort_array(F.collect_list(F.struct("w1", "w2", "yr"))).alias("_spans")
    )
    drawn = spans.withColumn("ens", F.explode(F.sequence(F.lit(1), F.lit(count))))
    drawn = drawn.withColumn("_s", rng.uniform(seed, F.col("ens"), portable=portable))

    def holds(span: Column) -> Column:
        return (F.col("_s") >= span["w2"]) & (F.col("_s") < span["w1"])

    return drawn.select(
        *cell, "ens", F.get(F.filter("_spans", holds), 0)["yr"].alias("yr")
    ).filter(F.col("yr").isNotNull())


def resample(
    climatology: DataFrame,
    probabilities: DataFrame,
    months: Sequence[int],
    count: int,
    seed: int,
    cell: Sequence[str] = ("row", "col"),
    lead: int = 1,
    normalise: bool = True,
    portable: bool = False,
) -> DataFrame:
    """Whole chain from coarse daily climatology to (cell, ens, yr)."""
    cdf = resampling_cdf(climatology, probabilities, months, cell, lead, normalise)
    return draw_years(cdf, cell, count, seed, portable)


def resampling_cdf(
    climatology: DataFrame,
    probabilities: DataFrame,
    months: Sequence[int],
    cell: Sequence[str],
    lead: int = 1,
    normalise: bool = True,
) -> DataFrame:
    """Everything before the draw; the number of years is counted over the whole table."""
    sums = season_sums(climatology, months, cell)
    counted = sums.agg(F.count_distinct("yr").alias("n")).scalar()
    grouped = strata(rank_years(sums, cell), counted)
    weights = year_weights(grouped, probabilities, counted, cell, lead, normalise)
    return year_cdf(weights, cell, closed=normalise)


def drawn_forcings(
    fine: DataFrame,
    fine_to_coarse: DataFrame,
    drawn: DataFrame,
    month: int,
    day: int,
    length: int,
    cell: Sequence[str] = ("row", "col"),
) -> DataFrame:
    """Fine-grid values of the drawn years.

    ``fine_to_coarse`` maps gid to the coarse cell. Draws are turned into explicit dates
    per gid and meet the daily values on (gid, fdate).
    """
    start = season_start(F.col("yr"), month, day)
    wanted = fine_to_coarse.join(drawn, list(cell)).select("gid", "ens", "yr")
    wanted = wanted.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(length))))
    wanted = wanted.withColumn("fdate", F.date_add(start, F.col("offset")))
    return fine.join(wanted, ["gid", "fdate"])
