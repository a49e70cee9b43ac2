"""Ensemble statistics and forecast sampling.

Draws come from hashed keys (``functions.rng``). Members are made with ``explode`` of a
sequence and choices are looked up by index, so no product of two tables is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions import rng
from cellcast.functions.dates import in_month_range, season_start
from cellcast.operators.common import members
from cellcast.operators.series import nearest_date


def ensemble_stddev(sim: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Sample standard deviation over members; the layer belongs in ``keys``."""
    return sim.groupBy(*keys).agg(F.stddev_samp(value).alias("std"))


def ensemble_mean(sim: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return sim.groupBy(*keys).agg(F.avg(value).alias("mean"))


def ensemble_summary(sim: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, spread and size in one shuffle when more than one is wanted."""
    return sim.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )


def ensemble_size(sim: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sim.groupBy(*keys).agg(F.max("ensemble").alias("size"))


def season_years(days: DataFrame, first_month: int, last_month: int) -> DataFrame:
    """Years that have data in the season (one row per year)."""
    inside = days.filter(in_month_range(F.col("fdate"), first_month, last_month))
    return inside.select(F.year("fdate").alias("year")).distinct()


def season_days(forcing: DataFrame, month: int, day: int, length: int, cell: Sequence[str] = ("gid",)) -> DataFrame:
    """(cell, year, found): stored days of each season of ``length`` days that starts on a month and day of ``year``."""
    back = (length + 364) // 365
    rows = forcing.select(*cell, "fdate").withColumn(
        "year", F.explode(F.sequence(F.year("fdate") - back, F.year("fdate")))
    )
    at = F.datediff("fdate", season_start(F.col("year"), month, day))
    inside = rows.filter((at >= 0) & (at < length))
    # Rows of a cell and day count once; both counts combine before the shuffle.
    return inside.groupBy(*cell, "year", "fdate").agg(F.lit(1).alias("_d")).groupBy(*cell, "year").agg(F.count("*").alias("found"))


def whole_seasons(forcing: DataFrame, month: int, day: int, length: int, cell: Sequence[str] = ("gid",)) -> DataFrame:
    """Years whose season has every day for every cell of the table: the pool members may be drawn from."""
    full = season_days(forcing, month, day, length, cell).filter(F.col("found") == length)
    years = full.groupBy("year").agg(F.count("*").alias("_n"))
    cells = forcing.select(*cell).distinct().agg(F.count("*").alias("_n"))
    return years.join(cells, "_n", "left_semi").select("year")


def season_gaps(forcing: DataFrame, month: int, day: int, length: int, cell: Sequence[str] = ("gid",)) -> DataFrame:
    """(cell, year, found, missing) of every season that some cell has days of and this cell lacks days of."""
    held = season_days(forcing, month, day, length, cell)
    years = held.select("year").distinct().withColumn("_k", F.lit(1))
    cells = forcing.select(*cell).distinct().withColumn("_k", F.lit(1))
    # Years are few: a row per cell and year is what a gap report is made of.
    wanted = cells.join(F.broadcast(years), "_k").drop("_k")
    found = F.coalesce("found", F.lit(0).cast("long"))
    report = wanted.join(held, [*cell, "year"], "left").withColumn("found", found)
    return report.withColumn("missing", F.lit(length) - F.col("found")).filter("missing > 0")


def esp_years(years: DataFrame, count: int, seed: int, portable: bool = False) -> DataFrame:
    """Member to year: the years in a shuffled order, repeated until every member has one.

    The table has one row per year, so its single-partition ordering is bounded.
    """
    draw = rng.uniform(seed, F.col("year"), portable=portable)
    order = Window.partitionBy(F.lit(0)).orderBy(draw, "year")
    ranked = years.select("year", (F.row_number().over(order) - 1).alias("_i"))
    total = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    reach = F.sequence(F.col("_i") + 1, F.greatest(F.lit(count), F.col("_i") + 1), F.col("_n"))
    return total.withColumn("ensemble", F.explode(reach)).filter(
        F.col("ensemble") <= count
    ).select(F.col("ensemble").cast("int"), "year")


def member_forcings(
    forcing: DataFrame, member_years: DataFrame, month: int, day: int, length: int
) -> DataFrame:
    """Each member takes ``length`` days of its year from one month and day onward.

    Both sides carry the day offset, so the join is on (year, offset) ranges made explicit:
    the member table is exploded to dates (members x days rows) and joined on the date. Members have equal lengths
    when their years come from ``whole_seasons``; days that are not stored are left out otherwise.
    """
    start = season_start(F.col("year"), month, day)
    wanted = member_years.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    wanted = wanted.withColumn("fdate", F.date_add(start, F.col("offset")))
    return forcing.join(wanted, "fdate").select(
        "ensemble", "year", "offset", *[c for c in forcing.columns]
    )


def random_years(
    years: DataFrame, count: int, seed: int, drop_newest: bool = True, portable: bool = False
) -> DataFrame:
    """Years drawn with replacement; the newest is left out when there are others."""
    whole = Window.partitionBy(F.lit(0))
    pool = years.withColumn("_n", F.count("*").over(whole)).withColumn(
        "_new", F.max("year").over(whole)
    )
    if drop_newest:
        pool = pool.filter((F.col("_n") == 1) | (F.col("year") < F.col("_new")))
    pool = pool.select(
        "year", (F.row_number().over(whole.orderBy("year")) - 1).cast("long").alias("_i")
    )
    sized = pool.agg(F.count("*").alias("_n"))
    drawn = members(sized, count).withColumn(
        "_i", rng.pick(seed, F.col("_n"), F.col("ensemble"), portable=portable)
    )
    return drawn.join(pool, "_i").select("ensemble", "year")


def random_windows(
    member_years: DataFrame, start: Column, init_days: int
) -> DataFrame:
    """Spin-up window of each member: starts ``init_days`` before ``start`` but in the drawn
    year, and always lasts ``init_days`` days whatever leap days fall inside."""
    first = F.date_sub(start, init_days)
    moved = F.date_add(
        F.make_date(F.col("year"), F.month(first), F.lit(1)), F.dayofmonth(first) - 1
    )
    return member_years.withColumn("from_date", moved).withColumn(
        "to_date", F.date_add(moved, init_days)
    )


def draw_rows(
    pool: DataFrame,
    keys: Sequence[str],
    item: str,
    count: int,
    seed: int,
    portable: bool = False,
) -> DataFrame:
    """Draw one ``item`` per key and member, with replacement over members.

    Member e takes the item whose hash (seed, key, e, item) is lowest: every item is equally
    likely and members are independent. This is a plain minimum with map-side combine, so
    a key with a third of all rows needs no ranking in one task. Repeated items count once.
    """
    out = members(pool.select(*keys, item), count)
    draw = rng.uniform(
        seed, *[F.col(k) for k in keys], F.col("ensemble"), F.col(item), portable=portable
    )
    best = out.groupBy(*keys, "ensemble").agg(F.min(F.struct(draw.alias("_u"), item)).alias("_b"))
    return best.select(*keys, "ensemble", F.col(f"_b.{item}").alias(item))


def state_by_month(
    catalog: DataFrame, keys: Sequence[str], month: int, count: int, seed: int, portable: bool = False
) -> DataFrame:
    """Draw saved states of one calendar month with replacement, ``count`` per key."""
    pool = catalog.filter(F.month("fdate") == month)
    return draw_rows(pool, keys, "filename", count, seed, portable)


def warm_up_choice(requests: DataFrame, catalog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nearest saved state per request and the date the simulator must start from.

    No state, or one older than a year: start one year before the request without a state.
    """
    found = nearest_date(requests, catalog, keys, "filename")
    year_before = F.add_months(F.col("fdate"), -12)
    got = F.col("found_fdate")
    return found.select(
        *keys,
        "fdate",
        F.when(got >= year_before, F.col("filename")).alias("filename"),
        F.when(got.isNull() | (got < year_before), year_before).otherwise(got).alias("start"),
    )


def perturb(
    forcing: DataFrame,
    count: int,
    seed: int,
    precip_error: float = 0.25,
    temp_error: float = 2.0,
    portable: bool = False,
    original: str | None = None,
) -> DataFrame:
    """Members with perturbed weather.

    Positive precipitation p becomes N(p, 0.25 p); mean temperature gets N(0, 2) and each
    extreme is mirrored about it from the original other extreme. Wind is unchanged.
    ``original`` names a further column for the unperturbed precipitation, which saves a join back to it.
    """
    out = members(forcing, count)
    at = [F.col("gid"), F.col("fdate"), F.col("ensemble")]
    zp = rng.normal(f"{seed}p", *at, portable=portable)
    zt = rng.normal(f"{seed}t", *at, portable=portable)
    wet = F.col("prec") + F.abs(F.col("prec") * precip_error) * zp
    out = out.withColumn("_mean", 0.5 * (F.col("tmax") + F.col("tmin")) + temp_error * zt)
    return out.select(
        "gid",
        "fdate",
        "ensemble",
        F.when(F.col("prec") > 0, wet).otherwise(F.col("prec")).alias("prec"),
        (2.0 * F.col("_mean") - F.col("tmin")).alias("tmax"),
        (2.0 * F.col("_mean") - F.col("tmax")).alias("tmin"),
        "wind",
        *([F.col("prec").alias(original)] if original else []),
    )


def interior_years(years: DataFrame) -> DataFrame:
    """Drop the first and last year when there are more than two."""
    whole = Window.partitionBy(F.lit(0))
    marked = years.select(
        "year",
        F.count("*").over(whole).alias("_n"),
        F.min("year").over(whole).alias("_a"),
        F.max("year").over(whole).alias("_b"),
    )
    inner = (F.col("year") > F.col("_a")) & (F.col("year") < F.col("_b"))
    return marked.filter((F.col("_n") <= 2) | inner).select("year")


def rebuild_temperature(
    forecast: DataFrame, history: DataFrame, year: DataFrame, start: Column
) -> DataFrame:
    """Daily extremes of a forecast mean temperature.

    ``forecast`` carries (gid, fdate, ensemble, temp); the range tmax - tmin and the wind
    come from the same day offset of one past year (``year``, a one-row table). Days that the past
    year lacks stay, with NULL extremes and wind.
    """
    ahead = forecast.withColumn("offset", F.datediff(F.col("fdate"), start))
    first = F.date_add(F.make_date(F.year("fdate"), F.month(start), F.lit(1)), F.dayofmonth(start) - 1)
    # A window that runs over new year belongs to the year it started in.
    base = F.when(first > F.col("fdate"), F.add_months(first, -12)).otherwise(first)
    past = history.withColumn("year", F.year(base)).withColumn(
        "offset", F.datediff(F.col("fdate"), base)
    )
    past = past.join(year.select("year"), "year", "left_semi")
    both = ahead.join(past.select("gid", "offset", "tmax", "tmin", "wind"), ["gid", "offset"], "left")
    half = 0.5 * (F.col("tmax") - F.col("tmin"))
    return both.select(
        "gid",
        "fdate",
        "ensemble",
        (F.col("temp") + half).alias("tmax"),
        (F.col("temp") - half).alias("tmin"),
        "wind",
    )


def pick_year(years: DataFrame, seed: int, portable: bool = False) -> DataFrame:
    """One year at random, as a one-row table."""
    draw = rng.uniform(seed, F.col("year"), portable=portable)
    return years.agg(F.min_by("year", F.struct(draw, F.col("year"))).alias("year"))


def cycle_variants(
    variants: DataFrame,
    required: Sequence[str],
    order: Sequence[str],
    count: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Repeat the valid variants in turn until there are ``count`` members per key.

    Variants with a missing required parameter are dropped. Only the first ``count`` valid
    variants of a key can ever be used, so the rank is cut there.
    """
    valid = variants.dropna(subset=list(required))
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    ranked = valid.withColumn("_i", F.row_number().over(window)).filter(F.col("_i") <= count)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    sized = ranked.withColumn("_n", F.count("*").over(whole))
    turns = F.sequence(F.col("_i"), F.lit(count), F.col("_n").cast("int"))
    return sized.withColumn("ensemble", F.explode(turns)).drop("_i", "_n")


def member_source(sources: Sequence[str], count: int, member: Column) -> Column:
    """Name of the data set a member uses: the list is cycled over the members."""
    names = F.array(*[F.lit(s) for s in sources])
    del count
    return F.get(names, F.pmod(member - 1, F.lit(len(sources))).cast("int"))


def multi_source_ensemble(cells: DataFrame, sources: Sequence[str], count: int) -> DataFrame:
    """Member k reads the k-th data set of a cycled list; one pass over the wanted sets."""
    wanted = cells.filter(F.col("dataset").isin(list(sources)))
    out = members(wanted, count)
    return out.filter(F.col("dataset") == member_source(sources, count, F.col("ensemble")))
