"""Time-series operators on (cell, fdate, value) tables.

Every window here is partitioned by cell and needs one row per (cell, fdate), see
``common.daily_series``: a partition is then never longer than the calendar, however the
raw rows were distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions.dates import dekad_start


def by_date(cell: Sequence[str], day: str = "fdate"):
    return Window.partitionBy(*cell).orderBy(day)


def by_day_number(cell: Sequence[str], day: str = "fdate"):
    """Ordered by day number, so that range frames count calendar days."""
    return Window.partitionBy(*cell).orderBy(F.unix_date(F.col(day)))


def add_rolling_rows_mean(
    df: DataFrame, cell: Sequence[str], rows: int, value: str, name: str
) -> DataFrame:
    """Mean of the last ``rows`` rows, NULL until the window is full and free of NULLs.

    Running sums are differenced, so the cost per row does not grow with the window (a
    sliding frame would re-add up to 360 rows each time).
    """
    order = by_date(cell)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_total", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(running))
    out = out.withColumn("_seen", F.count(value).over(running))
    out = out.withColumn("_total0", F.lag("_total", rows, 0.0).over(order))
    out = out.withColumn("_seen0", F.lag("_seen", rows, 0).over(order))
    full = F.col("_seen") - F.col("_seen0") == rows
    mean = F.when(full, (F.col("_total") - F.col("_total0")) / rows)
    return out.withColumn(name, mean).drop("_total", "_seen", "_total0", "_seen0")


def rolling_days_mean(value: Column, cell: Sequence[str], days: int) -> Column:
    """Mean over the last ``days`` calendar days, partial windows allowed."""
    return F.avg(value).over(by_day_number(cell).rangeBetween(-(days - 1), 0))


def rolling_days_median(value: Column, cell: Sequence[str], days: int) -> Column:
    """Median over the last ``days`` calendar days."""
    frame = by_day_number(cell).rangeBetween(-(days - 1), 0)
    return F.percentile(value, F.lit(0.5)).over(frame)


def forward_fill(value: Column, cell: Sequence[str]) -> Column:
    """Last known value up to each date."""
    frame = by_date(cell).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(frame)


def percentile_of_score(df: DataFrame, cell: Sequence[str], value: str, name: str) -> DataFrame:
    """Percentile rank of each value in its own series; ties share the middle rank.

    With L values below and R at or below, the rank is (L + R + [R > L]) * 50 / n. NULL values
    stand last, count for nothing and have no rank.
    """
    order = Window.partitionBy(*cell).orderBy(F.col(value).asc_nulls_last())
    out = df.withColumn("_below", F.rank().over(order) - 1)
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_upto", F.count(value).over(upto))
    out = out.withColumn("_n", F.count(value).over(Window.partitionBy(*cell)))
    rank = (F.col("_below") + F.col("_upto") + 1) * 50.0 / F.col("_n")
    return out.withColumn(name, F.when(F.col(value).isNotNull(), rank)).drop("_below", "_upto", "_n")


def standardise(value: Column, cell: Sequence[str]) -> Column:
    """(x - mean) / sample standard deviation over the whole series."""
    whole = Window.partitionBy(*cell)
    spread = F.nullif(F.stddev_samp(value).over(whole), F.lit(0.0))
    return (value - F.avg(value).over(whole)) / spread


def dekad_mean(
    df: DataFrame, cell: Sequence[str], value: str = "value", day: str = "fdate"
) -> DataFrame:
    return df.groupBy(*cell, dekad_start(F.col(day)).alias("dekad")).agg(
        F.avg(value).alias(value)
    )


def gap_fill(
    df: DataFrame, cell: Sequence[str], start: Column, end: Column, fill: float, value: str = "value"
) -> DataFrame:
    """One row per cell and day from ``start`` to ``end``; missing days get ``fill``."""
    days = df.select(*cell).distinct().withColumn("fdate", F.explode(F.sequence(start, end)))
    out = days.join(df, [*cell, "fdate"], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def gap_fill_years(
    df: DataFrame, cell: Sequence[str], fill: float, value: str = "value"
) -> DataFrame:
    """Fill whole calendar years, from the first year of each cell to its last."""
    span = df.groupBy(*cell).agg(F.min("fdate").alias("_a"), F.max("fdate").alias("_b"))
    first = F.trunc("_a", "year").cast("date")
    last = F.make_date(F.year("_b"), F.lit(12), F.lit(31))
    days = span.withColumn("fdate", F.explode(F.sequence(first, last))).drop("_a", "_b")
    out = days.join(df, [*cell, "fdate"], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def thin_dates(
    df: DataFrame, dataset: Sequence[str], min_gap: int, day: str = "fdate"
) -> DataFrame:
    """Greedy thinning: keep a date when ``min_gap`` days have passed since the last kept.

    The fold runs on the distinct dates of a product, which the calendar bounds.
    """
    dates = df.groupBy(*dataset).agg(F.sort_array(F.collect_set(day)).alias("_dates"))

    def keep(kept: Column, d: Column) -> Column:
        due = (F.size(kept) == 0) | (F.datediff(d, F.try_element_at(kept, F.lit(-1))) >= min_gap)
        return F.when(due, F.concat(kept, F.array(d))).otherwise(kept)

    folded = F.aggregate("_dates", F.array().cast("array<date>"), keep)
    return dates.select(*dataset, F.explode(folded).alias(day))


def cumulative(value: Column, cell: Sequence[str]) -> Column:
    return F.sum(value).over(by_date(cell).rowsBetween(Window.unboundedPreceding, 0))


def nearest_date(
    requests: DataFrame, catalog: DataFrame, keys: Sequence[str], payload: str, day: str = "fdate"
) -> DataFrame:
    """Catalogue row closest in time to each request, in either direction.

    Both sides shrink to one row per (key, date) first; then one ordered pass finds the
    last entry before and the first after. The earlier entry wins a tie, and the smallest
    payload when one date has several. Adds ``found_<day>`` and ``payload``.
    """
    known = catalog.groupBy(*keys, day).agg(F.min(payload).alias(payload))
    known = known.withColumn("_hit", F.struct(F.col(day).alias("d"), F.col(payload).alias("p")))
    asked = requests.select(*keys, day).distinct()
    empty = F.lit(None).cast(known.schema["_hit"].dataType)
    both = known.select(*keys, day, "_hit", F.lit(False).alias("_ask")).unionByName(
        asked.select(*keys, day, empty.alias("_hit"), F.lit(True).alias("_ask"))
    )
    order = Window.partitionBy(*keys).orderBy(day)
    before = F.last("_hit", True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_hit", True).over(order.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_b", before).withColumn("_a", after).filter("_ask")
    gap_b = F.datediff(F.col(day), F.col("_b.d"))
    gap_a = F.datediff(F.col("_a.d"), F.col(day))
    use_before = F.col("_a").isNull() | (F.col("_b").isNotNull() & (gap_b <= gap_a))
    hit = F.when(use_before, F.col("_b")).otherwise(F.col("_a"))
    answers = both.withColumn("_hit", hit).select(
        *keys, day, F.col("_hit.d").alias(f"found_{day}"), F.col("_hit.p").alias(payload)
    )
    return requests.join(answers, [*keys, day], "left")


#: Rows of a block of the scan below; powers of two up to it are exact.
SCAN_BLOCK = 32


def half_carried(df: DataFrame, x: str, number: str, name: str, cell: Sequence[str] = ("gid",)) -> DataFrame:
    """``name`` = x + half of the previous row's, from row number 0 on; rows with a negative number keep x.

    Each row is the map r -> r / 2 + x. Maps are composed in blocks of ``SCAN_BLOCK`` rows: inside a block a running sum of x times
    powers of two, which are exact; then a block takes what the blocks before it carry over, each 2^-32 of
    the next one's, so that the fourth is beyond double precision. Two windows on the cell, linear in the rows. A NULL makes all later
    rows NULL. Numbers must be gapless.
    """
    keys = [F.col(c) for c in cell]
    block = F.when(F.col(number) >= 0, F.floor(F.col(number) / SCAN_BLOCK)).otherwise(F.lit(-1)).cast("long")
    at = F.when(F.col(number) >= 0, F.col(number) % SCAN_BLOCK).otherwise(F.lit(0))
    placed = df.withColumn("_b", block).withColumn("_at", at.cast("int"))
    two = F.pow(F.lit(2.0), F.col("_at"))
    inside = Window.partitionBy(*keys, "_b").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_l", F.sum(F.col(x) * two).over(inside) / two)
    ends = F.when((F.col("_at") == SCAN_BLOCK - 1) & (F.col("_b") >= 0), F.col("_l"))
    order = Window.partitionBy(*keys).orderBy("_b")
    back = lambda k: F.coalesce(F.sum(ends).over(order.rangeBetween(-k, -k)), F.lit(0.0)) * 2.0 ** (-SCAN_BLOCK * (k - 1))
    carried = (back(1) + back(2) + back(3)) / (two * 2.0)
    broken = F.max(F.when((F.col(number) >= 0) & F.col(x).isNull(), 1)).over(
        Window.partitionBy(*keys).orderBy("_b", number).rowsBetween(Window.unboundedPreceding, 0)
    )
    value = F.when(F.col(number) < 0, F.col(x)).when(broken.isNull(), F.col("_l") + carried)
    return local.withColumn(name, value).drop("_b", "_at", "_l")
