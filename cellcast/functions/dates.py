"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dekad_start(day: Column) -> Column:
    """First day of the dekad: the 1st, 11th or 21st of the month."""
    tens = F.least(F.floor((F.dayofmonth(day) - 1) / 10), F.lit(2))
    return F.date_add(F.trunc(day, "MM").cast("date"), (tens * 10).cast("int"))


def months_since_1960(months: Column) -> Column:
    """Forecast offsets counted in months from January 1960; fractions are dropped."""
    return F.add_months(F.lit("1960-01-01").cast("date"), months.cast("int"))


def doy_to_date(year: Column, doy: Column) -> Column:
    """Day of year (1-based) to a date."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def short_doy(day: Column) -> Column:
    """Two-digit year followed by a three-digit day of year."""
    return F.date_format(day, "yyDDD")


def in_month_range(day: Column, first: int, last: int) -> Column:
    """Month between ``first`` and ``last``; wraps over the new year when first > last."""
    month = F.month(day)
    if first <= last:
        return month.between(first, last)
    return (month >= first) | (month <= last)


def season_start(year: Column, month: int, day: int) -> Column:
    """The given month and day in another year; 29 February becomes 1 March if absent."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.lit(day - 1))


def simulation_start(planting: Column) -> Column:
    """One week before planting, unless planting falls in the first eight days of January."""
    return F.when(F.dayofyear(planting) > 8, F.date_sub(planting, 7)).otherwise(planting)


def fixed_year(day: Column) -> Column:
    """Same month and day in 2008 (when the year divides by four) or 2009."""
    year = F.when(F.year(day) % 4 == 0, F.lit(2008)).otherwise(F.lit(2009))
    return F.make_date(year, F.month(day), F.dayofmonth(day))


def date_in_text(text: Column, pattern: str = r"(\d{8})") -> Column:
    """Date written as eight digits somewhere in a file name; NULL when it is not there."""
    digits = F.regexp_extract(text, pattern, 1)
    return F.when(F.length(digits) == 8, F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))


def date_at(text: Column, position: int) -> Column:
    """Date from eight characters of ``text`` starting at a 1-based ``position``."""
    return F.try_to_timestamp(F.substring(text, position, 8), F.lit("yyyyMMdd")).cast("date")
