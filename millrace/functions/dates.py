"""Calendar functions on DATE columns. Month and year steps clamp to the month's end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(year: Column, month: Column, day: Column) -> Column:
    """The date; null if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def is_valid(year: Column, month: Column, day: Column) -> Column:
    return make(year, month, day).isNotNull()


def parse(text: Column) -> Column:
    """YYYY-MM-DD or YYYYMMDD; null if it is neither or no date."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyyMMdd"))


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def readable(day: Column) -> Column:
    """As in 2 Oct 2018."""
    return F.date_format(day, "d MMM yyyy")


def add_days(day: Column, n: int | Column) -> Column:
    return F.date_add(day, n)


def subtract_days(day: Column, n: int | Column) -> Column:
    return F.date_sub(day, n)


def next_day(day: Column) -> Column:
    return F.date_add(day, 1)


def previous_day(day: Column) -> Column:
    return F.date_sub(day, 1)


def add_months(day: Column, n: int) -> Column:
    return F.add_months(day, n)


def add_years(day: Column, n: int) -> Column:
    return F.add_months(day, 12 * n)


def day_number(day: Column) -> Column:
    """Days since 0000-01-01, which is 1, in the proleptic Gregorian calendar."""
    return F.datediff(day, F.make_date(F.lit(0), F.lit(1), F.lit(1))) + 1


def from_day_number(n: Column) -> Column:
    return F.date_add(F.make_date(F.lit(0), F.lit(1), F.lit(1)), (n - 1).cast("int"))


def month_length(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def is_leap(day: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366


def month_of(day: Column) -> Column:
    """The first day of the month, which stands for the month."""
    return F.trunc(day, "MM").cast("date")


# --- months: DATE columns that hold the first day


def parse_month(text: Column) -> Column:
    """YYYY-MM or YYYYMM; null if it is neither or no month."""
    return F.coalesce(F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"), F.try_to_date(F.concat(text, F.lit("01")), "yyyyMMdd"))


def iso_month(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def readable_month(month: Column) -> Column:
    """As in Oct 2018."""
    return F.date_format(month, "MMM yyyy")


def step_months(month: Column, n: int | Column) -> Column:
    """n months later, or earlier if n is negative. The first day of a month never clamps."""
    return F.add_months(month, n)


def months_apart(a: Column, b: Column) -> Column:
    """How many months a is after b."""
    return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("int")
