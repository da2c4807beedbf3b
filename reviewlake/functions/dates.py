"""Date and week helpers. Timestamps carry no zone, so results do not depend on the session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DATETIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def parse_datetime(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a zone-less timestamp; anything else becomes null."""
    return F.when(c.rlike(_DATETIME), c.try_cast("timestamp_ntz"))


def iso_weekday(c: Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(c) + 1


def week_ending_sunday(c: Column) -> Column:
    """Label of a Monday-to-Sunday week: the date of its Sunday."""
    return F.date_add(F.trunc(c.cast("date"), "week"), 6)


def next_week_of_year(week: Column) -> Column:
    return F.pmod(week, F.lit(52)) + 1


def year_month_label(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
