"""Periods (``yyyymm`` integers), dates and day counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _year(period: Column) -> Column:
    return (period / 100).cast("int")


def month_start(period: Column) -> Column:
    """First day of a ``yyyymm`` period."""
    return F.make_date(_year(period), (period % 100).cast("int"), F.lit(1))


def month_gap(start: Column, end: Column) -> Column:
    """Whole months from one period to another."""
    return ((_year(end) - _year(start)) * 12 + (end % 100 - start % 100)).cast("int")


def months_until(period: Column, as_of: int) -> Column:
    """Whole months from a period to the fixed period ``as_of``."""
    return month_gap(period, F.lit(as_of))


def compact_to_date(text: Column) -> Column:
    """``yyyyMMdd`` text or integer to a date; unreadable values become null."""
    return F.try_to_date(text.cast("string"), "yyyyMMdd")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from one to the other, rounded down, below zero too: of dates their difference,
    of times the full days that have passed."""
    short = _time_of_day(later) < _time_of_day(earlier)
    return F.date_diff(later, earlier) - short.cast("int")


def _time_of_day(x: Column) -> Column:
    time = x.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.to_date(time).cast("timestamp_ntz"), time)


def days_until(day: Column, as_of: dt.date) -> Column:
    """Days from ``day`` to the fixed date ``as_of``, as ``days_between`` counts them."""
    return days_between(F.lit(as_of), day)


def add_days(day: Column, days: Column) -> Column:
    return F.date_add(day, days.cast("int"))


def cap_date(day: Column, latest: dt.date) -> Column:
    """The earlier of the two; a null day comes out as the cap."""
    return F.least(day, F.lit(latest))


def floor_date(day: Column, earliest: Column) -> Column:
    return F.greatest(day, earliest)


def compact(day: Column) -> Column:
    """Date as ``yyyyMMdd`` text."""
    return F.date_format(day, "yyyyMMdd")
