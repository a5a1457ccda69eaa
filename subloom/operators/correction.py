"""From a predicted gap in days to a date that obeys the snapshot rules."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subloom.functions.dates import add_days, cap_date, days_between, floor_date
from subloom.functions.numeric import half_even


@dataclass(frozen=True)
class DateLimits:
    """Range of valid dates, and the earliest date once a rule tells the month."""

    # Fixed values.
    first: dt.date = dt.date(2012, 5, 22)
    last: dt.date = dt.date(2018, 3, 31)
    second_month: dt.date = dt.date(2018, 2, 15)
    third_month: dt.date = dt.date(2018, 3, 15)


def earliest_date(limits: DateLimits) -> Column:
    is_set = lambda name: F.col(name) == 1
    return (
        F.when(is_set("2v3") | is_set("21v32"), F.lit(limits.third_month))
        .when(is_set("1v3") | is_set("11v22"), F.lit(limits.second_month))
        .otherwise(F.lit(limits.first))
    )


def corrected_date(gap: Column, limits: DateLimits, base: str = "HIS_UP_TIME1") -> Column:
    """base + rounded gap, capped, floored, then replaced where a snapshot holds the answer."""
    guess = cap_date(add_days(F.col(base), half_even(gap)), limits.last)
    bounded = floor_date(guess, earliest_date(limits))
    return (
        F.when(F.col("ans_23") == 1, F.col("Feb_uptime1"))
        .when(F.col("ans_13") == 1, F.col("Jan_uptime1"))
        .otherwise(bounded)
    )


def with_corrected_date(
    df: DataFrame, gap: str, limits: DateLimits, truth: str | None = "UP_TIME"
) -> DataFrame:
    """Adds ``pred_date`` and, where the truth is a column, the error in days ``diff``."""
    out = df.withColumn("pred_date", corrected_date(F.col(gap), limits))
    if truth is None:
        return out
    return out.withColumn("diff", days_between(F.col(truth), F.col("pred_date")))
