"""Comparing a user's device history across three monthly snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subloom.functions.numeric import flag
from subloom.functions.rowwise import count_present
from subloom.operators.history import UP_TIMES


def join_snapshots(
    history: DataFrame, months: Sequence, key: str = "MSISDN", period_col: str = "MONTH_ID"
) -> DataFrame:
    """The newest snapshot's rows with the change dates and counts of the two before it.

    The older months are reduced to one row per key first, combining on the map side, so a key
    with very many rows cannot multiply them; the join then has one row per key on its right.
    The two sides read different months.
    """
    jan, feb, mar = months
    month = F.col(period_col)
    counted = history.withColumn("utc", count_present(UP_TIMES))
    earlier = {}
    for n, (name, at) in enumerate((("Jan", jan), ("Feb", feb)), start=1):
        earlier[f"utc_m{n}"] = F.max(F.when(month == at, F.col("utc")))
        for i, c in enumerate(UP_TIMES, start=1):
            earlier[f"{name}_uptime{i}"] = F.max(F.when(month == at, F.col(c)))
    older = (
        counted.filter(month.isin(jan, feb))
        .groupBy(key)
        .agg(*[value.alias(name) for name, value in earlier.items()])
    )
    newest = counted.filter(month == mar).withColumnRenamed("utc", "utc_m3")
    return newest.join(older, key, "left")


def snapshot_rules() -> dict[str, Column]:
    """Rule flags over a joined snapshot row; a missing snapshot gives 0.

    ``ans_*``: the histories are shifted by one change, so the earlier snapshot's newest date
    is the answer. ``1v3``/``2v3``: a change was added since. ``11v22``/``21v32``: the same
    shift between neighbouring snapshots.
    """
    c = F.col
    return {
        "ans_13": flag(c("Jan_uptime2") == c("HIS_UP_TIME1")),
        "ans_23": flag(c("Feb_uptime2") == c("HIS_UP_TIME1")),
        "11v22": flag(c("Jan_uptime1") == c("Feb_uptime2")),
        "21v32": flag(c("Feb_uptime1") == c("HIS_UP_TIME2")),
        "1v3": flag(c("utc_m1") < c("utc_m3")),
        "2v3": flag(c("utc_m2") < c("utc_m3")),
    }


def compare_snapshots(history: DataFrame, months: Sequence, **columns: str) -> DataFrame:
    return join_snapshots(history, months, **columns).withColumns(snapshot_rules())

