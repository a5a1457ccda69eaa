"""Last-devices history: slots from an event log, cleaning, repeats and gaps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subloom.functions.dates import days_between, days_until
from subloom.functions.numeric import flag
from subloom.functions.rowwise import row_max, row_mean, row_median, row_min, row_sum

SLOTS = 5


def slot_names(stem: str, slots: int = SLOTS) -> list[str]:
    return [f"{stem}{i}" for i in range(1, slots + 1)]


UP_TIMES = slot_names("HIS_UP_TIME")


def latest_events(
    log: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], keep: int = SLOTS
) -> DataFrame:
    """The newest ``keep`` rows per key with their rank in ``slot``, from 1.

    Each task keeps at most ``keep`` rows per key before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return log.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= keep)


def slots_to_columns(
    events: DataFrame,
    keys: Sequence[str],
    stems: Mapping[str, str],
    slots: int = SLOTS,
    extra: Mapping[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """One row per key; column ``{stem}{slot}`` for each event column in ``stems``. ``extra``
    names single cells: output -> (event column, slot)."""
    cells = {f"{stem}{i}": (c, i) for c, stem in stems.items() for i in range(1, slots + 1)}
    return events.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("slot") == i, F.col(column))).alias(name)
            for name, (column, i) in {**cells, **(extra or {})}.items()
        ]
    )


def wash_history(df: DataFrame, joined: str = "INNET_DATE", clean: bool = True) -> DataFrame:
    """Where some changes fall before the join date and some after, drop the earlier ones."""
    marked = df.withColumns(
        {"min_up_time": row_min(UP_TIMES), "max_up_time": row_max(UP_TIMES)}
    ).withColumn(
        "wash_up_time",
        flag((F.col("min_up_time") < F.col(joined)) & (F.col("max_up_time") > F.col(joined))),
    )
    if not clean:
        return marked

    def kept(name: str) -> Column:
        early = (F.col("wash_up_time") == 1) & (F.col(name) < F.col(joined))
        return F.when(~F.coalesce(early, F.lit(False)), F.col(name))

    return marked.withColumns({c: kept(c) for c in UP_TIMES})


def repeat_flags(df: DataFrame, stem: str = "HIS_TERM_DESC") -> DataFrame:
    """Whether the current device equals an earlier one, and how many times."""
    names = [f"is_1{i}_repeat" for i in range(2, SLOTS + 1)]
    flags = {
        n: flag(F.col(f"{stem}1") == F.col(f"{stem}{i}")) for i, n in enumerate(names, start=2)
    }
    return df.withColumns(flags).withColumns(
        {"is_repeat": row_max(names), "is_repeat_num": row_sum(names)}
    )


def history_gaps(
    df: DataFrame,
    as_of: dt.date,
    joined: str = "INNET_DATE",
    released: str | None = "product_time",
    truth: str | None = "UP_TIME",
) -> DataFrame:
    """Days between changes, to the join date and to ``as_of``; years; the label."""
    up1, up2, up3 = (F.col(c) for c in UP_TIMES[:3])
    columns = {
        "gap_now_uptime1": days_until(up1, as_of),
        "up_gap_1_innet": days_between(up1, F.col(joined)),
        "up_gap_2_innet": days_between(up2, F.col(joined)),
        "up_gap_12": days_between(up1, up2),
        "up_gap_23": days_between(up2, up3),
        "last_year_1": F.year(up1),
        "last_year_2": F.year(up2),
    }
    if released:
        columns["gap_now_product"] = days_until(F.col(released), as_of)
    if truth:
        columns["gap_label"] = days_between(F.col(truth), up1)
    return df.withColumns(columns)


def gap_summary(df: DataFrame, gaps: Sequence[str] = ("up_gap_12", "up_gap_23")) -> DataFrame:
    """Smallest, largest, mean and median gap of each row."""
    return df.withColumns(
        {
            "up_gap_min": row_min(gaps),
            "up_gap_max": row_max(gaps),
            "up_gap_mean": row_mean(gaps),
            "up_gap_median": row_median(gaps),
        }
    )
