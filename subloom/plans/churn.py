"""Churn: will this user leave next month?"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subloom.functions.dates import month_gap, months_until
from subloom.operators.assemble import attach_features
from subloom.operators.encoding import encode_categories, one_hot
from subloom.operators.periods import PeriodSpec, period_features, single_sets, trailing_sets
from subloom.operators.profiles import user_profiles
from subloom.operators.skew import HEAVY_ROWS, find_heavy_keys
from subloom.session import write_through

SPREAD = ("mean", "max", "min", "median")
ALL_FIVE = ("sum", "mean", "max", "min", "median")

# Columns with statistics.
FEES = """TOTAL_FEE BASE_RENT_FEE DINNER_RENT_FEE FUNCATION_RENT_FEE OTHER_RENT_FEE BASE_CALL_FEE
    COUN_LONG_LFEE INTER_LONG_LFEE COUN_ROAM_BFEE INTER_ROAM_BFEE GAT_RAOM_BFEE""".split()
USAGE = """FLUX_NUM FREE_NUM BILL_NUM LOCAL_NUM ROAM_CONT_NUM ROAM_INT_NUM TOTAL_FLUX FREE_FLUX
    BILL_FLUX TOTAL_DURA FREE_DURA BILL_DURA""".split()
MONEY = "INIT_MONEY INVOICE_FEE PRINT_FEE OWE_FEE".split()
GAPS = "cycle_gap cur_end_gap cur_start_gap".split()
CATEGORIES = """CUST_TYPE AREA_ID CREDIT_CLASS IS_ACCT CERT_TYPE CUST_SEX age_bins
    CONSTELLATION_DESC""".split()
KEPT_CODES = "IS_ACCT CUST_SEX age_bins".split()


@dataclass(frozen=True)
class ChurnSettings:
    """Periods newest first, and the dates tenure and settlement gaps count to."""

    # Fixed values.
    periods: tuple[int, ...] = (201802, 201801, 201712)
    as_of: dt.date = dt.date(2018, 3, 1)
    as_of_period: int = 201803
    no_start: int = 198001
    trailing: str = "{}mon"
    single: str = "{}"

    @property
    def trailing_sets(self) -> dict[str, list]:
        return trailing_sets(self.periods, self.trailing)

    @property
    def single_sets(self) -> dict[str, list]:
        """The newest period alone is the first trailing set already."""
        return single_sets(self.periods[1:], self.single)

    @property
    def sets(self) -> dict[str, list]:
        return {**self.trailing_sets, **self.single_sets}


def amount_specs(columns: Sequence[str], settings: ChurnSettings) -> list[PeriodSpec]:
    """Fees and usage: the mean everywhere, the spread only over two periods or more."""
    wide = list(settings.trailing_sets)[1:]
    narrow = [n for n in settings.sets if n not in wide]
    return [
        spec
        for c in columns
        for spec in (PeriodSpec(c, ("mean",), narrow), PeriodSpec(c, SPREAD, wide))
    ]


def money_specs(settings: ChurnSettings, columns: Sequence[str] = MONEY) -> list[PeriodSpec]:
    return [
        PeriodSpec("DEPOSIT_MONEY", (*ALL_FIVE, "count"), labels={"count": "tr5_count"}),
        *[PeriodSpec(c, ALL_FIVE) for c in columns],
        PeriodSpec("oe_money", ALL_FIVE, list(settings.trailing_sets)),
    ]


def started(settings: ChurnSettings) -> Column:
    """Rows with a real start period; an unknown start counts as real."""
    return ~F.col("START_CYCLE_ID").eqNullSafe(F.lit(settings.no_start))


def gap_specs(settings: ChurnSettings, columns: Sequence[str] = GAPS) -> list[PeriodSpec]:
    order = ("min", "max", "median", "mean")
    known = {s: f"{{}}_{s}_nodefault" for s in order}
    return [
        spec
        for c in columns
        for spec in (
            PeriodSpec(c, order),
            PeriodSpec(
                c,
                order,
                where=started(settings),
                labels={s: text.format(c) for s, text in known.items()},
            ),
        )
    ]


def payment_specs() -> list[PeriodSpec]:
    day = {s: f"DAY_ID_{s.upper()}" for s in ("max", "min", "mean", "median")}
    return [
        PeriodSpec("RECV_FEE", (*ALL_FIVE, "count"), labels={"count": "tr6_count"}),
        PeriodSpec("DAY_ID", tuple(day), labels=day),
        *[
            PeriodSpec(c, ("nunique", "mode"), labels={"nunique": f"{c}_num", "mode": f"{c}_m"})
            for c in ("CHANNEL_ID", "PAYMENT_ID")
        ],
    ]


def with_settlement_gaps(settlements: DataFrame, settings: ChurnSettings) -> DataFrame:
    start, end = F.col("START_CYCLE_ID"), F.col("END_CYCLE_ID")
    return settlements.withColumns(
        {
            "cycle_gap": month_gap(start, end),
            "cur_end_gap": months_until(end, settings.as_of_period),
            "cur_start_gap": months_until(start, settings.as_of_period),
            "oe_money": F.col("ODD_MONEY") + F.col("EVEN_MONEY"),
        }
    )


@dataclass(frozen=True)
class Family:
    """A source table and the statistics wanted of it; how many rows it has if known, and row
    counts (key, ``rows``) if there is a cheaper way to them than counting ``rows``."""

    rows: DataFrame
    specs: Sequence[PeriodSpec]
    sets: Mapping[str, Sequence]
    row_bound: int | None = None
    counts: DataFrame | None = None


def family_features(family: Family, key: str, period_col: str, heavy_rows: int) -> DataFrame:
    """Keys too large to gather are looked for within the periods only."""
    if family.counts is not None:
        heavy = find_heavy_keys(family.counts, [key], heavy_rows, family.row_bound, "rows")
    else:
        periods = sorted({p for ps in family.sets.values() for p in ps})
        recent = family.rows.filter(F.col(period_col).isin(periods))
        heavy = find_heavy_keys(recent, [key], heavy_rows, family.row_bound)
    return period_features(family.rows, key, period_col, family.sets, family.specs, heavy)


def assemble_churn(
    users: DataFrame,
    families: Sequence[Family],
    key: str = "USER_ID",
    period_col: str = "MONTH_ID",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    features = [family_features(f, key, period_col, heavy_rows) for f in families]
    return attach_features(users, features, key)


def churn_features(
    tables: Mapping[str, DataFrame],
    settings: ChurnSettings = ChurnSettings(),
    dense: bool = False,
) -> DataFrame:
    """The whole feature table from the six extracts, one row per user.

    ``dense`` replaces the codes, but for ``KEPT_CODES``, by one-hot columns of the codes.
    """
    users = user_profiles(
        tables["t1"],
        tables["t4"].withColumnRenamed("MONTH_ID", "profile_month"),
        settings.as_of,
        [F.col("MONTH_ID").desc(), F.col("CUST_ID"), F.xxhash64(*tables["t1"].columns)],
        [F.col("profile_month").desc(), F.xxhash64(*tables["t4"].drop("MONTH_ID").columns)],
    ).drop("MONTH_ID", "profile_month")
    families = [
        Family(tables["t2"], amount_specs(FEES, settings), settings.sets),
        Family(tables["t3"], amount_specs(USAGE, settings), settings.sets),
        Family(
            with_settlement_gaps(tables["t5"], settings),
            [*money_specs(settings), *gap_specs(settings)],
            settings.sets,
        ),
        Family(tables["t6"], payment_specs(), settings.sets),
    ]
    features = write_through(assemble_churn(users, families), "churn-features")
    modes = [f"{n}_{c}_m" for n in settings.sets for c in ("CHANNEL_ID", "PAYMENT_ID")]
    columns = [*CATEGORIES, *modes]
    coded = encode_categories(features, columns)
    if not dense:
        return coded
    opened = [c for c in columns if c not in KEPT_CODES]
    return one_hot(write_through(coded, "churn-coded"), opened)
