"""Replacement date: when did the user last change phones?"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.operators.assemble import fill_constant
from subloom.operators.encoding import brand_flags, encode, fit_levels, lookup, one_hot
from subloom.operators.history import gap_summary, history_gaps, repeat_flags, wash_history
from subloom.operators.impute import fill_with_mean, fill_with_median
from subloom.operators.profiles import keep_first
from subloom.operators.snapshots import compare_snapshots
from subloom.session import write_through

# Columns kept of the device history, encoded columns, one-hot columns.
HISTORY_COLUMNS = """MSISDN gap_now_uptime1 gap_now_product up_gap_1_innet up_gap_2_innet up_gap_12
    up_gap_23 up_gap_min up_gap_max up_gap_mean up_gap_median is_apple is_huawei is_xiaomi is_vivo
    is_oppo is_samsung is_meizu is_lenovo is_leshi is_coolpad is_bbk is_Nokia is_jinli is_zte
    is_smartisan is_htc is_tianyu is_unknown HIS_IS_COPY1 is_12_repeat is_13_repeat is_14_repeat
    is_15_repeat is_repeat_num gap_label last_year_1 last_year_2 2Gratio 3Gratio 4Gratio is_sp
    HIS_UP_TIME1 HIS_FACTORY_DESC1 HIS_TERM_DESC1 UP_TIME Jan_uptime1 Feb_uptime1 1v3 2v3 11v22
    21v32 ans_13 ans_23""".split()
CATEGORIES = "CHNL_KIND_ID CUST_SEX IS_ACCT USER_STATUS IS_CARD IS_ZNZD IS_AGREE".split()
MIXED_CATEGORIES = "AREA_ID CHANNEL_TYPE CONSTELLATION_DESC".split()
DENSE = """CUST_SEX IS_ACCT USER_STATUS IS_CARD IS_AGREE IS_ZNZD last_year_1 last_year_2 AREA_ID
    CHANNEL_TYPE CONSTELLATION_DESC""".split()
NOT_FEATURES = """USER_ID CUST_ID DEVICE_NUMBER MSISDN CHNL_KIND_ID gap_label HIS_UP_TIME1
    HIS_FACTORY_DESC1 HIS_TERM_DESC1 UP_TIME INNET_DATE ans_13 ans_23 Jan_uptime1
    Feb_uptime1""".split()


@dataclass(frozen=True)
class ReplacementSettings:
    """The three snapshot months, the month billed users are taken from, and the end date."""

    # Fixed values.
    months: tuple[int, int, int] = (201801, 201802, 201803)
    bill_month: int = 201802
    as_of: dt.date = dt.date(2018, 3, 31)
    wash: bool = True


def newest_per(df: DataFrame, *keys: str) -> DataFrame:
    """The newest month's row per key. Rows that agree on month are told apart by content."""
    order = [F.col("MONTH_ID").desc(), F.xxhash64(*[c for c in df.columns if c not in keys])]
    return keep_first(df, keys, order).drop("MONTH_ID")


def device_history(
    history: DataFrame,
    bills: DataFrame,
    accounts: DataFrame,
    brand_up: DataFrame,
    phone_info: DataFrame,
    settings: ReplacementSettings,
) -> DataFrame:
    """One row per device number of the newest snapshot and user billed under it, with all
    history features. Numbers without a user keep one row; a number of several users, such as a
    placeholder, has one row for each of them."""
    compared = compare_snapshots(history, settings.months).drop("MONTH_ID")
    others = [c for c in compared.columns if c not in ("split", "MSISDN")]
    newest = keep_first(compared, ["split", "MSISDN"], [F.xxhash64(*others)])
    known = lookup(newest, brand_up, ["HIS_FACTORY_DESC1"])
    known = lookup(known, phone_info, ["HIS_FACTORY_DESC1", "HIS_TERM_DESC1"])
    owners = bills.select("split", "USER_ID", F.col("DEVICE_NUMBER").alias("MSISDN")).join(
        accounts.select("USER_ID", "INNET_DATE"), "USER_ID", "left"
    )
    joined = known.join(owners, ["split", "MSISDN"], "left")
    washed = wash_history(joined, clean=settings.wash)
    gaps = history_gaps(repeat_flags(washed), settings.as_of)
    stored = write_through(gaps, "device-history")
    filled = gap_summary(fill_with_mean(stored, ["up_gap_12", "up_gap_23"]))
    return filled.withColumns(brand_flags(F.col("BRAND_UP"))).select("split", "USER_ID", *HISTORY_COLUMNS)


def replacement_features(
    tables: Mapping[str, DataFrame],
    brand_up: DataFrame,
    phone_info: DataFrame,
    settings: ReplacementSettings = ReplacementSettings(),
    dense: bool = False,
) -> DataFrame:
    """The whole feature table, one row per billed user; ``UP_TIME`` is null in the test part."""
    bills = keep_first(
        tables["t2"].filter(F.col("MONTH_ID") == settings.bill_month),
        ["split", "USER_ID"],
        [F.xxhash64(*tables["t2"].columns)],
    ).drop("MONTH_ID")
    accounts = newest_per(tables["t3"].drop("split"), "USER_ID")
    customers = newest_per(tables["t4"].drop("split"), "CUST_ID")
    history = device_history(tables["t1"], bills, accounts, brand_up, phone_info, settings)
    joined = (
        bills.join(accounts.join(customers, "CUST_ID", "left"), "USER_ID", "left")
        .withColumn("MSISDN", F.col("DEVICE_NUMBER"))
        .join(history, ["split", "USER_ID", "MSISDN"], "left")
    )
    return encode_replacement(write_through(joined, "replacement-features"), dense)


def encode_replacement(features: DataFrame, dense: bool = False) -> DataFrame:
    """From a stored table: codes for the categories and the last fills. Missing values are a level of their own in
    ``CATEGORIES`` and stay missing in ``MIXED_CATEGORIES``, but for the constellation (-1)."""
    named = fill_constant(features, CATEGORIES, -1)
    columns = [*CATEGORIES, *MIXED_CATEGORIES]
    coded = encode(named, fit_levels(named, columns), columns)
    filled = fill_with_median(coded, ["CERT_AGE"], features, features.count())
    if dense:
        return one_hot(filled, DENSE)
    return fill_constant(filled, ["CONSTELLATION_DESC"], -1)
