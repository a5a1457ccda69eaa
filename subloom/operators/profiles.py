"""One row per user from account and customer extracts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subloom.functions.dates import compact_to_date, days_until
from subloom.functions.numeric import age_bin


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order. The order must be total, because rows
    have none of their own. Spark prunes each task to one row per key before the shuffle, so
    a key with very many rows stays cheap."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def user_profiles(
    accounts: DataFrame,
    customers: DataFrame,
    as_of: dt.date,
    account_order: Sequence[Column],
    customer_order: Sequence[Column],
) -> DataFrame:
    """Newest account row per (split, user) with the customer's profile, tenure in days and
    age bin. Customers are reduced to one row first: several rows would multiply users."""
    newest = keep_first(accounts, ["split", "USER_ID"], account_order)
    profile = keep_first(customers, ["split", "CUST_ID"], customer_order)
    joined = newest.join(profile, ["split", "CUST_ID"], "left")
    return joined.withColumns(
        {
            "INNET_DATE_gap": days_until(compact_to_date(F.col("INNET_DATE")), as_of),
            "OPER_DATE_gap": days_until(compact_to_date(F.col("OPER_DATE")), as_of),
            "CERT_AGE": F.coalesce("CERT_AGE", F.lit(-1.0)),
            "age_bins": age_bin(F.col("CERT_AGE")),
        }
    ).drop("INNET_DATE", "OPER_DATE")


def tag_and_union(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both parts in one frame, each row marked with the part it came from."""
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")), allowMissingColumns=True
    )


def split_by_label(df: DataFrame, label: str, values: Sequence[int] | None = None):
    """(labelled, unlabelled): by membership in ``values``, or by the label being present."""
    known = F.col(label).isNotNull() if values is None else F.col(label).isin(list(values))
    return df.filter(known), df.filter(~F.coalesce(known, F.lit(False)))
