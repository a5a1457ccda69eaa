"""The sample warehouse seen as subscriber data.

Customers are users, orders are bills and device changes, order lines are usage and
settlements, events are payments, parts are device models. Money is in whole cents, so sums
are exact and do not depend on the order in which tasks finish.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.functions.dates import compact
from subloom.operators.folds import fold_of
from subloom.operators.history import latest_events, slots_to_columns
from subloom.operators.profiles import user_profiles
from subloom.plans.churn import ChurnSettings, Family, amount_specs, gap_specs, money_specs
from subloom.plans.churn import payment_specs, with_settlement_gaps
from subloom.plans.replacement import ReplacementSettings
from subloom.operators.correction import DateLimits
from subloom.session import materialize
from subloom.sources.tables import table

YEARS = ChurnSettings(
    periods=(2000, 1999, 1998),
    as_of=dt.date(2001, 1, 1),
    as_of_period=200101,
    trailing="p{}",
    single="y{}",
)
# Year, month and week of the month, newest first.
WEEKS = replace(YEARS, periods=(2024015, 2024014, 2024013, 2024012, 2024011), single="w{}")
USAGE = ("quantity", "price", "discount", "tax")
CHURN_CATEGORIES = ("CREDIT_CLASS", "IS_ACCT", "AREA_ID", "CERT_TYPE", "CONSTELLATION_DESC", "age_bins")

SNAPSHOTS = {199606: dt.date(1996, 6, 30), 199612: dt.date(1996, 12, 31), 199706: dt.date(1997, 6, 30)}
MONTHS = tuple(SNAPSHOTS)
REPLACEMENT = ReplacementSettings(months=MONTHS, bill_month=MONTHS[1], as_of=SNAPSHOTS[199706])
LIMITS = DateLimits(
    first=dt.date(1995, 6, 1),
    last=dt.date(1997, 6, 30),
    second_month=dt.date(1996, 10, 1),
    third_month=dt.date(1997, 4, 1),
)
# Brand names given to the part brands, by number.
BRAND_NAMES = """** 苹果 华为 荣耀 小米 vivo oppo 三星 魅族 联想 乐视 酷派 步步高 诺基亚 Nokia 金立 中兴 锤子
    HTC 天语 其他""".split()


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def moment(day: dt.date) -> Column:
    """A literal of the tables' own timestamp type, so that filters reach the scan."""
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def split_of(key: Column) -> Column:
    return F.when(fold_of(key, 5, seed=1) == 4, "test").otherwise("train")


def orders_between(spark: SparkSession, sf: str, first: dt.date | None, end: dt.date | None):
    orders = table(spark, sf, "orders")
    day = F.col("o_orderdate")
    if first:
        orders = orders.filter(day >= moment(first))
    return orders.filter(day < moment(end)) if end else orders


def _year_range(settings: ChurnSettings) -> tuple[dt.date, dt.date]:
    years = settings.periods
    return dt.date(min(years), 1, 1), dt.date(max(years) + 1, 1, 1)


def bills(spark: SparkSession, sf: str) -> DataFrame:
    return orders_between(spark, sf, *_year_range(YEARS)).select(
        F.col("o_custkey").alias("USER_ID"),
        F.year("o_orderdate").alias("MONTH_ID"),
        cents(F.col("o_totalprice")).alias("TOTAL_FEE"),
    )


def _month(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Usage and settlement columns of every order line in the years."""
    orders = orders_between(spark, sf, *_year_range(YEARS)).select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderpriority"
    )
    joined = table(spark, sf, "lineitem").join(orders, "l_orderkey")
    price, discount, tax = (F.col(f"l_{c}") for c in ("extendedprice", "discount", "tax"))
    unknown = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("l_returnflag") == "N")
    settled = joined.select(
        F.col("o_custkey").alias("USER_ID"),
        F.year("o_orderdate").alias("MONTH_ID"),
        F.col("l_quantity").cast("long").alias("quantity"),
        cents(price).alias("price"),
        cents(discount).alias("discount"),
        cents(tax).alias("tax"),
        cents(price).alias("DEPOSIT_MONEY"),
        (cents(price) * cents(discount)).alias("ODD_MONEY"),
        F.when(F.col("l_returnflag") != "R", cents(price) * cents(tax)).alias("EVEN_MONEY"),
        F.when(F.col("o_orderpriority") == "5-LOW", YEARS.no_start)
        .when(~unknown, _month(F.col("o_orderdate")))
        .alias("START_CYCLE_ID"),
        _month(F.col("l_shipdate")).alias("END_CYCLE_ID"),
    )
    return with_settlement_gaps(settled, YEARS)


def payments(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("ts")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("USER_ID"),
        (_month(F.col("ts")) * 10 + ((day - 1) / 7).cast("int") + 1).alias("MONTH_ID"),
        day.alias("DAY_ID"),
        F.col("event_type").alias("CHANNEL_ID"),
        F.get_json_object("props", "$.k").cast("int").alias("PAYMENT_ID"),
        cents(F.col("value")).alias("RECV_FEE"),
    )


def row_count(spark: SparkSession, sf: str, name: str) -> int:
    """From the Parquet footers."""
    return table(spark, sf, name).count()


def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per user, counted per order before the join."""
    orders = orders_between(spark, sf, *_year_range(YEARS)).select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("USER_ID")
    )
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"))
    return per_order.join(orders, "l_orderkey")


def bill_family(spark: SparkSession, sf: str) -> Family:
    specs = amount_specs(["TOTAL_FEE"], YEARS)
    return Family(bills(spark, sf), specs, YEARS.sets, row_count(spark, sf, "orders"))


def line_family(spark: SparkSession, sf: str, specs=None) -> Family:
    """Usage and settlements come from the same rows, so they share one pass."""
    if specs is None:
        specs = [
            *amount_specs(USAGE, YEARS),
            *money_specs(YEARS, ["ODD_MONEY"]),
            *gap_specs(YEARS),
        ]
    bound = row_count(spark, sf, "lineitem")
    return Family(lines(spark, sf), specs, YEARS.sets, bound, line_counts(spark, sf))


def payment_family(spark: SparkSession, sf: str, specs=None) -> Family:
    return Family(
        payments(spark, sf), specs or payment_specs(), WEEKS.sets, row_count(spark, sf, "events")
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            split_of(F.col("c_custkey")).alias("split"),
            F.col("c_custkey").alias("CUST_ID"),
            F.col("n_name").alias("AREA_ID"),
            F.col("r_name").alias("CERT_TYPE"),
            F.col("c_mktsegment").alias("CONSTELLATION_DESC"),
            F.when(F.col("c_mktsegment") != "MACHINERY", (F.col("c_acctbal") + 1000) / 100).alias(
                "CERT_AGE"
            ),
        )
    )


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: the account as it stood that month."""
    day = F.col("o_orderdate")
    return orders_between(spark, sf, None, YEARS.as_of).select(
        split_of(F.col("o_custkey")).alias("split"),
        F.col("o_custkey").alias("USER_ID"),
        F.col("o_custkey").alias("CUST_ID"),
        F.col("o_orderkey").alias("sequence"),
        _month(day).alias("MONTH_ID"),
        F.col("o_orderpriority").alias("CREDIT_CLASS"),
        F.col("o_orderstatus").alias("IS_ACCT"),
        cents(F.col("o_totalprice")).alias("SCORE_VALUE"),
        compact(day).alias("INNET_DATE"),
        F.when(F.col("o_orderstatus") == "P", "00000000").otherwise(compact(day)).alias("OPER_DATE"),
    )


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return user_profiles(
        accounts(spark, sf),
        customers(spark, sf),
        YEARS.as_of,
        [F.col(c).desc() for c in ("MONTH_ID", "INNET_DATE", "sequence")],
        [F.col("CERT_AGE").desc()],
    ).drop("sequence")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Users billed before the as-of date; lost if none of their orders came after it."""
    orders = table(spark, sf, "orders")
    late = F.col("o_orderdate") >= moment(YEARS.as_of)
    return (
        orders.groupBy(F.col("o_custkey").alias("USER_ID"))
        .agg(F.count(F.when(late, 1)).alias("after"), F.count(F.when(~late, 1)).alias("before"))
        .filter("before > 0")
        .select("USER_ID", F.when(F.col("after") == 0, 1).otherwise(0).alias("IS_LOST"))
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles with the label, which only the train part knows."""
    known = F.when(F.col("split") == "train", F.col("IS_LOST"))
    return profiles(spark, sf).join(labels(spark, sf), "USER_ID", "left").withColumn("IS_LOST", known)


def devices(spark: SparkSession, sf: str, events: DataFrame) -> DataFrame:
    """The device of each order in ``events``: the part of its first line."""
    first_line = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min(F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("line"))
        .select("o_orderkey", F.col("line.l_partkey").alias("p_partkey"), "line.l_returnflag")
    )
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_brand").alias("factory"),
        F.concat_ws("/", "p_brand", "p_type").alias("term"),
    )
    return (
        events.join(first_line, "o_orderkey", "left")
        .join(part, "p_partkey", "left")
        .withColumn("is_copy", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    )


def newest_order() -> list[Column]:
    return [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]


def snapshot_events(spark: SparkSession, sf: str) -> DataFrame:
    """Slots 0..5 of each user at each snapshot: slot 0 of the newest is the hidden answer."""
    day = F.to_date("o_orderdate")
    log = orders_between(spark, sf, None, SNAPSHOTS[199706] + dt.timedelta(days=1)).select(
        F.col("o_custkey").alias("MSISDN"),
        "o_orderkey",
        "o_orderdate",
        F.explode(
            F.array_compact(
                F.array(*[F.when(day <= F.lit(end), F.lit(m)) for m, end in SNAPSHOTS.items()])
            )
        ).alias("MONTH_ID"),
    )
    latest = latest_events(log, ["MSISDN", "MONTH_ID"], newest_order(), keep=6)
    hidden = F.when(F.col("MONTH_ID") == MONTHS[2], 1).otherwise(0)
    return (
        latest.withColumn("slot", F.col("slot") - hidden)
        .filter("slot <= 5")
        .withColumn("day", day)
    )


def device_snapshots(spark: SparkSession, sf: str, with_devices: bool = True) -> DataFrame:
    """Wide device history, one row per user and snapshot; the answer only in the train part."""
    events = snapshot_events(spark, sf)
    stems = {"day": "HIS_UP_TIME"}
    if with_devices:
        events = devices(spark, sf, events)
        stems |= {"factory": "HIS_FACTORY_DESC", "term": "HIS_TERM_DESC", "is_copy": "HIS_IS_COPY"}
    wide = slots_to_columns(events, ["MSISDN", "MONTH_ID"], stems, extra={"UP_TIME": ("day", 0)})
    split = split_of(F.col("MSISDN"))
    return wide.withColumns({"split": split, "UP_TIME": F.when(split == "train", F.col("UP_TIME"))})


def half_year_bills(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    first, second, third = SNAPSHOTS
    month = (
        F.when(day <= F.lit(SNAPSHOTS[first]), first)
        .when(day <= F.lit(SNAPSHOTS[second]), second)
        .otherwise(third)
    )
    return (
        orders_between(spark, sf, None, SNAPSHOTS[third] + dt.timedelta(days=1))
        .groupBy(F.col("o_custkey").alias("USER_ID"), month.alias("MONTH_ID"))
        .agg(
            F.sum(cents(F.col("o_totalprice"))).cast("double").alias("ACCT_FEE"),
            F.max("o_orderstatus").alias("IS_CARD"),
            F.min("o_orderpriority").alias("IS_ZNZD"),
            F.when(F.count(F.lit(1)) > 1, "Y").alias("IS_AGREE"),
        )
        .withColumns({"DEVICE_NUMBER": F.col("USER_ID"), "split": split_of(F.col("USER_ID"))})
    )


def join_day(balance: Column) -> Column:
    """A join date spread over the order years by account balance."""
    return F.date_add(F.lit(dt.date(1995, 1, 1)), F.floor((balance + 1000) / 10).cast("int"))


def replacement_accounts(spark: SparkSession, sf: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.lit(MONTHS[2]).alias("MONTH_ID"),
        split_of(F.col("c_custkey")).alias("split"),
        F.col("c_custkey").alias("USER_ID"),
        F.col("c_custkey").alias("CUST_ID"),
        cents(balance).cast("double").alias("SCORE_VALUE"),
        F.col("c_mktsegment").alias("IS_ACCT"),
        F.when(balance < 0, "debt").when(balance > 5000, "rich").alias("USER_STATUS"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey").cast("string")).alias(
            "CHANNEL_TYPE"
        ),
        join_day(balance).alias("INNET_DATE"),
        F.month(join_day(balance)).cast("double").alias("INNET_MONTHS"),
    )


def replacement_customers(spark: SparkSession, sf: str) -> DataFrame:
    person = customers(spark, sf)
    return person.select(
        F.lit(MONTHS[2]).alias("MONTH_ID"),
        "split",
        "CUST_ID",
        F.col("CERT_TYPE").alias("CHNL_KIND_ID"),
        F.when(F.col("CERT_AGE") > 20, F.col("AREA_ID")).alias("AREA_ID"),
        F.when(F.col("CERT_AGE") > 50, "f").when(F.col("CERT_AGE") > 10, "m").alias("CUST_SEX"),
        F.col("CERT_AGE"),
        F.when(F.col("CERT_AGE") <= 90, F.col("CONSTELLATION_DESC")).alias("CONSTELLATION_DESC"),
    )


def brand_names(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup: part brand -> brand name."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    names = F.array(*[F.lit(n) for n in BRAND_NAMES])
    brands = table(spark, sf, "part").select("p_brand").distinct()
    return materialize(
        brands.select(
            F.col("p_brand").alias("HIS_FACTORY_DESC1"),
            F.get(names, number % len(BRAND_NAMES)).alias("BRAND_UP"),
        )
    )


def phone_models(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup: (brand, model) -> release date and shares of part sizes."""
    share = lambda c: (F.count(F.when(c, 1)) / F.count(F.lit(1)))
    size = F.col("p_size")
    models = (
        table(spark, sf, "part")
        .groupBy(
            F.col("p_brand").alias("HIS_FACTORY_DESC1"),
            F.concat_ws("/", "p_brand", "p_type").alias("HIS_TERM_DESC1"),
        )
        .agg(
            F.date_add(F.lit(dt.date(1994, 1, 1)), F.min("p_size") * 20).alias("product_time"),
            share(size <= 10).alias("2Gratio"),
            share((size > 10) & (size <= 30)).alias("3Gratio"),
            share(size > 30).alias("4Gratio"),
            F.max(F.when(size > 45, 1.0).otherwise(0.0)).alias("is_sp"),
        )
    )
    return materialize(models)


def replacement_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "t1": device_snapshots(spark, sf),
        "t2": half_year_bills(spark, sf),
        "t3": replacement_accounts(spark, sf),
        "t4": replacement_customers(spark, sf),
    }


def latest_orders(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    newest = latest_events(log, ["o_custkey"], newest_order(), keep=1)
    return newest.select(F.col("o_custkey").alias("USER_ID"), "o_orderstatus")
