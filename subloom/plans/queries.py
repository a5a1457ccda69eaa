"""Every operator as a query over the sample warehouse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.functions.dates import compact, days_between, days_until, month_start
from subloom.functions.numeric import age_bin, right_closed_bins, to_class
from subloom.functions.rowwise import count_present, row_mean
from subloom.learning.bagging import FoldModels, fit_folds, load_fold_models
from subloom.learning.importance import fold_importances, mean_importances
from subloom.learning.matrix import feature_matrix
from subloom.learning.members import CHURN_MEMBERS, GAP_MEMBERS
from subloom.learning.stacking import INNER_FOLDS, fit_nested, fit_stacked, load_nested
from subloom.operators import encoding
from subloom.operators.assemble import attach_features, fill_constant
from subloom.operators.correction import with_corrected_date
from subloom.operators.evaluation import (
    binary_scores,
    binary_scores_by_model,
    error_scores,
    mean_over_folds,
    roc_auc,
)
from subloom.operators.folds import fold_of
from subloom.operators.history import (
    UP_TIMES,
    gap_summary,
    history_gaps,
    latest_events,
    repeat_flags,
    slot_names,
    slots_to_columns,
    wash_history,
)
from subloom.operators.impute import fill_with_mean, fill_with_median
from subloom.operators.periods import PeriodSpec
from subloom.operators.profiles import split_by_label, tag_and_union
from subloom.operators.skew import HEAVY_ROWS
from subloom.operators.snapshots import compare_snapshots
from subloom.plans import retail, training
from subloom.plans.churn import amount_specs, assemble_churn, family_features, gap_specs
from subloom.plans.churn import money_specs, payment_specs
from subloom.plans.replacement import replacement_features
from subloom.session import work_path, write_through
from subloom.sources.delimited import allow_charset, read_checked, read_delimited, read_lookup
from subloom.sources.store import read_features, write_features, write_result
from subloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
# Outer and inner folds of the nested query; a production run has 8 and 5.
NESTED = (2, 2)


def _features(family) -> DataFrame:
    return family_features(family, "USER_ID", "MONTH_ID", HEAVY_ROWS)


def _text_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"})


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _exact_counts(features: DataFrame) -> DataFrame:
    """Sums and counts stay whole numbers; what can be missing becomes double."""
    names = [c for c in features.columns[1:] if not c.endswith(("_sum", "_count"))]
    return _as_double(features, *names)


# Period features


def period_fee(spark: SparkSession, sf: str) -> DataFrame:
    everyone = table(spark, sf, "customer").select(F.col("c_custkey").alias("USER_ID"))
    return attach_features(everyone, [_features(retail.bill_family(spark, sf))], "USER_ID")


def period_usage(spark: SparkSession, sf: str) -> DataFrame:
    specs = amount_specs(retail.USAGE, retail.YEARS)
    return _exact_counts(_features(retail.line_family(spark, sf, specs)))


def period_money(spark: SparkSession, sf: str) -> DataFrame:
    specs = money_specs(retail.YEARS, ["ODD_MONEY"])
    return _exact_counts(_features(retail.line_family(spark, sf, specs)))


def cycle_gap(spark: SparkSession, sf: str) -> DataFrame:
    specs = [s for s in gap_specs(retail.YEARS) if s.where is None]
    return _exact_counts(_features(retail.line_family(spark, sf, specs)))


def gap_nodefault(spark: SparkSession, sf: str) -> DataFrame:
    specs = [s for s in gap_specs(retail.YEARS) if s.where is not None]
    return _exact_counts(_features(retail.line_family(spark, sf, specs)))


def payment_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _exact_counts(_features(retail.payment_family(spark, sf, payment_specs()[:2])))


def _value_specs(stat: str, tag: str) -> list[PeriodSpec]:
    return [
        PeriodSpec(c, (stat,), labels={stat: f"{c}_{tag}"}) for c in ("CHANNEL_ID", "PAYMENT_ID")
    ]


def payment_nunique(spark: SparkSession, sf: str) -> DataFrame:
    return _features(retail.payment_family(spark, sf, _value_specs("nunique", "num")))


def payment_mode(spark: SparkSession, sf: str) -> DataFrame:
    out = _features(retail.payment_family(spark, sf, _value_specs("mode", "m")))
    return _as_double(out, *[c for c in out.columns if c.endswith("PAYMENT_ID_m")])


# Profiles


def user_info(spark: SparkSession, sf: str) -> DataFrame:
    started = month_start(F.col("MONTH_ID")).cast("string")
    out = retail.profiles(spark, sf).withColumn("month_start", started)
    return _as_double(out, "OPER_DATE_gap", "age_bins")


def age_bins(spark: SparkSession, sf: str) -> DataFrame:
    people = retail.customers(spark, sf).select(
        F.concat(F.lit("c"), F.col("CUST_ID").cast("string")).alias("item"),
        F.col("CERT_AGE"),
        age_bin(F.col("CERT_AGE")).cast("double").alias("bin"),
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item"),
        F.col("p_size").cast("double").alias("CERT_AGE"),
        right_closed_bins(F.col("p_size"), (0, 10, 20, 40), (1, 2, 3)).cast("double").alias("bin"),
    )
    return people.unionByName(parts)


def union_split(spark: SparkSession, sf: str) -> DataFrame:
    """Tag two sources, union them, take them apart by label and count what arrives."""
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("USER_ID"), retail.split_of(F.col("c_custkey")).alias("source")
    )
    labelled = people.join(retail.labels(spark, sf), "USER_ID", "left")
    train = labelled.filter(F.col("source") == "train").drop("source")
    test = labelled.filter(F.col("source") == "test").select("USER_ID")
    both = tag_and_union(train, test)
    parts = zip(
        ("member", "not_member", "known", "unknown"),
        (*split_by_label(both, "IS_LOST", (0, 1)), *split_by_label(both, "IS_LOST")),
    )
    tagged = [df.select("split", "IS_LOST", F.lit(name).alias("part")) for name, df in parts]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("part", "split", F.coalesce(F.col("IS_LOST"), F.lit(-1)).alias("label"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# Categories


def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    people = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation"),
            F.col("n_name").alias("nation_name"),
            F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100)).alias("balance"),
        )
    )
    return encoding.encode_categories(people, ["segment", "nation", "nation_name", "balance"])


def stable_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("channel"),
        F.get_json_object("props", "$.k").alias("payment"),
    )
    columns = ["channel", "payment"]
    return fill_constant(encoding.encode_categories(rows, columns, null_code=None), columns, -1)


def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    latest = retail.latest_orders(spark, sf)
    people = (
        table(spark, sf, "customer")
        .join(latest, F.col("c_custkey") == F.col("USER_ID"), "left")
        .select(
            "c_custkey",
            F.col("c_mktsegment").alias("segment"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        )
    )
    return encoding.one_hot(write_through(people, "statuses"), ["segment", "status"])


def brand_flags(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("HIS_FACTORY_DESC1"))
    named = encoding.lookup(parts, retail.brand_names(spark, sf), ["HIS_FACTORY_DESC1"])
    return named.withColumns(encoding.brand_flags(F.col("BRAND_UP")))


def lookup_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with what is known of their model, by (brand, model), and their supplier."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("HIS_FACTORY_DESC1"),
        F.concat_ws("/", "p_brand", "p_type").alias("HIS_TERM_DESC1"),
    )
    supplier = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"
    )
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    joined = lines.join(part, "l_partkey", "left").join(supplier, "l_suppkey", "left")
    known = encoding.lookup(
        joined, retail.phone_models(spark, sf), ["HIS_FACTORY_DESC1", "HIS_TERM_DESC1"]
    )
    return _text_dates(known)


# Device history


def history_slots(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders")
    latest = latest_events(log, ["o_custkey"], retail.newest_order()).withColumns(
        {
            "day": F.to_date("o_orderdate").cast("string"),
            "price": retail.cents(F.col("o_totalprice")).cast("double"),
        }
    )
    stems = {"day": "UP_TIME", "o_orderpriority": "TERM", "price": "PRICE"}
    wide = slots_to_columns(latest, ["o_custkey"], stems)
    return wide.withColumn("present", count_present(slot_names("UP_TIME")))


def snapshot_rules(spark: SparkSession, sf: str) -> DataFrame:
    history = retail.device_snapshots(spark, sf, with_devices=False).drop("split", "UP_TIME")
    out = compare_snapshots(history, retail.MONTHS)
    return _as_double(_text_dates(out), "utc_m1", "utc_m2")


def _newest_history(spark: SparkSession, sf: str, with_devices: bool) -> DataFrame:
    history = retail.device_snapshots(spark, sf, with_devices)
    newest = history.filter(F.col("MONTH_ID") == retail.MONTHS[2])
    joined = retail.replacement_accounts(spark, sf).select(
        F.col("USER_ID").alias("MSISDN"), "INNET_DATE"
    )
    return newest.join(joined, "MSISDN", "left")


def history_wash(spark: SparkSession, sf: str) -> DataFrame:
    out = wash_history(_newest_history(spark, sf, False))
    kept = ["MSISDN", "INNET_DATE", *UP_TIMES, "min_up_time", "max_up_time", "wash_up_time"]
    return _text_dates(out.select(kept))


def repeat_devices(spark: SparkSession, sf: str) -> DataFrame:
    out = repeat_flags(_newest_history(spark, sf, True))
    flags = [*[f"is_1{i}_repeat" for i in range(2, 6)], "is_repeat", "is_repeat_num"]
    return out.select("MSISDN", *slot_names("HIS_TERM_DESC"), *flags)


def history_gap_features(spark: SparkSession, sf: str) -> DataFrame:
    stored = write_through(
        history_gaps(
            _newest_history(spark, sf, False), retail.REPLACEMENT.as_of, released=None
        ),
        "history-gaps",
    )
    out = gap_summary(fill_with_mean(stored, ["up_gap_12", "up_gap_23"]))
    names = """gap_now_uptime1 up_gap_1_innet up_gap_2_innet up_gap_12 up_gap_23 last_year_1
        last_year_2 gap_label up_gap_min up_gap_max up_gap_mean up_gap_median""".split()
    return _as_double(out.select("MSISDN", *names), *names)


def impute_global(spark: SparkSession, sf: str) -> DataFrame:
    people = retail.customers(spark, sf).select(
        F.concat(F.lit("c"), F.col("CUST_ID").cast("string")).alias("item"), "CERT_AGE"
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item"),
        F.when(F.col("p_size") > 5, F.col("p_size")).alias("size"),
    )
    aged = fill_with_median(people, ["CERT_AGE"]).withColumnRenamed("CERT_AGE", "value")
    sized = fill_with_mean(parts, ["size"]).withColumnRenamed("size", "value")
    return aged.unionByName(sized)


# Whole feature tables


def churn_table(spark: SparkSession, sf: str) -> DataFrame:
    return churn_matrix(spark, sf).withColumn("IS_LOST", F.col("IS_LOST").cast("double"))


def churn_matrix(spark: SparkSession, sf: str) -> DataFrame:
    families = [
        retail.bill_family(spark, sf),
        retail.line_family(spark, sf),
        retail.payment_family(spark, sf),
    ]
    people = retail.users(spark, sf).drop("MONTH_ID")
    assembled = assemble_churn(people, families, heavy_rows=HEAVY_ROWS)
    features = write_through(assembled, "churn-features")
    modes = [f"{n}_{c}_m" for n in retail.WEEKS.sets for c in ("CHANNEL_ID", "PAYMENT_ID")]
    out = encoding.encode_categories(features, [*retail.CHURN_CATEGORIES, *modes])
    return _as_double(out, "OPER_DATE_gap")


def replacement_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return replacement_features(
        retail.replacement_tables(spark, sf),
        retail.brand_names(spark, sf),
        retail.phone_models(spark, sf),
        retail.REPLACEMENT,
    )


NULLABLE = """gap_now_uptime1 gap_now_product up_gap_1_innet up_gap_2_innet HIS_IS_COPY1 last_year_1
    last_year_2 gap_label is_12_repeat is_13_repeat is_14_repeat is_15_repeat is_repeat_num 1v3 2v3
    11v22 21v32 ans_13 ans_23 AREA_ID CHANNEL_TYPE MSISDN CUST_ID""".split()


def replacement_table(spark: SparkSession, sf: str) -> DataFrame:
    out = replacement_matrix(spark, sf)
    flags = [c for c in out.columns if c.startswith("is_") and c not in NULLABLE]
    return _text_dates(_as_double(out, *NULLABLE, *flags))


# Folds, correction, scores


def folds(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select(
        *[fold_of(F.col("c_custkey"), k).alias(f"fold{k}") for k in (4, 8, 5)]
    )
    sizes = [
        people.groupBy(F.lit(f"k{k}").alias("scheme"), F.col(f"fold{k}").alias("fold")).agg(
            F.count(F.lit(1)).alias("rows")
        )
        for k in (4, 8, 5)
    ]
    return reduce(DataFrame.unionByName, sizes)


def _mean_gap() -> Column:
    """The mean of a user's known gaps, 400.5 days without any: a predictor without training."""
    return F.coalesce(row_mean(["up_gap_12", "up_gap_23"]), F.lit(400.5))


def _corrected(spark: SparkSession, sf: str) -> DataFrame:
    history = retail.device_snapshots(spark, sf, with_devices=False)
    compared = compare_snapshots(history, retail.MONTHS)
    gaps = compared.withColumns(
        {
            "up_gap_12": F.date_diff("HIS_UP_TIME1", "HIS_UP_TIME2"),
            "up_gap_23": F.date_diff("HIS_UP_TIME2", "HIS_UP_TIME3"),
        }
    ).withColumn("gap", _mean_gap())
    return with_corrected_date(gaps, "gap", retail.LIMITS)


def correct_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _corrected(spark, sf).select(
        "MSISDN", "split", "gap", compact(F.col("pred_date")).alias("pred_date")
    )


def date_error(spark: SparkSession, sf: str) -> DataFrame:
    known, _ = split_by_label(_corrected(spark, sf), "UP_TIME")
    scored = write_through(
        known.select(fold_of(F.col("MSISDN"), 8).cast("string").alias("fold"), "diff"), "errors"
    )
    scores = error_scores(scored, "diff", ["fold"], scored.count())
    means = mean_over_folds(scores, ["mse", "median_abs"]).select(
        F.lit("mean").alias("fold"),
        F.lit(None).cast("double").alias("rows"),
        F.round("mean_mse", 6).alias("mse"),
        F.round("mean_median_abs", 6).alias("median_abs"),
    )
    return _as_double(scores, "rows").unionByName(means)


def _rule_score(spark: SparkSession, sf: str) -> DataFrame:
    """Label and a score without training: the longer since the last order, the likelier lost."""
    recent = retail.orders_between(spark, sf, None, retail.YEARS.as_of)
    quiet = recent.groupBy(F.col("o_custkey").alias("USER_ID")).agg(
        days_until(F.to_date(F.max("o_orderdate")), retail.YEARS.as_of).alias("quiet")
    )
    score = F.col("quiet") / (F.col("quiet") + 250.0)
    return retail.labels(spark, sf).join(quiet.withColumn("score", score), "USER_ID")


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = write_through(_rule_score(spark, sf).select("IS_LOST", "score"), "scores")
    auc = roc_auc(scored, "IS_LOST", "score")
    return binary_scores(scored, "IS_LOST", "score").withColumn("auc", F.round(F.lit(auc), 6))


def scores_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, F1, accuracy, recall and AUC of two scores in every fold; many scores are equal."""
    scored = _rule_score(spark, sf).select(
        "IS_LOST",
        fold_of(F.col("USER_ID"), training.CHURN_FOLDS).alias("fold"),
        (F.col("quiet") / (F.col("quiet") + 250.0)).alias("smooth"),
        (F.floor(F.col("quiet") / 100) / 20).alias("coarse"),
    )
    return binary_scores_by_model(scored, "IS_LOST", ["smooth", "coarse"], ["fold"])


def sparse_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of orders as a sparse vector with a place for each: its one entry."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_custkey").alias("customer")
    )
    out, _ = encoding.one_hot_vectors(write_through(orders, "order-customers"), ["customer"])
    parts = F.unwrap_udt("customer_levels")
    return out.select(
        "o_orderkey",
        "o_custkey",
        parts["size"].alias("levels"),
        F.get(parts["indices"], F.lit(0)).alias("place"),
        F.get(parts["values"], F.lit(0)).alias("value"),
    )


def bagged_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of one score per fold, then of two members, and the class at 0.5."""
    scored = _rule_score(spark, sf)
    quiet = F.col("quiet")
    fold_scores = {
        f"{m}_{i}": quiet / (quiet + (base + 50.0 * i))
        for m, base in (("slow", 300.0), ("fast", 100.0))
        for i in range(4)
    }
    members = {f"{m}_mean": row_mean([f"{m}_{i}" for i in range(4)]) for m in ("slow", "fast")}
    pair = (F.col("slow_mean") + F.col("fast_mean")) / 2
    return (
        scored.withColumns(fold_scores)
        .withColumns(members)
        .select(
            "USER_ID",
            "slow_mean",
            "fast_mean",
            pair.alias("score"),
            to_class(pair).alias("IS_LOST"),
        )
    )


# Sources and sinks

_BILL = "MONTH_ID INT, USER_ID STRING, DAY DATE, TOTAL_FEE DOUBLE, NOTE STRING"


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as headerless delimited text, by split and in two charsets, and a lookup
    with a header; read back by position with declared types, tagged and unioned."""
    rows = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("MONTH_ID"),
        F.col("o_custkey").alias("USER_ID"),
        F.when(F.col("o_orderstatus") != "P", compact(F.col("o_orderdate")))
        .otherwise("00000000")
        .alias("DAY"),
        F.when(F.col("o_orderpriority") == "5-LOW", "NaN")
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("TOTAL_FEE"),
        F.concat(F.lit("账单"), F.col("o_orderstatus")).alias("NOTE"),
        retail.split_of(F.col("o_custkey")).alias("split"),
    )
    base = work_path(spark, "extracts")
    columns = ["MONTH_ID", "USER_ID", "DAY", "TOTAL_FEE", "NOTE"]
    parts = {}
    for split, charset in (("train", "GBK"), ("test", "UTF-8")):
        allow_charset(spark, charset)
        part = rows.filter(F.col("split") == split).select(columns)
        part.write.csv(f"{base}/{split}", sep="|", encoding=charset)
        parts[split] = read_delimited(spark, f"{base}/{split}", _BILL, charset)
    names = retail.brand_names(spark, sf).limit(0).schema
    retail.brand_names(spark, sf).write.csv(f"{base}/brands", header=True)
    brands = read_lookup(spark, f"{base}/brands", names)
    both = tag_and_union(parts["train"], parts["test"])
    read = both.groupBy("split", "MONTH_ID", "NOTE").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("DAY").alias("days"),
        F.count("TOTAL_FEE").alias("fees"),
        F.sum(retail.cents(F.col("TOTAL_FEE"))).alias("cents"),
    )
    known = brands.groupBy(
        F.lit("lookup").alias("split"), F.length("BRAND_UP").alias("MONTH_ID"), F.lit("").alias("NOTE")
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("BRAND_UP").alias("days"),
        F.count("HIS_FACTORY_DESC1").alias("fees"),
        F.lit(0).cast("long").alias("cents"),
    )
    return read.unionByName(known)


_TIMED = "KEY LONG, START TIMESTAMP_NTZ, DONE TIMESTAMP_NTZ, FEE INT"


def csv_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text with times of day, some lines spoilt; read back with what could not be read
    apart: rows by reason, full days from start to end of the good ones, and the reader's own
    counts."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    start = day + F.make_dt_interval(hours=(key % 24).cast("int"))
    done = day + F.make_dt_interval(days=(key % 9).cast("int"), hours=(key * 7 % 24).cast("int"))
    shown = lambda t: F.date_format(t, "yyyyMMddHHmmss")
    spoilt = key % 50
    line = F.concat_ws(
        "|",
        key.cast("string"),
        F.when(spoilt == 1, "20181399").otherwise(shown(start)),
        F.when(spoilt.isin(1, 2), "soon").otherwise(shown(done)),
        F.when(spoilt == 3, "free").otherwise((key % 7).cast("string")),
        F.when(spoilt == 4, "more"),
    )
    path = work_path(spark, "timed")
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    extract = read_checked(spark, path, _TIMED)
    days = days_between(F.col("DONE"), F.col("START"))
    good = extract.rows.agg(
        F.lit("").alias("reason"),
        F.count("FEE").alias("rows"),
        F.sum(days).alias("days"),
        F.lit(extract.counts["rows"]).cast("long").alias("counted"),
    )
    counted = F.when(F.col("reason") == "malformed", extract.counts["malformed"]).when(
        F.col("reason").contains("START"), extract.counts["START"]
    ).when(F.col("reason") == "FEE", extract.counts["FEE"]).otherwise(
        extract.counts["DONE"] - extract.counts["START"]
    )
    bad = extract.rejects.groupBy("reason").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(None).cast("long").alias("days")
    )
    return good.unionByName(bad.withColumn("counted", counted.cast("long")))


def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A feature table partitioned by split and a headerless result, written and read back."""
    base = work_path(spark, "store")
    people = table(spark, sf, "customer").withColumn("split", retail.split_of(F.col("c_custkey")))
    write_features(people, f"{base}/features")
    test = read_features(spark, f"{base}/features", "test")
    result = test.select("c_custkey", to_class(F.col("c_acctbal"), 4500.0).alias("IS_LOST"))
    write_result(result, f"{base}/result", ["c_custkey", "IS_LOST"])
    written = read_delimited(spark, f"{base}/result", "USER_ID BIGINT, IS_LOST INT", sep=",")
    train = read_features(spark, f"{base}/features", "train").select(
        F.col("c_custkey").alias("USER_ID"), F.lit(-1).alias("IS_LOST")
    )
    return tag_and_union(train, written)


# Learning

def _churn_input(spark: SparkSession, sf: str):
    return training.churn_matrix(write_through(churn_matrix(spark, sf), "churn-coded"))


def _gap_input(spark: SparkSession, sf: str, k: int = training.GAP_FOLDS):
    stored = write_through(replacement_matrix(spark, sf), "replacement-coded")
    return training.gap_matrix(stored, k)


def importance(spark: SparkSession, sf: str) -> DataFrame:
    matrix = _churn_input(spark, sf)
    train, _ = training.churn_parts(matrix)
    models = fit_folds(train, CHURN_MEMBERS, "clf", training.CHURN_FOLDS)
    return mean_importances(fold_importances(models, matrix.names))


def churn_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold scores of the train part and bagged scores of the test part."""
    matrix = _churn_input(spark, sf)
    models, held_out = training.train_churn(matrix, CHURN_MEMBERS)
    test = training.score_churn(matrix, models)
    columns = ["USER_ID", "fold", "label", "score", "IS_LOST"]
    return tag_and_union(held_out.select(columns), test.select(columns))


def gap_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """Corrected dates: out-of-fold with their error, and bagged for the test part."""
    matrix = _gap_input(spark, sf)
    models, held_out = training.train_gap(matrix, retail.LIMITS, GAP_MEMBERS)
    test = training.score_gap(matrix, models, retail.LIMITS)
    columns = ["USER_ID", "fold", "score", compact(F.col("pred_date")).alias("pred_date")]
    return tag_and_union(held_out.select(*columns, "diff"), test.select(columns))


def stack_clf(spark: SparkSession, sf: str) -> DataFrame:
    stored = write_through(churn_matrix(spark, sf), "churn-coded")
    matrix = training.churn_matrix(stored, INNER_FOLDS)
    train, test = training.churn_parts(matrix)
    model, _ = fit_stacked(train, CHURN_MEMBERS, "clf")
    scored = model.predict(test)
    return scored.select("USER_ID", "stacked", to_class(F.col("stacked")).alias("IS_LOST"))


def stack_reg(spark: SparkSession, sf: str) -> DataFrame:
    matrix = _gap_input(spark, sf, INNER_FOLDS)
    train, test = training.gap_parts(matrix)
    model, _ = fit_stacked(training.labelled(train), GAP_MEMBERS, "reg")
    dated = with_corrected_date(model.predict(test), "stacked", retail.LIMITS, truth=None)
    return dated.select("USER_ID", "stacked", compact(F.col("pred_date")).alias("pred_date"))


def nested_reg(spark: SparkSession, sf: str) -> DataFrame:
    """Dates from stacked models in outer folds: of the train part by the model that never saw a
    row, with the error of its fold; of the test part by the mean of all outer models, saved and
    loaded again."""
    matrix = _gap_input(spark, sf, NESTED[0])
    train, test = training.gap_parts(matrix)
    model, held_out = fit_nested(training.labelled(train), "USER_ID", GAP_MEMBERS, "reg", *NESTED)
    path = work_path(spark, "nested")
    model.save(path)
    dated = write_through(with_corrected_date(held_out, "stacked", retail.LIMITS), "nested-dates")
    scores = error_scores(dated, "diff", ["fold"], dated.count())
    columns = ["USER_ID", "fold", "stacked", compact(F.col("pred_date")).alias("pred_date")]
    known = dated.select(*columns, "diff").join(
        F.broadcast(scores.select("fold", F.col("mse").alias("fold_mse"))), "fold"
    )
    later = load_nested(path).predict(test)
    later = with_corrected_date(later, "stacked", retail.LIMITS, truth=None)
    return tag_and_union(known, later.select(*columns))


def fold_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Of small boosters: how many rows of each part and fold have scores, are scored alike by
    the models loaded again, and how many features they rank."""
    key = F.col("c_custkey")
    people = table(spark, sf, "customer").select(
        key.alias("USER_ID"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        key.alias("number"),
        F.when(key % 5 != 0, (F.col("c_acctbal") > 4500).cast("int")).alias("y"),
    )
    matrix = feature_matrix(people, "USER_ID", "y", training.CHURN_FOLDS)
    train, test = split_by_label(matrix.rows, "label", (0, 1))
    few = [replace(m, rounds=3) for m in CHURN_MEMBERS]
    models = fit_folds(train, few, "clf", training.CHURN_FOLDS)
    path = work_path(spark, "fold-models")
    models.save(path)
    again = load_fold_models(path)
    ranked = mean_importances(fold_importances(again, matrix.names)).count()

    def scored(one: FoldModels, suffix: str) -> DataFrame:
        columns = ["USER_ID", "fold", "pred_broad", "pred_deep"]
        parts = one.out_of_fold(train).select(columns), one.bagged(test).select(columns)
        both = tag_and_union(*parts)
        names = ("pred_broad", "pred_deep")
        return both.withColumnsRenamed({c: f"{c}{suffix}" for c in names})

    joined = scored(models, "").join(scored(again, "_again"), ["USER_ID", "fold", "split"])
    alike = (F.col("pred_broad") == F.col("pred_broad_again")) & (
        F.col("pred_deep") == F.col("pred_deep_again")
    )
    known = F.col("pred_broad").between(0, 1) & F.col("pred_deep").between(0, 1)
    return joined.groupBy("split", "fold").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(known, 1)).alias("scored"),
        F.count(F.when(alike, 1)).alias("alike"),
        F.lit(ranked).cast("long").alias("ranked"),
    )


LEARNING: dict[str, Query] = {
    "q_importance": importance,
    "q_churn_gbt": churn_gbt,
    "q_gap_gbt": gap_gbt,
    "q_stack_reg": stack_reg,
    "q_stack_clf": stack_clf,
    "q_nested_reg": nested_reg,
    "q_fold_coverage": fold_coverage,
}

RELATIONAL: dict[str, Query] = {
    "q_period_fee": period_fee,
    "q_period_usage": period_usage,
    "q_period_money": period_money,
    "q_cycle_gap": cycle_gap,
    "q_gap_nodefault": gap_nodefault,
    "q_payment_stats": payment_stats,
    "q_payment_nunique": payment_nunique,
    "q_payment_mode": payment_mode,
    "q_user_info": user_info,
    "q_age_bins": age_bins,
    "q_union_split": union_split,
    "q_label_encode": label_encode,
    "q_stable_encode": stable_encode,
    "q_one_hot": one_hot,
    "q_brand_flags": brand_flags,
    "q_lookup_composite": lookup_composite,
    "q_history_slots": history_slots,
    "q_snapshot_rules": snapshot_rules,
    "q_history_wash": history_wash,
    "q_repeat_flags": repeat_devices,
    "q_history_gaps": history_gap_features,
    "q_impute_global": impute_global,
    "q_churn_table": churn_table,
    "q_replacement_table": replacement_table,
    "q_folds": folds,
    "q_correct_dates": correct_dates,
    "q_date_error": date_error,
    "q_binary_metrics": binary_metrics,
    "q_bagged_mean": bagged_mean,
    "q_scores_by_fold": scores_by_fold,
    "q_sparse_one_hot": sparse_one_hot,
    "q_csv_roundtrip": csv_roundtrip,
    "q_csv_rejects": csv_rejects,
    "q_store_roundtrip": store_roundtrip,
}
