"""What the physical plans must look like to hold up on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from subloom.operators.periods import PeriodSpec, period_features
from subloom.plans import queries, retail


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Test tables are tiny; plan as for large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, operator):
    return len(re.findall(rf"[-+:*) ]{operator}[ (\[]", text))


def test_period_features_shuffle_the_rows_once(spark, sf):
    text = plan(queries.period_fee(spark, sf))
    assert count(text, "Exchange") == 2  # bills and the user list, both by user
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan_details(
        queries.period_fee(spark, sf)
    )


def plan_details(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_only_needed_columns_are_read(spark, sf):
    text = plan_details(queries.period_usage(spark, sf))
    assert "l_comment" not in text and "l_shipdate" not in text and "l_partkey" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_same_column_is_gathered_once(spark):
    df = spark.range(10).select("id", F.lit(1).alias("p"), F.col("id").alias("v"))
    specs = [PeriodSpec("v", ("mean",), ["a"]), PeriodSpec("v", ("max",), ["b"])]
    text = plan(period_features(df, "id", "p", {"a": [1], "b": [1]}, specs))
    assert "v0" in text and "v1" not in text


def test_slots_are_pruned_before_the_shuffle(spark, sf):
    text = plan(queries.history_slots(spark, sf))
    assert count(text, "Exchange") == 1
    before_shuffle = text[text.index("Exchange hashpartitioning") :]
    assert re.search(r"WindowGroupLimit .*row_number\(\), 5, Partial", before_shuffle)


def test_profiles_are_pruned_before_the_shuffle(spark, sf):
    text = plan(retail.profiles(spark, sf))
    assert len(re.findall(r"row_number\(\), 1, Partial", text)) == 2


def test_snapshots_read_each_month_once(spark, sf):
    text = plan(queries.snapshot_rules(spark, sf))
    assert count(text, "FileScan") == 2 and count(text, "SortMergeJoin") == 1


def test_folds_need_no_shuffle(spark, sf):
    people = spark.read.parquet(f"{sf}/customer.parquet")
    assert "Exchange" not in plan(people.select(queries.fold_of(F.col("c_custkey"), 4)))
