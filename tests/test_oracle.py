import pytest
from compare import connect, differences

import __spark_entry__ as entry
from subloom.plans import queries
from subloom.plans.oracles import ORACLES

QUERIES = {**queries.RELATIONAL, **queries.LEARNING}


# Queries with a mean or count over everything: the tasks' partial rows meet in one task.
ONE_ROW = "q_csv_rejects q_binary_metrics q_date_error q_history_gaps q_impute_global q_replacement_table".split()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    python = () if name in queries.LEARNING else ("EvalPython",)
    for operator in ("CartesianProduct", "NestedLoopJoin", *python):
        assert operator not in plan
    assert name in ONE_ROW or "SinglePartition" not in plan
    assert differences(df, con, ORACLES[name]) == []


@pytest.mark.parametrize(
    "name", ["q_period_fee", "q_period_usage", "q_period_money", "q_gap_nodefault", "q_payment_stats"]
)
def test_large_users_equal_sql(spark, sf, con, monkeypatch, name):
    monkeypatch.setattr(queries, "HEAVY_ROWS", 12)
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


def test_every_query_is_known():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {
        "q_importance", "q_churn_gbt", "q_gap_gbt", "q_stack_reg", "q_stack_clf", "q_nested_reg",
    }


def test_entry(spark):
    assert entry.entry(spark).count() == 150
