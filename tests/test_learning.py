from dataclasses import replace

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from subloom.learning.bagging import fit_folds, load_fold_models, node_table
from subloom.learning.importance import fold_importances, mean_importances
from subloom.learning.matrix import feature_matrix
from subloom.learning.members import CHURN_MEMBERS, GAP_MEMBERS, Member, best_round
from subloom.learning.stacking import fit_nested, fit_stacked, load_nested, load_stacked
from subloom.operators.correction import DateLimits
from subloom.operators.evaluation import error_scores, roc_auc
from subloom.operators.folds import fold_of
from subloom.operators.profiles import split_by_label
from subloom.plans import training

MEMBERS = (
    Member("broad", step=0.3, leaves=6, min_rows=5, columns=0.8, sample=0.9, redraw=5, rounds=12),
    Member("deep", step=0.3, depth=4, penalty=1.0, rounds=12),
)


@pytest.fixture(scope="module")
def signal(spark):
    """Two features decide the label, one is noise, one is often missing; some have no label."""
    bits = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(100)).cast("double")
    df = spark.range(400).select(
        "id", bits("a").alias("a"), bits("b").alias("b"), bits("c").alias("noise"),
        F.when(bits("d") > 40, bits("d")).alias("holes"),
    )
    gap = F.col("a") * 2 + F.col("b") + F.when(F.col("holes").isNull(), 50.0).otherwise(0.0)
    known = F.col("id") < 320
    return df.select(
        "*", F.when(known, gap).alias("gap"), F.when(known, (gap > 160).cast("int")).alias("lost")
    )


@pytest.fixture(scope="module")
def clf(signal):
    return feature_matrix(signal, "id", "lost", 4, exclude=["gap"])


@pytest.fixture(scope="module")
def reg(signal):
    return feature_matrix(signal, "id", "gap", 4, exclude=["lost"])


def error(df, column):
    return df.agg(F.avg(F.pow(F.col(column) - F.col("label"), F.lit(2)))).first()[0]


def spread(df):
    return df.agg(F.var_pop("label")).first()[0]


def test_matrix(clf):
    assert clf.names == ("a", "b", "noise", "holes")
    assert clf.rows.count() == 400
    assert sorted(r["fold"] for r in clf.rows.select("fold").distinct().collect()) == [0, 1, 2, 3]
    assert clf.fold(2).filter("fold <> 2").count() == 0


def test_classifier(spark, clf, tmp_path):
    train, _ = training.churn_parts(clf)
    models, held_out = training.train_churn(clf, MEMBERS)
    assert held_out.count() == held_out.select("id").distinct().count() == 320
    assert roc_auc(held_out, "label", "score") > 0.8
    scores = training.churn_fold_scores(held_out).collect()
    assert sorted(r["fold"] for r in scores) == [0, 1, 2, 3]
    assert sum(r["rows"] for r in scores) == 320 and min(r["f1"] for r in scores) > 0.5
    test = training.score_churn(clf, models).collect()
    assert len(test) == 80
    for r in test:
        parts = [r[f"{m.name}_{i}"] for m in MEMBERS for i in range(4)]
        assert r["score"] == pytest.approx(sum(parts) / 8)
        assert r["IS_LOST"] == int(r["score"] >= 0.5)
    models.save(f"{tmp_path}/m")
    again = load_fold_models(f"{tmp_path}/m")
    columns = ["id", "pred_broad", "pred_deep"]
    assert sorted(again.out_of_fold(train).select(columns).collect()) == sorted(
        held_out.select(columns).collect()
    )


def test_importances(spark, clf):
    models = fit_folds(training.labelled(clf.rows), MEMBERS, "clf", 4, early_stop=False)
    assert {len(m.trees) for m in models.flat()} == {12}
    nodes = node_table(spark, models.flat()).filter("feature >= 0").groupBy("model", "feature").count()
    walked = {(r["model"], r["feature"]): r["count"] for r in nodes.collect()}
    counts = fold_importances(models, clf.names, "splits").collect()
    for r in counts:
        at = ["broad", "deep"].index(r["member"]) * 4 + r["fold"], clf.names.index(r["feature"])
        assert r["importance"] == walked.get(at, 0)
    means = mean_importances(fold_importances(models, clf.names)).collect()
    by_name = {(r["member"], r["feature"]): r["importance"] for r in means}
    assert set(by_name) == {(m.name, f) for m in MEMBERS for f in clf.names}
    assert by_name["deep", "a"] > by_name["deep", "noise"]
    assert sum(v for (m, _), v in by_name.items() if m == "deep") == pytest.approx(1.0)
    assert [r["importance"] for r in means] == sorted((r["importance"] for r in means), reverse=True)


def test_regression_and_dates(signal):
    dated = signal.select("*", F.date_add(F.lit("2017-01-01"), F.lit(0)).alias("HIS_UP_TIME1"))
    dated = dated.withColumn("UP_TIME", F.date_add("HIS_UP_TIME1", F.col("gap").cast("int")))
    rules = {c: F.lit(0) for c in ("1v3", "2v3", "11v22", "21v32", "ans_13", "ans_23")}
    empty = {c: F.lit(None).cast("date") for c in ("Jan_uptime1", "Feb_uptime1")}
    ready = dated.withColumns({**rules, **empty, "MSISDN": F.col("id")})
    matrix = feature_matrix(
        ready, "id", "gap", 4, features=["a", "b", "noise", "holes"], keep=training.DATE_COLUMNS
    )
    models, held_out = training.train_gap(matrix, DateLimits(), MEMBERS, 4)
    scores = training.gap_fold_scores(held_out.select("fold", "diff")).collect()
    assert sum(r["rows"] for r in scores) == 320
    assert sum(r["mse"] * r["rows"] for r in scores) / 320 < spread(training.labelled(matrix.rows)) / 2
    test = training.score_gap(matrix, models, DateLimits())
    assert test.filter("pred_date is null or pred_date > date'2018-03-31'").count() == 0


@pytest.mark.parametrize("task", ["clf", "reg"])
def test_stacking(request, task, tmp_path):
    matrix = request.getfixturevalue(task)
    train, test = split_by_label(matrix.rows, "label")
    model, layer1 = fit_stacked(train, MEMBERS, task, k=4)
    assert layer1.count() == layer1.select("id").distinct().count() == 320
    fitted = model.predict(train)
    if task == "clf":
        assert roc_auc(fitted, "label", "stacked") > 0.8
        assert fitted.filter("stacked < 0 or stacked > 1").count() == 0
    else:
        assert error(fitted, "stacked") < spread(train) / 2
    model.save(f"{tmp_path}/s")
    columns = ["id", "stacked"]
    again = load_stacked(f"{tmp_path}/s").predict(test).select(columns).collect()
    assert sorted(again) == sorted(model.predict(test).select(columns).collect())


def test_stacked_scores_in_a_session_with_observed_frames(spark, clf):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    train, test = split_by_label(clf.rows, "label")
    model, _ = fit_stacked(train, [replace(m, rounds=2) for m in MEMBERS], "clf", k=4)
    assert model.predict(test).filter("stacked between 0 and 1").count() == 80


def test_nested_stacking(spark, reg, tmp_path):
    rows = training.labelled(reg.rows).withColumn("fold", F.col("fold") % 3)
    model, out = fit_nested(rows, "id", MEMBERS, "reg", outer=3, inner=2)
    assert out.count() == out.select("id").distinct().count() == 320
    assert error(out, "stacked") < spread(out) / 2
    scores = {r["fold"]: r for r in error_scores(out.withColumn("d", F.col("label") - F.col("stacked")), "d", ["fold"]).collect()}
    assert set(scores) == {0, 1, 2} and sum(r["rows"] for r in scores.values()) == 320
    # scores of a fold do not depend on its labels
    other = rows.withColumn("label", F.when(F.col("fold") == 1, 120.0).otherwise(F.col("label")))
    _, again = fit_nested(other, "id", MEMBERS, "reg", outer=3, inner=2)
    want, got = ({r["id"]: r["stacked"] for r in t.filter("fold = 1").collect()} for t in (out, again))
    assert got == pytest.approx(want, rel=1e-6) and len(got) == len(want) > 50
    model.save(f"{tmp_path}/n")
    test = reg.rows.filter("label is null")
    columns = ["id", "stacked_0", "stacked_1", "stacked_2", "stacked"]
    first = sorted(model.predict(test).select(columns).collect())
    assert first == sorted(load_nested(f"{tmp_path}/n").predict(test).select(columns).collect())
    for r in first:
        assert r["stacked"] == pytest.approx((r["stacked_0"] + r["stacked_1"] + r["stacked_2"]) / 3)
    assert len(first) == 80


def test_settings_are_accepted(clf, reg):
    for matrix, members, task in ((clf, CHURN_MEMBERS, "clf"), (reg, GAP_MEMBERS, "reg")):
        few = [replace(m, rounds=2) for m in members]
        assert fit_folds(training.labelled(matrix.rows), few, task, 2).models.keys() == {"broad", "deep"}


def test_best_round():
    assert best_round([5, 4, 3, 3, 3], 2) == (3, True)
    assert best_round([5, 4, 3, 3], 2) == (3, False)
    assert best_round([5, 6, 4, 6, 6, 1], 2) == (3, True)
    assert best_round([3.0], 10) == (1, False)


def test_rows_with_a_null_key_have_a_fold(spark):
    keys = spark.createDataFrame([(None,), (1,), (None,)], "id long")
    folds = [r[0] for r in keys.select(fold_of(F.col("id"), 5)).collect()]
    assert None not in folds and folds[0] == folds[2]
