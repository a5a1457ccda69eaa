import datetime as dt

import pytest
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import functions as F

from subloom.operators import encoding
from subloom.operators.assemble import attach_features
from subloom.operators.correction import DateLimits, with_corrected_date
from subloom.operators.evaluation import binary_scores, error_scores, mean_over_folds, roc_auc
from subloom.operators.folds import fold_of
from subloom.operators.history import gap_summary, repeat_flags, slots_to_columns, wash_history
from subloom.operators.history import latest_events
from subloom.operators.impute import fill_with_mean, fill_with_median
from subloom.operators.profiles import keep_first, split_by_label, tag_and_union, user_profiles
from subloom.operators.snapshots import compare_snapshots

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "k STRING, m INT, v STRING")
    assert rows(keep_first(df, ["k"], [F.col("m").desc()])) == [("a", 3, "y"), ("b", 1, "w")]


def test_user_profiles(spark):
    accounts = spark.createDataFrame(
        [
            ("train", "u1", "c1", 201801, "20180101", "00000000"),
            ("train", "u1", "c1", 201802, "20180101", "20180228"),
            ("test", "u1", "c1", 201802, "20170101", "20180228"),
            ("test", "u2", "c9", 201802, "20180228", None),
        ],
        "split STRING, USER_ID STRING, CUST_ID STRING, MONTH_ID INT, INNET_DATE STRING, OPER_DATE STRING",
    )
    customers = spark.createDataFrame(
        [("train", "c1", 30.0, 201802), ("train", "c1", 99.0, 201801), ("test", "c1", None, 201802)],
        "split STRING, CUST_ID STRING, CERT_AGE DOUBLE, profile_month INT",
    )
    out = user_profiles(
        accounts, customers, D(2018, 3, 1), [F.col("MONTH_ID").desc()], [F.col("profile_month").desc()]
    )
    got = rows(out.select("split", "USER_ID", "INNET_DATE_gap", "OPER_DATE_gap", "CERT_AGE", "age_bins"))
    assert got == [
        ("test", "u1", 424, 1, -1.0, -1), ("test", "u2", 1, None, -1.0, -1), ("train", "u1", 59, 1, 30.0, 2),
    ]


def test_union_and_split(spark):
    train = spark.createDataFrame([(1, 0), (2, 1), (3, 7)], "u INT, y INT")
    both = tag_and_union(train, spark.createDataFrame([(4,)], "u INT"))
    member, rest = split_by_label(both, "y", (0, 1))
    assert [r[0] for r in rows(member.select("u"))] == [1, 2]
    assert rows(rest.select("u", "split")) == [(3, "train"), (4, "test")]
    known, unknown = split_by_label(both, "y")
    assert (known.count(), unknown.count()) == (3, 1)


def test_attach_fills_missing_users(spark):
    users = spark.createDataFrame([("a",), ("b",)], "u STRING")
    fees = spark.createDataFrame([("a", 2.5, "web")], "u STRING, fee DOUBLE, channel STRING")
    assert rows(attach_features(users, [fees], "u")) == [("a", 2.5, "web"), ("b", 0.0, "0")]
    assert rows(attach_features(users, [fees], "u", fill=None))[1] == ("b", None, None)


def test_label_encode(spark):
    df = spark.createDataFrame([(10, "b"), (2, None), (9, "a"), (None, "b")], "n INT, s STRING")
    assert rows(encoding.encode_categories(df, ["n", "s"])) == [(0, 2), (1, 0), (2, 1), (3, 2)]
    kept = encoding.encode_categories(df, ["n", "s"], null_code=None)
    assert rows(kept, F.col("n").asc_nulls_first()) == [(None, 1), (0, None), (1, 0), (2, 1)]


@pytest.fixture(params=["true", "false"])
def merged_partitions(spark, request):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, request.param)
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("literal,broadcast", [(0, 10_000), (0, 0), (1000, 0)])
def test_encoding_ways_agree(spark, monkeypatch, merged_partitions, literal, broadcast):
    df = spark.range(3000).select((F.col("id") * 7919 % 500).alias("n")).repartition(6)
    df = df.select("n", F.concat(F.lit("v"), F.col("n")).alias("s"), F.lit(None).cast("int").alias("z"))
    monkeypatch.setattr(encoding, "LITERAL_LEVELS", literal)
    monkeypatch.setattr(encoding, "BROADCAST_ROWS", broadcast)
    out = encoding.encode(df.withColumn("m", F.col("n")), encoding.fit_levels(df, ["n", "s", "z"]), ["n", "s", "z"])
    order = {s: i for i, s in enumerate(sorted(f"v{i}" for i in range(500)))}
    for row in out.distinct().collect():
        assert (row["n"], row["s"], row["z"]) == (row["m"], order[f"v{row['m']}"], None)


def test_levels_of_nothing(spark):
    df = spark.createDataFrame([], "n INT")
    assert encoding.encode_categories(df, ["n"]).count() == 0


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, None, 10), (3, "b", 2)], "k INT, s STRING, n INT")
    out = encoding.one_hot(df, ["s", "n"])
    assert sorted(out.columns) == ["k", "n_10", "n_2", "s_a", "s_b", "s_nan"]
    got = rows(out.select("k", "s_a", "s_b", "s_nan", "n_2", "n_10"))
    assert got == [(1, 1, 0, 0, 1, 0), (2, 0, 0, 1, 0, 1), (3, 0, 1, 0, 1, 0)]
    with pytest.raises(ValueError):
        encoding.one_hot(df, ["s"], limit=2)


def test_sparse_one_hot_of_codes(spark):
    coded = encoding.encode_categories(spark.createDataFrame([("a",), ("b",), (None,)], "s STRING"), ["s"])
    model = OneHotEncoder(inputCols=["s"], outputCols=["v"], dropLast=False).fit(coded)
    assert {(r["s"], int(r["v"].indices[0])) for r in model.transform(coded).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_brand_flags(spark):
    df = spark.createDataFrame([("荣耀",), (None,), ("Nokia",), ("**",)], "b STRING")
    got = [
        {c for c, v in r.asDict().items() if v == 1}
        for r in df.withColumns(encoding.brand_flags(F.col("b"))).collect()
    ]
    assert got == [{"is_huawei"}, set(), {"is_Nokia"}, {"is_unknown"}]


def test_lookup_keeps_unknown(spark):
    left = spark.createDataFrame([("a", "x"), ("a", "y")], "k STRING, l STRING")
    right = spark.createDataFrame([("a", "x", 1)], "k STRING, l STRING, v INT")
    assert rows(encoding.lookup(left, right, ["k", "l"])) == [("a", "x", 1), ("a", "y", None)]


def test_impute(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 30), (4, 80)], "k INT, v INT")
    assert rows(fill_with_mean(df, ["v"]))[1] == (2, 40.0)
    assert rows(fill_with_median(df, ["v"]))[1] == (2, 30.0)
    assert rows(fill_with_median(df, ["v"], row_bound=4))[1] == (2, 30.0)
    assert rows(fill_with_mean(df, ["v"], fit_on=df.filter("k < 3")))[1] == (2, 10.0)


def history(spark, *users):
    names = [f"HIS_UP_TIME{i}" for i in range(1, 6)]
    data = [(u, m, j, *[*days, *[None] * 5][:5]) for u, m, j, days in users]
    schema = "MSISDN STRING, MONTH_ID INT, INNET_DATE DATE, " + ", ".join(f"{n} DATE" for n in names)
    return spark.createDataFrame(data, schema)


def test_wash(spark):
    df = history(
        spark,
        ("some", 1, D(2014, 6, 1), [D(2017, 5, 1), D(2015, 1, 1), D(2013, 1, 1)]),
        ("none", 1, D(2014, 6, 1), [D(2013, 1, 1), D(2012, 1, 1)]),
        ("unknown", 1, None, [D(2013, 1, 1)]),
    )
    out = {r["MSISDN"]: r for r in wash_history(df).collect()}
    assert (out["some"]["wash_up_time"], out["some"]["HIS_UP_TIME3"]) == (1, None)
    assert (out["some"]["min_up_time"], out["some"]["HIS_UP_TIME2"]) == (D(2013, 1, 1), D(2015, 1, 1))
    assert (out["none"]["wash_up_time"], out["none"]["HIS_UP_TIME2"]) == (0, D(2012, 1, 1))
    assert (out["unknown"]["wash_up_time"], out["unknown"]["HIS_UP_TIME1"]) == (0, D(2013, 1, 1))
    assert {r["HIS_UP_TIME3"] for r in wash_history(df, clean=False).collect()} == {D(2013, 1, 1), None}


def test_repeats(spark):
    df = spark.createDataFrame([("X", "X", "Y", "X", None)], ", ".join(f"HIS_TERM_DESC{i} STRING" for i in range(1, 6)))
    row = repeat_flags(df).first()
    assert [row[f"is_1{i}_repeat"] for i in range(2, 6)] == [1, 0, 1, 0]
    assert (row["is_repeat"], row["is_repeat_num"]) == (1, 2)


def test_gap_fill(spark):
    df = spark.createDataFrame([(10, None), (1, 30)], "up_gap_12 INT, up_gap_23 INT")
    row = gap_summary(fill_with_mean(df, ["up_gap_23"])).filter("up_gap_12 = 10").first()
    assert [row[f"up_gap_{s}"] for s in ("min", "max", "mean", "median")] == [10, 30, 20, 20]


def test_slots(spark):
    log = spark.range(8).select(F.lit("u").alias("k"), "id", (F.col("id") % 4).alias("t"))
    latest = latest_events(log, ["k"], [F.col("t").desc(), F.col("id").desc()], keep=3)
    wide = slots_to_columns(latest, ["k"], {"id": "e"}, slots=3).first()
    assert tuple(wide) == ("u", 7, 3, 6)


def test_snapshot_rules(spark):
    d = [D(2018, 1, 1) - dt.timedelta(days=100 * i) for i in range(5)]
    df = history(
        spark,
        ("shift", 1, None, [d[0], d[1]]), ("shift", 2, None, [d[0], d[1]]), ("shift", 3, None, [d[1]]),
        ("grew", 1, None, [d[1]]), ("grew", 3, None, [d[0], d[1]]),
        ("near", 1, None, [d[1]]), ("near", 2, None, [d[0], d[1]]), ("near", 3, None, [d[2], d[0]]),
        ("old", 1, None, [d[1]]),
    ).withColumn("other", F.col("MONTH_ID") * 10)
    out = {r["MSISDN"]: r for r in compare_snapshots(df, (1, 2, 3)).collect()}
    names = ["ans_13", "ans_23", "1v3", "2v3", "11v22", "21v32"]
    got = {u: [r[n] for n in names] for u, r in out.items()}
    assert got == {
        "shift": [1, 1, 0, 0, 0, 0], "grew": [0, 0, 1, 0, 0, 0], "near": [0, 0, 1, 0, 1, 1],
    }
    assert (out["grew"]["utc_m2"], out["grew"]["Jan_uptime1"], out["grew"]["other"]) == (None, d[1], 30)


RULES = "`1v3` INT, `2v3` INT, `11v22` INT, `21v32` INT, ans_13 INT, ans_23 INT"


@pytest.mark.parametrize(
    "base,gap,rules,expected",
    [
        (D(2017, 1, 1), 600.0, {}, D(2018, 3, 31)),
        (D(2017, 1, 1), 100.5, {}, D(2017, 4, 11)),
        (D(2017, 1, 1), 101.5, {}, D(2017, 4, 13)),
        (D(2011, 1, 1), 1.0, {}, D(2012, 5, 22)),
        (D(2017, 1, 1), 100.5, {"1v3": 1}, D(2018, 2, 15)),
        (D(2017, 1, 1), 100.5, {"11v22": 1}, D(2018, 2, 15)),
        (D(2017, 1, 1), 100.5, {"1v3": 1, "2v3": 1}, D(2018, 3, 15)),
        (D(2017, 1, 1), 100.5, {"21v32": 1}, D(2018, 3, 15)),
        (D(2017, 1, 1), 100.5, {"ans_13": 1}, D(2017, 7, 1)),
        (D(2017, 1, 1), 100.5, {"ans_13": 1, "ans_23": 1, "2v3": 1}, D(2017, 8, 1)),
        (None, 100.5, {}, D(2018, 3, 31)),
    ],
)
def test_correction(spark, base, gap, rules, expected):
    names = ["1v3", "2v3", "11v22", "21v32", "ans_13", "ans_23"]
    row = (base, gap, D(2017, 7, 1), D(2017, 8, 1), D(2018, 3, 31), *[rules.get(n, 0) for n in names])
    schema = f"HIS_UP_TIME1 DATE, gap DOUBLE, Jan_uptime1 DATE, Feb_uptime1 DATE, UP_TIME DATE, {RULES}"
    out = with_corrected_date(spark.createDataFrame([row], schema), "gap", DateLimits()).first()
    assert (out["pred_date"], out["diff"]) == (expected, (D(2018, 3, 31) - expected).days)


def test_folds(spark):
    df = spark.range(8).select("id", fold_of(F.col("id"), 8).alias("f"))
    assert [r["f"] for r in df.orderBy("id").collect()] == [6, 2, 2, 0, 5, 1, 1, 6]
    moved = df.select("id").repartition(5).select("id", fold_of(F.col("id"), 8).alias("f"))
    assert rows(moved) == rows(df)


def test_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.2), (0, 0.1)], "y INT, p DOUBLE")
    row = binary_scores(df, "y", "p").first()
    assert (row["f1"], row["accuracy"], row["recall"], row["predicted_1"]) == (0.5, 0.5, 0.5, 2)
    assert roc_auc(df, "y", "p") == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    none = binary_scores(df.filter("p < 0.2"), "y", "p").first()
    assert (none["f1"], none["recall"]) == (0.0, 0.0)


@pytest.mark.parametrize("bound", [None, 10])
def test_errors(spark, bound):
    df = spark.createDataFrame([(0, -3), (0, 1), (0, 5), (1, 2)], "fold INT, diff INT")
    scores = error_scores(df, "diff", ["fold"], bound)
    assert rows(scores) == [(0, 3, 35 / 3, 3.0), (1, 1, 4.0, 2.0)]
    assert mean_over_folds(scores, ["mse"]).first()[0] == pytest.approx((35 / 3 + 4) / 2)


def test_auc_of_many_groups(spark):
    """Against all pairs; ties, one-class groups, null groups and missing values."""
    import random

    from subloom.operators.evaluation import roc_auc_by

    r = random.Random(4)
    rows = [
        (g, r.choice([0, 1, 1, None]), r.choice([0.1, 0.2, 0.2, 0.7, None, -1.0]))
        for g in ("a", "b", None)
        for _ in range(150)
    ]
    rows += [("one", 1, 0.5), ("one", 1, 0.7), ("zero", 0, 0.5)]
    got = {}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, y int, s double").repartition(parts)
        got[parts] = {x["g"]: (x["rows"], x["auc"]) for x in roc_auc_by(df, "y", "s", ["g"]).collect()}
    want = {}
    for g in ("a", "b", None, "one", "zero"):
        known = [(y, s) for k, y, s in rows if k == g and y is not None and s is not None]
        pairs = [(a, b) for y, a in known if y == 1 for z, b in known if z == 0]
        won = sum((a > b) + (a == b) / 2 for a, b in pairs)
        want[g] = (len(known), won / len(pairs) if pairs else None)
    assert got[1] == got[7] == want


def test_sparse_one_hot_equals_dense(spark):
    from pyspark.ml.functions import vector_to_array

    from subloom.operators.encoding import one_hot, one_hot_vectors

    rows = [(i, f"v{i % 7}" if i % 5 else None, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a string, b int")
    dense = one_hot(df, ["a", "b"])
    names = [c for c in dense.columns if c != "id"]
    want = {r["id"]: [float(r[c]) for c in names] for r in dense.collect()}
    sparse, levels = one_hot_vectors(df, ["a", "b"])
    assert levels.sizes == {"a": 8, "b": 3}
    both = sparse.select("id", *[vector_to_array(f"{c}_levels").alias(c) for c in ("a", "b")])
    assert {r["id"]: r["a"] + r["b"] for r in both.collect()} == want


def test_many_levels_go_into_a_matrix(spark):
    """5,000 levels, more than a dense table may have, trained on as sparse vectors."""
    from pyspark.sql import functions as F

    from subloom.learning.bagging import fit_folds
    from subloom.learning.matrix import feature_matrix
    from subloom.learning.members import Member
    from subloom.operators.encoding import one_hot_vectors

    df = spark.range(6_000).select(
        "id",
        F.when(F.col("id") < 5_000, F.col("id")).otherwise(17).cast("string").alias("level"),
        (F.col("id") % 97).cast("double").alias("x"),
        F.when(F.col("id") >= 5_000, 9.0).otherwise(1.0).alias("y"),
    )
    sparse, levels = one_hot_vectors(df, ["level"])
    assert levels.sizes == {"level": 5_000}
    matrix = feature_matrix(sparse, "id", "y", 2, features=["level_levels", "x"])
    assert len(matrix.names) == 5_001
    stored = matrix.rows.select(F.unwrap_udt("features").alias("v")).select(F.max(F.size("v.indices")))
    assert stored.first()[0] <= 2
    model = fit_folds(matrix.rows, [Member("m", step=1.0, leaves=2, rounds=1)], "reg", 2)
    place = levels.frame.filter("value = '17'").first()["code"]
    assert {m.trees[0].feature[0] for m in model.flat()} == {place}
