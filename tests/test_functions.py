import datetime as dt

from pyspark.sql import functions as F

from subloom.functions import dates, numeric, rowwise


def one(spark, column, **values):
    df = spark.range(1).select(*[F.expr(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]


def many(spark, column, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [r["out"] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_months(spark):
    assert one(spark, dates.month_gap(F.lit(198001), F.lit(201802))) == 457
    assert one(spark, dates.months_until(F.lit(201712), 201803)) == 3
    assert one(spark, dates.month_start(F.lit(201712))) == dt.date(2017, 12, 1)


def test_days(spark):
    day = dates.compact_to_date(F.col("x"))
    gaps = many(spark, dates.days_until(day, dt.date(2018, 3, 1)), "INT", [20180101, 0, None])
    assert gaps == [59, None, None]
    assert many(spark, dates.days_until(day, dt.date(2018, 3, 1)), "STRING", ["00000000"]) == [None]
    assert one(spark, dates.compact(F.lit(dt.date(2018, 3, 1)))) == "20180301"
    cap = dates.cap_date(F.lit(None).cast("date"), dt.date(2018, 3, 31))
    assert one(spark, cap) == dt.date(2018, 3, 31)


def test_age_bins(spark):
    ages = [None, 1.0, 1.5, 18.0, 25.0, 60.0, 61.0, 100.0, 101.0, -10.0]
    assert many(spark, numeric.age_bin(F.col("x")), "DOUBLE", ages) == [-1, -1, 0, 0, 1, 7, 8, 8, None, None]


def test_half_even(spark):
    assert many(spark, numeric.half_even(F.col("x")), "DOUBLE", [2.5, 3.5, -2.5]) == [2, 4, -2]


def test_to_class(spark):
    assert many(spark, numeric.to_class(F.col("x")), "DOUBLE", [0.5, 0.49, None]) == [1, 0, 0]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x DOUBLE")
    assert numeric.nan_to_null(df).agg(F.avg("x"), F.count("x")).first() == (1.0, 1)


def test_rowwise(spark):
    df = spark.createDataFrame([(1, None, 4, 2), (None, None, None, None)], "a INT, b INT, c INT, d INT")
    names = list("abcd")
    rows = df.select(
        rowwise.count_present(names), rowwise.row_min(names), rowwise.row_max(names),
        rowwise.row_sum(names), rowwise.row_mean(names), rowwise.row_median(names),
    ).collect()
    assert [tuple(r) for r in rows] == [(3, 1, 4, 7, 7 / 3, 2.0), (0, None, None, 0, None, None)]
