import random
import statistics

import pytest
from pyspark.sql import functions as F

from subloom.operators.medians import exact_medians
from subloom.operators.periods import PeriodSpec, period_features, single_sets, trailing_sets
from subloom.operators.skew import find_heavy_keys

PERIODS = [201802, 201801, 201712]
SETS = {**trailing_sets(PERIODS), **single_sets(PERIODS[1:])}
STATS = ("sum", "mean", "max", "min", "median", "count")


def rows_of(df, key="u"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def noise(spark):
    """Users of very different size, nulls, ties, both value types and a key without a name."""
    rng = random.Random(3)
    rows = [
        (
            rng.choice([1, 1, 1, 1, 2, 2, 3, 4, 5, None]),
            rng.choice([*PERIODS, 201700]),
            rng.choice([None, rng.randint(-50, 50)]),
            rng.choice([None, round(rng.random() * 8) / 8]),
            rng.choice(["a", "b", "c", None]),
            rng.choice([10, 9, 2, None]),
        )
        for _ in range(900)
    ] + [(6, 201712, None, None, None, None)]
    df = spark.createDataFrame(rows, "u INT, p INT, n INT, x DOUBLE, c STRING, d INT")
    return df.repartition(5), rows


def all_specs():
    return [
        PeriodSpec("n", STATS, labels={"count": "rows"}),
        PeriodSpec("x", STATS),
        PeriodSpec("n", ("min", "median"), where=~F.col("c").eqNullSafe("a"), name="n_not_a"),
        PeriodSpec("x", ("mean",), sets=["1mon"], name="only"),
        PeriodSpec("c", ("nunique", "mode")),
        PeriodSpec("d", ("nunique", "mode")),
    ]


def brute_force(rows):
    out = {}
    for user in {r[0] for r in rows if r[0] is not None and r[1] in PERIODS}:
        mine = [r for r in rows if r[0] == user]
        got = {"u": user}
        for name, periods in SETS.items():
            inside = [r for r in mine if r[1] in periods]
            columns = {
                "n": [r[2] for r in inside],
                "x": [r[3] for r in inside],
                "n_not_a": [r[2] for r in inside if r[4] != "a"],
            }
            for column, values in columns.items():
                v = [x for x in values if x is not None]
                stats = {
                    "sum": sum(v), "count": len(v), "mean": sum(v) / len(v) if v else None,
                    "max": max(v, default=None), "min": min(v, default=None),
                    "median": statistics.median(v) if v else None,
                }
                for stat in ("min", "median") if column == "n_not_a" else STATS:
                    label = "rows" if (column, stat) == ("n", "count") else f"{column}_{stat}"
                    got[f"{name}_{label}"] = stats[stat]
            if name == "1mon":
                got["1mon_only_mean"] = got["1mon_x_mean"]
            for column, at in (("c", 4), ("d", 5)):
                v = [r[at] for r in inside if r[at] is not None]
                got[f"{name}_{column}_nunique"] = len(set(v))
                best = min(((-v.count(x), x) for x in set(v)), default=(0, None))
                got[f"{name}_{column}_mode"] = best[1]
        out[user] = got
    return out


def test_against_brute_force(noise):
    df, rows = noise
    assert rows_of(period_features(df, "u", "p", SETS, all_specs())) == brute_force(rows)


@pytest.mark.parametrize("limit", [0, 150])
def test_large_users_give_the_same(noise, limit):
    df, rows = noise
    heavy = find_heavy_keys(df.filter("u is not null"), ["u"], limit)
    assert heavy.count == {0: 6, 150: 2}[limit]
    assert rows_of(period_features(df, "u", "p", SETS, all_specs(), heavy)) == brute_force(rows)


def test_no_large_users(noise):
    df, _ = noise
    assert find_heavy_keys(df, ["u"], 10, row_bound=10) is None
    assert find_heavy_keys(df, ["u"], 10_000) is None


def test_worked_cases(spark):
    df = spark.createDataFrame(
        [("a", 201802, 10.0), ("a", 201801, 20.0), ("a", 201712, None)], "u STRING, p INT, fee DOUBLE"
    )
    got = rows_of(period_features(df, "u", "p", SETS, [PeriodSpec("fee", ("mean",))]))["a"]
    assert [got[f"{n}_fee_mean"] for n in ("1mon", "2mon", "3mon")] == [10, 15, 15]
    rows = [("a", 201802, 1), ("a", 201801, 4), ("a", 201712, 10)]
    df = spark.createDataFrame(rows, "u STRING, p INT, v INT")
    got = rows_of(period_features(df, "u", "p", SETS, [PeriodSpec("v", ("median",))]))["a"]
    assert [got[f"{n}_v_median"] for n in ("1mon", "2mon", "3mon")] == [1, 2.5, 4]


def test_partitioning_does_not_matter(noise):
    df, _ = noise
    whole = [s for s in all_specs() if s.column == "n"]
    one = rows_of(period_features(df.coalesce(1), "u", "p", SETS, whole))
    assert one == rows_of(period_features(df.repartition(7, "n"), "u", "p", SETS, whole))


def test_single_newest_period_equals_first_trailing_set(noise):
    df, _ = noise
    sets = {"trail": PERIODS[:1], "alone": PERIODS[:1]}
    for row in rows_of(period_features(df, "u", "p", sets, [PeriodSpec("n", STATS)])).values():
        assert all(row[f"trail_n_{s}"] == row[f"alone_n_{s}"] for s in STATS)


def test_unknown_statistic(noise):
    with pytest.raises(ValueError):
        period_features(noise[0], "u", "p", SETS, [PeriodSpec("n", ("range",))])


@pytest.mark.parametrize("size", [1, 2, 3, 1000, 30_001])
def test_bracketed_median_is_exact(spark, size):
    rng = random.Random(size)
    values = [rng.choice([rng.gauss(0, 1), 0.5, float(rng.randint(0, 3))]) for _ in range(size)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g INT, v DOUBLE")
    whole = exact_medians(df, [], ["v"]).first()["v"]
    assert whole == statistics.median(values)
    by_group = {r["g"]: r["v"] for r in exact_medians(df, ["g"], ["v"], group_bound=2).collect()}
    assert by_group == {g: statistics.median(values[g::2]) for g in (0, 1) if values[g::2]}


def test_median_of_nothing(spark):
    df = spark.createDataFrame([("a", None, 2.0), ("b", 1.0, None)], "g STRING, v DOUBLE, w DOUBLE")
    got = {r["g"]: (r["v"], r["w"]) for r in exact_medians(df, ["g"], ["v", "w"]).collect()}
    assert got == {"a": (None, 2.0), "b": (1.0, None)}
    assert exact_medians(df.filter("g = 'none'"), [], ["v"]).first()["v"] is None


@pytest.mark.parametrize("limit", [1, 100])
def test_nan_is_missing_on_both_paths(spark, limit):
    """Infinities, values near 0 and whole numbers beyond 2^53 as well."""
    values = {1: [1.0, float("nan"), 3.0], 2: [float("-inf"), -1e-300, 1e-300], 3: [2.0**60, 5.0, float("inf")]}
    rows = [(u, PERIODS[0], x) for u, xs in values.items() for x in xs]
    df = spark.createDataFrame(rows, "u INT, p INT, x DOUBLE")
    specs = [PeriodSpec("x", ("median", "count", "max"))]
    out = rows_of(period_features(df, "u", "p", SETS, specs, find_heavy_keys(df, ["u"], limit)))
    assert [out[u]["1mon_x_median"] for u in (1, 2, 3)] == [2.0, -1e-300, 2.0**60]
    assert [out[u]["1mon_x_count"] for u in (1, 2, 3)] == [2, 3, 3]
    assert out[1]["1mon_x_max"] == 3.0
    assert exact_medians(df.filter("u = 1"), ["u"], ["x"], 3).first()["x"] == 2.0
