"""Both pipelines over small extract files."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subloom.plans import churn, replacement, training
from subloom.sources import schemas
from subloom.sources.delimited import read_checked, read_delimited, read_extracts, read_lookup, with_times
from subloom.sources.store import read_features, write_diagnostics, write_features, write_result

MONTHS = (201712, 201801, 201802)


def write_file(path, rows, encoding="utf-8"):
    text = "".join("|".join("" if v is None else str(v) for v in row) + "\n" for row in rows)
    path.write_bytes(text.encode(encoding))
    return str(path)


def random_rows(rng, ddl, fixed, n):
    """Rows of a table; columns in ``fixed`` come from functions, others by type."""
    fields = T.StructType.fromDDL(ddl).fields
    for _ in range(n):
        row = {}
        for f in fields:
            if f.name in fixed:
                row[f.name] = fixed[f.name](row)
            elif isinstance(f.dataType, T.StringType):
                row[f.name] = rng.choice(["甲", "乙", "3", "A", None])
            elif isinstance(f.dataType, T.DateType):
                row[f.name] = f"{rng.randint(2013, 2017)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
            else:
                row[f.name] = rng.choice([None, rng.randint(0, 400) / 4])
        yield [row[f.name] for f in fields]


def churn_files(folder, rng):
    paths = {}
    for split, users in (("train", range(0, 30)), ("test", range(30, 42))):
        for name, ddl in schemas.CHURN.items():
            fixed = {
                "USER_ID": lambda _: f"u{rng.choice(users)}",
                "CUST_ID": lambda row: row.get("USER_ID", f"u{rng.choice(users)}").replace("u", "c"),
                "MONTH_ID": lambda _: rng.choice(MONTHS),
                "DAY_ID": lambda _: rng.randint(1, 31),
                "START_CYCLE_ID": lambda _: rng.choice([198001, 201711, 201802]),
                "END_CYCLE_ID": lambda _: 201802,
                "INNET_DATE": lambda _: "20150101",
                "OPER_DATE": lambda _: rng.choice(["20180101", "00000000"]),
                "IS_LOST": lambda row: int(row["USER_ID"][1:]) % 2 if split == "train" else None,
                "CERT_AGE": lambda _: rng.choice([None, 20, 33]),
            }
            if name == "t1":
                listed = iter(users)
                fixed["USER_ID"] = lambda _, listed=listed: f"u{next(listed)}"
            rows = random_rows(rng, ddl, fixed, len(users) if name == "t1" else 120)
            charset = "utf-8" if name == "t4" else "gbk"
            paths.setdefault(split, {})[name] = write_file(folder / f"{split}_{name}.txt", rows, charset)
    return paths


@pytest.fixture(scope="module")
def churn_tables(spark, tmp_path_factory):
    paths = churn_files(tmp_path_factory.mktemp("churn"), random.Random(1))
    charsets = {name: "GBK" for name in schemas.CHURN if name != "t4"}
    return read_extracts(
        spark, paths["train"], paths["test"], schemas.CHURN, schemas.UNUSED_CHURN, charsets
    )


@pytest.fixture(scope="module")
def churn_features(churn_tables):
    return churn.churn_features(churn_tables)


def test_extracts(churn_tables):
    kept = {name: len(df.columns) for name, df in churn_tables.items()}
    # With the month kept for ordering and the split added.
    assert kept == {"t1": 12, "t2": 15, "t3": 16, "t4": 7, "t5": 12, "t6": 8}
    assert {r[0] for r in churn_tables["t1"].select("CUST_TYPE").distinct().collect()} <= {
        "甲", "乙", "3", "A", None,
    }
    assert {r["split"]: r["count"] for r in churn_tables["t1"].groupBy("split").count().collect()} == {
        "train": 30, "test": 12,
    }


def test_churn_features(churn_tables, churn_features):
    settings = churn.ChurnSettings()
    prefixes = tuple(f"{n}_" for n in settings.sets)
    derived = [c for c in churn_features.columns if c.startswith(prefixes)]
    assert len(derived) == len(set(derived)) == 588
    per_set = {n: len([c for c in derived if c.startswith(f"{n}_")]) for n in settings.sets}
    assert per_set == {"1mon": 92, "2mon": 161, "3mon": 161, "201801": 87, "201712": 87}
    rows = {r["USER_ID"]: r for r in churn_features.collect()}
    assert len(rows) == churn_features.count() == 42
    fees = churn_tables["t2"].select("USER_ID", "MONTH_ID", "TOTAL_FEE").collect()
    for user, row in rows.items():
        mine = [r["TOTAL_FEE"] for r in fees if r["USER_ID"] == user and r["MONTH_ID"] in MONTHS[1:]]
        mine = [v for v in mine if v is not None]
        assert row["2mon_TOTAL_FEE_median"] == (statistics.median(mine) if mine else 0)
        assert row["2mon_TOTAL_FEE_mean"] == pytest.approx(sum(mine) / len(mine) if mine else 0)
        assert (row["IS_LOST"] is None) == (row["split"] == "test")
        assert row["1mon_CHANNEL_ID_m"] is not None
    assert not [c for c, t in churn_features.dtypes if t == "string" and c not in ("split", "USER_ID", "CUST_ID")]


def test_churn_with_large_users_is_equal(churn_tables):
    settings = churn.ChurnSettings()
    specs = [*churn.money_specs(settings, ["OWE_FEE"]), *churn.gap_specs(settings, ["cycle_gap"])]
    gaps = churn.with_settlement_gaps(churn_tables["t5"], settings)
    family = churn.Family(gaps, specs, settings.sets)
    usual = churn.family_features(family, "USER_ID", "MONTH_ID", 10_000)
    large = churn.family_features(family, "USER_ID", "MONTH_ID", 3)
    assert sorted(map(str, usual.collect())) == sorted(map(str, large.collect()))


def test_stores(spark, churn_features, tmp_path):
    write_features(churn_features.select("USER_ID", "split", "IS_LOST"), f"{tmp_path}/f")
    assert read_features(spark, f"{tmp_path}/f", "test").count() == 12
    write_result(churn_features.filter("split = 'train'"), f"{tmp_path}/r", ["USER_ID", "IS_LOST"])
    back = read_delimited(spark, f"{tmp_path}/r", "USER_ID STRING, IS_LOST INT", sep=",")
    assert (back.count(), back.agg(F.sum("IS_LOST")).first()[0]) == (30, 15)
    write_diagnostics(back, f"{tmp_path}/d")
    assert read_lookup(spark, f"{tmp_path}/d", "USER_ID STRING, IS_LOST INT").count() == 30


def replacement_files(folder, rng):
    paths = {}
    for split, users in (("train", range(0, 24)), ("test", range(24, 36))):
        for name, ddl in schemas.REPLACEMENT.items():
            months = (201801, 201802, 201803)
            pairs = iter([(u, m) for u in users for m in months]) if name != "t4" else None
            current = {}

            def month(_, pairs=pairs, current=current):
                if pairs is None:
                    return 201802
                current["pair"] = next(pairs)
                return current["pair"][1]

            def user(_, current=current, users=users):
                return f"u{current['pair'][0]}"

            listed = iter(users)
            fixed = {
                "MONTH_ID": month,
                "USER_ID": user,
                "MSISDN": lambda row, user=user: user(row).replace("u", "d"),
                "DEVICE_NUMBER": lambda row, user=user: user(row).replace("u", "d"),
                "CUST_ID": (
                    (lambda _, listed=listed: f"c{next(listed)}")
                    if name == "t4"
                    else (lambda row, user=user: user(row).replace("u", "c"))
                ),
                "UP_TIME": lambda row, split=split: "2018-03-20" if split == "train" else None,
                "CERT_AGE": lambda _: rng.choice([None, 20, 30, 44]),
            }
            if name == "t1":
                fixed |= {f"HIS_FACTORY_DESC{i}": lambda _: rng.choice(["f1", "f2", None]) for i in range(1, 6)}
                fixed |= {f"HIS_TERM_DESC{i}": lambda _: rng.choice(["m1", "m2"]) for i in range(1, 6)}
                fixed |= {f"HIS_IS_COPY{i}": lambda _: 0 for i in range(1, 6)}
                fixed |= {
                    f"HIS_UP_TIME{i}": lambda _, i=i: f"{2018 - i}{rng.randint(1, 12):02d}11"
                    for i in range(1, 6)
                }
            n = len(users) * (1 if name == "t4" else 3)
            rows = random_rows(rng, ddl, fixed, n)
            paths.setdefault(split, {})[name] = write_file(folder / f"{split}_{name}.txt", rows)
    return paths


@pytest.fixture(scope="module")
def replacement_features(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("replacement")
    paths = replacement_files(folder, random.Random(2))
    tables = read_extracts(
        spark, paths["train"], paths["test"], schemas.REPLACEMENT, schemas.UNUSED_REPLACEMENT
    )
    (folder / "brand.csv").write_text("HIS_FACTORY_DESC1,BRAND_UP\nf1,华为\nf2,Nokia\n")
    (folder / "phone.csv").write_text(
        "HIS_FACTORY_DESC1,HIS_TERM_DESC1,product_time,2Gratio,3Gratio,4Gratio,is_sp\n"
        "f1,m1,2016-01-01,0.1,0.2,0.7,1\n"
    )
    brands = read_lookup(spark, str(folder / "brand.csv"), schemas.LOOKUPS["brand_up"])
    phones = read_lookup(spark, str(folder / "phone.csv"), schemas.LOOKUPS["phone_info"])
    return tables, brands, phones


def test_run_goes_on_where_it_stopped(spark, replacement_features, tmp_path, tmp_path_factory, monkeypatch):
    from dataclasses import replace
    from pathlib import Path

    from subloom.learning.members import GAP_MEMBERS
    from subloom.plans.runner import Inputs, run_replacement

    source = tmp_path_factory.mktemp("inputs")
    paths = replacement_files(source, random.Random(2))
    with open(paths["test"]["t2"], "a") as f:
        f.write("too|short\n")
    (source / "brand.csv").write_text("HIS_FACTORY_DESC1,BRAND_UP\nf1,华为\nf2,Nokia\n")
    (source / "phone.csv").write_text("HIS_FACTORY_DESC1,HIS_TERM_DESC1,product_time,2Gratio,3Gratio,4Gratio,is_sp\n")
    inputs = Inputs(paths["train"], paths["test"], str(source / "brand.csv"), str(source / "phone.csv"))
    few = [replace(m, rounds=2, min_rows=2) for m in GAP_MEMBERS]

    def run(name, k=3):
        return run_replacement(spark, inputs, f"{tmp_path}/{name}", few, k)

    def lines(name, part):
        return sorted(x for p in Path(f"{tmp_path}/{name}/{part}").glob("part-*") for x in p.read_text().splitlines())

    whole = run("whole").ran
    assert whole == [*(f"extract-t{i}" for i in range(1, 5)), "features", "matrix", "models", "held-out", "scores"]

    def killed(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(training, "score_gap", killed)
        with pytest.raises(RuntimeError):
            run("halted")
    with monkeypatch.context() as m:  # nothing before scoring is done again
        for name in ("fit_gap", "held_out_gap"):
            m.setattr(training, name, killed)
        assert run("halted").ran == ["scores"]
    assert run("halted").ran == []
    assert lines("halted", "result") == lines("whole", "result") and len(lines("whole", "result")) == 12
    assert run("halted", k=2).ran == ["matrix", "models", "held-out", "scores"]
    names = {p.name for p in Path(f"{tmp_path}/whole/diagnostics").iterdir()}
    assert names == {"rejects", "held-out", "fold-errors", "gains", "splits", "curves"}
    assert any("too|short" in x and "malformed" in x for x in lines("whole", "diagnostics/rejects"))
    assert sum(x.startswith("mean,24,") for x in lines("whole", "diagnostics/fold-errors")) == 1
    run("halted", k=2).drop()
    assert not Path(f"{tmp_path}/halted/stages").exists() and len(lines("halted", "result")) == 12


def test_replacement_features(replacement_features):
    tables, brands, phones = replacement_features
    out = replacement.replacement_features(tables, brands, phones)
    rows = out.collect()
    assert len(rows) == 36 == len({r["USER_ID"] for r in rows})
    assert set(replacement.HISTORY_COLUMNS) <= set(out.columns)
    for r in rows:
        assert (r["UP_TIME"] is None) == (r["split"] == "test")
        assert r["is_huawei"] == int(r["HIS_FACTORY_DESC1"] == "f1")
        assert r["is_Nokia"] == int(r["HIS_FACTORY_DESC1"] == "f2")
        assert (r["is_sp"] == 1) == ((r["HIS_FACTORY_DESC1"], r["HIS_TERM_DESC1"]) == ("f1", "m1"))
        assert r["CERT_AGE"] is not None and r["up_gap_mean"] is not None
        if r["UP_TIME"]:
            assert r["gap_label"] == (r["UP_TIME"] - r["HIS_UP_TIME1"]).days
    dense = replacement.replacement_features(tables, brands, phones, dense=True)
    levels = [c for c in dense.columns if c.startswith("CUST_SEX_")]
    assert all(sum(r[c] for c in levels) == 1 for r in dense.collect())


def test_replacement_matrix(replacement_features):
    tables, brands, phones = replacement_features
    matrix = training.gap_matrix(replacement.replacement_features(tables, brands, phones), k=3)
    assert not set(matrix.names) & set(replacement.NOT_FEATURES)
    assert [part.count() for part in training.gap_parts(matrix)] == [24, 12]
    assert {len(r["features"]) for r in matrix.rows.select("features").collect()} == {len(matrix.names)}


def test_shared_device_number(replacement_features):
    """All users of the train part under one number, one of them without an earlier change:
    still one row a user, and each is scored with the part it belongs to."""
    tables, brands, phones = replacement_features
    one = F.when(F.col("split") == "train", F.lit("d0"))
    shared = {
        **tables,
        "t1": tables["t1"].withColumn("MSISDN", F.coalesce(one, "MSISDN")),
        "t2": tables["t2"].withColumn("DEVICE_NUMBER", F.coalesce(one, "DEVICE_NUMBER")),
    }
    out = replacement.replacement_features(shared, brands, phones)
    assert out.count() == out.select("USER_ID").distinct().count() == 36
    bare = out.withColumn("gap_label", F.when(F.col("USER_ID") != "u0", F.col("gap_label")))
    train, test = training.gap_parts(training.gap_matrix(bare, k=3))
    assert (train.count(), test.count()) == (24, 12)


def test_date_layouts(spark, tmp_path):
    rows = ["20180301", "2018-03-01", "2018/03/01", "20180301123000", "2018-03-01 12:30:00", "2018/03/01 12:30:00"]
    (tmp_path / "d.txt").write_text("\n".join(f"{d}|{i}" for i, d in enumerate([*rows, "soon", " ", ""])))
    path, ddl = str(tmp_path / "d.txt"), "day DATE, n INT"
    days = {r["n"]: str(r["day"]) for r in read_delimited(spark, path, ddl).collect()}
    assert [days[i] for i in range(9)] == ["2018-03-01"] * 6 + ["None"] * 3
    extract = read_checked(spark, path, ddl, keep_unreadable=True)
    assert (extract.counts["day"], extract.counts["rows"], extract.counts["rejects"]) == (1, 9, 0)
    times = {r["n"]: str(r["day"]) for r in read_checked(spark, path, with_times(ddl)).rows.collect()}
    assert [times.get(i) for i in range(9)] == ["2018-03-01 00:00:00"] * 3 + ["2018-03-01 12:30:00"] * 3 + [None, "None", "None"]


def test_rejects(spark, tmp_path):
    lines = ["1|20180101|5", "2|20180101", "3|soon|5", "4|20180102|x|y", "5||", "x|y|z"]
    (tmp_path / "r.txt").write_text("\n".join(lines))
    extract = read_checked(spark, str(tmp_path / "r.txt"), "a INT, day DATE, b DOUBLE")
    assert sorted(r["a"] for r in extract.rows.collect()) == [1, 5]
    got = sorted((r["text"], r["reason"], r["file"].endswith("r.txt")) for r in extract.rejects.collect())
    assert got == [
        ("2|20180101", "malformed", True), ("3|soon|5", "day", True),
        ("4|20180102|x|y", "malformed", True), ("x|y|z", "a, day, b", True),
    ]
    assert extract.counts == {"rows": 2, "rejects": 4, "malformed": 2, "a": 1, "day": 2, "b": 1}
