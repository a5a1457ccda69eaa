"""The replacement-date pipeline from extract files to the result file, resumable by stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.functions.dates import compact
from subloom.learning.bagging import load_fold_models
from subloom.learning.importance import fold_importances, mean_importances
from subloom.learning.matrix import Matrix
from subloom.learning.members import GAP_MEMBERS, Member
from subloom.operators.correction import DateLimits
from subloom.operators.profiles import tag_and_union
from subloom.plans import training
from subloom.plans.replacement import ReplacementSettings, replacement_features
from subloom.session import listing
from subloom.sources import schemas
from subloom.sources.delimited import read_checked, read_lookup
from subloom.sources.stages import Stages
from subloom.sources.store import write_diagnostics, write_result


@dataclass(frozen=True)
class Inputs:
    """Paths by table name for the train and the test part, and of the two lookups."""

    train: Mapping[str, str]
    test: Mapping[str, str]
    brand_up: str
    phone_info: str

    def files(self, spark: SparkSession) -> dict[str, list]:
        paths = [*self.train.values(), *self.test.values(), self.brand_up, self.phone_info]
        return {path: listing(spark, path) for path in paths}


def run_replacement(
    spark: SparkSession,
    inputs: Inputs,
    folder: str,
    members: Sequence[Member] = GAP_MEMBERS,
    k: int = training.GAP_FOLDS,
    limits: DateLimits = DateLimits(),
    settings: ReplacementSettings = ReplacementSettings(),
    encodings: Mapping[str, str] | None = None,
) -> Stages:
    """Reads, trains, scores and writes under ``folder``:

    - ``result``: headerless USER_ID, yyyyMMdd of the test part;
    - ``diagnostics``: rejects and read counts, held-out dates, errors per fold and their mean,
      importances by gain and by number of splits, held-out error of every round;
    - ``stages``: what each stage left, so that a run that was stopped goes on, and one with equal
      settings and input files does nothing again. ``Stages.drop`` removes them.
    """
    known = {"files": inputs.files(spark), "encodings": encodings}
    stages = Stages(spark, f"{folder}/stages", known)
    tables, rejects = _extracts(spark, stages, inputs, encodings or {})

    def features_of() -> DataFrame:
        brands = read_lookup(spark, inputs.brand_up, schemas.LOOKUPS["brand_up"])
        phones = read_lookup(spark, inputs.phone_info, schemas.LOOKUPS["phone_info"])
        return replacement_features(tables, brands, phones, settings)

    needed = [f"extract-{name}" for name in tables]
    features = stages.table("features", features_of, needed, settings)
    draft = training.gap_matrix(features, k, stored=False)
    rows = stages.table("matrix", lambda: draft.rows, ["features"], k, ["fold"])
    matrix = Matrix(rows, draft.names)
    models = stages.saved(
        "models",
        lambda: training.fit_gap(matrix, members, k),
        lambda made, path: made.save(path),
        load_fold_models,
        ["matrix"],
        members,
    )
    held_out = stages.table(
        "held-out",
        lambda: training.held_out_gap(matrix, models, limits).drop("features"),
        ["models"],
        limits,
    )
    scores = stages.table(
        "scores",
        lambda: training.score_gap(matrix, models, limits).select("USER_ID", "score", "pred_date"),
        ["models"],
        limits,
    )
    errors = training.gap_fold_scores(held_out)
    figures = ["mse", "median_abs"]
    mean = errors.agg(
        F.lit("mean").alias("fold"), F.sum("rows").alias("rows"), *[F.avg(c).alias(c) for c in figures]
    )
    by_fold = errors.select(F.col("fold").cast("string").alias("fold"), "rows", *figures)
    diagnostics = {
        "rejects": rejects,
        "held-out": held_out.select("USER_ID", "fold", "score", "pred_date", "UP_TIME", "diff"),
        "fold-errors": by_fold.unionByName(mean),
        "gains": mean_importances(fold_importances(models, matrix.names)),
        "splits": mean_importances(fold_importances(models, matrix.names, "splits")),
        "curves": models.curves(),
    }
    for name, table in diagnostics.items():
        write_diagnostics(table, f"{folder}/diagnostics/{name}")
    dated = scores.withColumn("date", compact(F.col("pred_date")))
    write_result(dated, f"{folder}/result", ["USER_ID", "date"])
    return stages


def _extracts(
    spark: SparkSession, stages: Stages, inputs: Inputs, encodings: Mapping[str, str]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables of both parts, and what could not be read of them. Values that can't be read
    become null, as the lines' other values are of use; malformed lines are left out."""
    tables, rejects = {}, []
    for name, ddl in schemas.REPLACEMENT.items():

        def read(name=name, ddl=ddl) -> tuple[DataFrame, DataFrame]:
            found = {
                split: read_checked(
                    spark, paths[name], ddl, encodings.get(name, "UTF-8"), keep_unreadable=True
                )
                for split, paths in (("train", inputs.train), ("test", inputs.test))
            }
            rows = tag_and_union(*[e.rows for e in found.values()])
            lines = tag_and_union(*[e.rejects for e in found.values()])
            counts = [(s, c, n) for s, e in found.items() for c, n in e.counts.items()]
            counted = spark.createDataFrame(counts, "split STRING, reason STRING, n LONG")
            lost = lines.withColumn("n", F.lit(1).cast("long")).unionByName(
                counted, allowMissingColumns=True
            )
            return rows.drop(*schemas.UNUSED_REPLACEMENT[name]), lost.withColumn("table", F.lit(name))

        tables[name], lost = stages.saved(f"extract-{name}", read, _save_pair, _load_pair)
        rejects.append(lost)
    return tables, reduce(DataFrame.unionByName, rejects)


def _save_pair(pair: tuple[DataFrame, DataFrame], path: str) -> str:
    for df, part in zip(pair, ("rows", "rejects")):
        df.write.mode("overwrite").parquet(f"{path}/{part}")
    return pair[0].schema.json()


def _load_pair(path: str) -> tuple[DataFrame, DataFrame]:
    spark = SparkSession.active()
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/rejects")
