"""Two layers: boosters, and a linear model over their out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.functions.rowwise import row_mean
from subloom.learning.bagging import (
    FoldModels,
    add_scores,
    fit_folds,
    from_flat,
    load_fold_models,
)
from subloom.learning.boosting import Job, fit_boosters
from subloom.learning.members import Member
from subloom.operators.folds import fold_of
from subloom.session import work_path, write_through

# Outer and inner folds, lasso strength, inverse strength of the logistic penalty.
OUTER_FOLDS = 8
INNER_FOLDS = 5
LASSO_ALPHA = 2.0
LOGISTIC_C = 1.0
# Second layers fitted at the same time; each fit is itself spread over the cluster.
PARALLEL = 8


def _layer2_input(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="layer2").transform(df)


def _fit_layer2(task: str, scored: DataFrame, columns: Sequence[str]):
    train = _layer2_input(scored, columns)
    if task == "clf":
        estimator = LogisticRegression(
            regParam=1 / (LOGISTIC_C * scored.count()), elasticNetParam=0.0, standardization=False
        )
    else:
        estimator = LinearRegression(
            regParam=LASSO_ALPHA, elasticNetParam=1.0, standardization=False
        )
    model = estimator.setFeaturesCol("layer2").setLabelCol("label").fit(train)
    # A fitted model holds its training summary, which holds the session; tasks can't be sent that
    # once the session has been used for observed frames. Read back, it has no summary.
    path = work_path(scored.sparkSession, "layer2")
    model.write().save(path)
    return type(model).load(path)


def add_linear_score(df: DataFrame, model, task: str, columns: Sequence[str], name: str) -> DataFrame:
    """The second layer's prediction in column ``name``: the probability of class 1 or the value."""
    scored = model.transform(_layer2_input(df, columns))
    value = vector_to_array("probability")[1] if task == "clf" else F.col("prediction")
    return scored.withColumn(name, value).drop("rawPrediction", "probability", "prediction", "layer2")


@dataclass(frozen=True)
class Stacked:
    layer1: FoldModels
    layer2: LogisticRegressionModel | LinearRegressionModel

    def predict(self, rows: DataFrame, name: str = "stacked") -> DataFrame:
        """``stacked``: the mean over folds per member, then the second layer."""
        means = [f"pred_{m}" for m in self.layer1.models]
        bagged = self.layer1.bagged(rows).drop("features")
        return add_linear_score(bagged, self.layer2, self.layer1.task, means, name)

    def save(self, path: str) -> None:
        self.layer1.save(f"{path}/layer1")
        self.layer2.write().overwrite().save(f"{path}/layer2")


def load_stacked(path: str) -> Stacked:
    layer1 = load_fold_models(f"{path}/layer1")
    kind = LogisticRegressionModel if layer1.task == "clf" else LinearRegressionModel
    return Stacked(layer1, kind.load(f"{path}/layer2"))


def fit_stacked(
    rows: DataFrame, members: Sequence[Member], task: str, k: int = INNER_FOLDS
) -> tuple[Stacked, DataFrame]:
    """The stacked model and its stored out-of-fold table. ``rows`` need a ``fold`` of ``k``."""
    layer1 = fit_folds(rows, members, task, k)
    held_out = write_through(layer1.out_of_fold(rows).drop("features"), "layer1")
    layer2 = _fit_layer2(task, held_out, [f"pred_{m.name}" for m in members])
    return Stacked(layer1, layer2), held_out


@dataclass(frozen=True)
class NestedStack:
    """A stacked model per outer fold; the test part gets the mean of all."""

    models: list[Stacked]

    def predict(self, rows: DataFrame) -> DataFrame:
        """``stacked_{i}`` of every outer model and their mean ``stacked``."""
        first = self.models[0].layer1
        flat = [m for model in self.models for m in model.layer1.flat()]
        parts = [f"__{i}" for i in range(len(flat))]
        out = add_scores(rows, flat, parts).drop("features")
        columns = []
        for i, model in enumerate(self.models):
            mine = parts[i * len(first.flat()) : (i + 1) * len(first.flat())]
            means = {
                f"__pred_{name}": row_mean(mine[j * first.k : (j + 1) * first.k])
                for j, name in enumerate(first.models)
            }
            out = add_linear_score(
                out.withColumns(means), model.layer2, first.task, list(means), f"stacked_{i}"
            ).drop(*means)
            columns.append(f"stacked_{i}")
        return out.drop(*parts).withColumn("stacked", row_mean(columns))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame([(len(self.models),)], "outer INT").coalesce(1).write.mode(
            "overwrite"
        ).json(f"{path}/meta")
        for i, model in enumerate(self.models):
            model.save(f"{path}/{i}")


def load_nested(path: str) -> NestedStack:
    n = SparkSession.active().read.json(f"{path}/meta", schema="outer INT").first()["outer"]
    return NestedStack([load_stacked(f"{path}/{i}") for i in range(n)])


def fit_nested(
    rows: DataFrame,
    key: str,
    members: Sequence[Member],
    task: str,
    outer: int = OUTER_FOLDS,
    inner: int = INNER_FOLDS,
) -> tuple[NestedStack, DataFrame]:
    """Stacked models of all outer folds, and a stored table with every row's ``stacked`` from the
    model that never saw it and ``pred_{member}``, the means that went into it.

    ``rows`` need a ``fold`` of ``outer``, which stays in the table; the inner folds come from the
    key under another seed. The boosters of all outer folds, inner folds and members are trained
    in one schedule and score the rows in one pass; the second layers are fitted side by side.
    """
    names = [m.name for m in members]
    dealt = rows.withColumnsRenamed({"fold": "outer"}).withColumn(
        "fold", fold_of(F.col(key), inner, seed=1)
    )
    jobs = [Job(m, j, i) for i in range(outer) for m in members for j in range(inner)]
    flat = fit_boosters(dealt, jobs, task)
    parts = [f"__{i}" for i in range(len(jobs))]
    # an inner model scores the rows of its outer fold, and those of its inner fold elsewhere
    asked = [(F.col("outer") == job.outer) | (F.col("fold") == job.fold) for job in jobs]
    scores = add_scores(dealt, flat, parts, asked)
    runs = [(i, name) for i in range(outer) for name in names]
    # elsewhere one of the inner models has scored a row, so that the mean is its score
    means = {
        f"__{i}_{name}": row_mean(parts[at * inner : (at + 1) * inner])
        for at, (i, name) in enumerate(runs)
    }
    stored = write_through(scores.withColumns(means).drop("features", *parts), "nested")

    def second(i: int):
        mine = [f"__{i}_{name}" for name in names]
        train = stored.filter(F.col("outer") != i)
        layer2 = _fit_layer2(task, train, mine)
        layer1 = from_flat(task, inner, names, flat[i * len(names) * inner :][: len(names) * inner])
        return Stacked(layer1, layer2)

    with ThreadPoolExecutor(PARALLEL) as pool:
        target = inheritable_thread_target(rows.sparkSession)(second)
        models = list(pool.map(target, range(outer)))
    out = stored
    for i, model in enumerate(models):
        mine = [f"__{i}_{name}" for name in names]
        out = add_linear_score(out, model.layer2, task, mine, f"__{i}_stacked")

    def own(suffix: str):
        return F.coalesce(
            *[F.when(F.col("outer") == i, F.col(f"__{i}_{suffix}")) for i in range(outer)]
        )

    result = out.withColumns(
        {f"pred_{name}": own(name) for name in names} | {"stacked": own("stacked")}
    ).drop("fold", *means, *[f"__{i}_stacked" for i in range(outer)])
    return NestedStack(models), result.withColumnsRenamed({"outer": "fold"})
