"""One model per member and fold: out-of-fold predictions and bagged scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.functions.rowwise import row_mean
from subloom.learning.binning import dense, vector_parts
from subloom.learning.boosting import Booster, Job, fit_boosters
from subloom.learning.members import Member
from subloom.learning.trees import Tree

NODES = """model INT, tree INT, node INT, feature INT, bin INT, missing_left BOOLEAN, left INT,
    right INT, threshold DOUBLE, value DOUBLE, gain DOUBLE, rows DOUBLE"""


def node_table(spark: SparkSession, models: Sequence[Booster]) -> DataFrame:
    """The trees as a table of nodes; ``model`` numbers the models."""
    names = [f.name for f in fields(Tree)]
    parts = [
        pd.DataFrame({c: getattr(tree, c) for c in names}).assign(
            model=i, tree=j, node=range(len(tree.feature))
        )
        for i, model in enumerate(models)
        for j, tree in enumerate(model.trees)
    ]
    if not parts:
        return spark.createDataFrame([], NODES)
    order = spark.createDataFrame([], NODES).columns
    return spark.createDataFrame(pd.concat(parts)[order], NODES)


def save_boosters(spark: SparkSession, models: Sequence[Booster], path: str) -> None:
    """Node tables and one row per model under ``path``."""
    node_table(spark, models).write.mode("overwrite").parquet(f"{path}/nodes")
    rows = [(i, m.task, m.base, m.size, list(map(float, m.errors))) for i, m in enumerate(models)]
    shape = "model INT, task STRING, base DOUBLE, size INT, errors ARRAY<DOUBLE>"
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/models")


def load_boosters(spark: SparkSession, path: str) -> list[Booster]:
    heads = spark.read.parquet(f"{path}/models").orderBy("model").collect()
    models = [Booster(h["task"], h["base"], h["size"], [], list(h["errors"])) for h in heads]
    names = [f.name for f in fields(Tree)]
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("model", "tree", "node").toPandas()
    for (i, _), tree in nodes.groupby(["model", "tree"], sort=True):
        models[i].trees.append(Tree(*(tree[c].tolist() for c in names)))
    return models


def add_scores(
    df: DataFrame,
    models: Sequence[Booster],
    columns: Sequence[str],
    asked: Sequence[Column] | None = None,
) -> DataFrame:
    """Every model's score in a column of its own, in one pass over the vectors. ``asked`` may say
    for each model which rows it is to score; it has null for others."""
    shared = df.sparkSession.sparkContext.broadcast(list(models))
    wanted = asked or [F.lit(True)] * len(models)

    @F.pandas_udf("array<double>")
    def scored(
        size: pd.Series, indices: pd.Series, values: pd.Series, asked: pd.Series
    ) -> pd.Series:
        batch = pd.DataFrame({"size": size, "indices": indices, "values": values})
        wanted = np.array(asked.tolist(), bool).reshape(len(batch), -1)
        out = np.full(wanted.shape, np.nan)
        for a, b, x in dense(batch):
            for i, model in enumerate(shared.value):
                rows = wanted[a:b, i]
                if rows.any():
                    out[a:b, i][rows] = model.scores(x[rows])
        return pd.Series(list(out))

    name = "__scores"
    values = df.withColumn(name, scored(*vector_parts(), F.array(*wanted)))
    return values.withColumns(
        {
            c: F.nanvl(F.get(name, F.lit(i)), F.lit(None).cast("double"))
            for i, c in enumerate(columns)
        }
    ).drop(name)


@dataclass(frozen=True)
class FoldModels:
    task: str
    k: int
    models: dict[str, list[Booster]]

    def flat(self) -> list[Booster]:
        return [model for models in self.models.values() for model in models]

    def _columns(self) -> list[str]:
        return [f"{name}_{i}" for name in self.models for i in range(self.k)]

    def out_of_fold(self, rows: DataFrame) -> DataFrame:
        """Each row scored by the models that did not train on it: ``pred_{member}``."""
        parts = [f"__{c}" for c in self._columns()]
        mine = [F.col("fold") == i for _ in self.models for i in range(self.k)]
        scored = add_scores(rows, self.flat(), parts, mine)
        by_member = {
            f"pred_{name}": F.coalesce(*parts[j * self.k : (j + 1) * self.k])
            for j, name in enumerate(self.models)
        }
        return scored.withColumns(by_member).drop(*parts)

    def bagged(self, rows: DataFrame) -> DataFrame:
        """Every model's score, the mean of each member and the mean of all in ``score``."""
        columns = self._columns()
        out = add_scores(rows, self.flat(), columns)
        means = {
            f"pred_{name}": row_mean(columns[j * self.k : (j + 1) * self.k])
            for j, name in enumerate(self.models)
        }
        return out.withColumns({**means, "score": row_mean(columns)})

    def curves(self) -> DataFrame:
        """Rows (member, fold, round, error, kept): the held-out error of every round, and whether
        its tree stayed."""
        rows = [
            (name, i, r + 1, float(error), r < len(model.trees))
            for name, models in self.models.items()
            for i, model in enumerate(models)
            for r, error in enumerate(model.errors)
        ]
        shape = "member STRING, fold INT, round INT, error DOUBLE, kept BOOLEAN"
        return SparkSession.active().createDataFrame(rows, shape)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        meta = [(self.task, self.k, list(self.models))]
        shape = "task STRING, k INT, members ARRAY<STRING>"
        spark.createDataFrame(meta, shape).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
        save_boosters(spark, self.flat(), path)


def load_fold_models(path: str) -> FoldModels:
    spark = SparkSession.active()
    meta = spark.read.json(
        f"{path}/meta", schema="task STRING, k INT, members ARRAY<STRING>"
    ).first()
    return from_flat(meta["task"], meta["k"], meta["members"], load_boosters(spark, path))


def from_flat(task: str, k: int, names: Sequence[str], models: Sequence[Booster]) -> FoldModels:
    return FoldModels(
        task, k, {name: list(models[j * k : (j + 1) * k]) for j, name in enumerate(names)}
    )


def fit_folds(
    rows: DataFrame, members: Sequence[Member], task: str, k: int, early_stop: bool = True
) -> FoldModels:
    """Train each member once per fold on the other folds, all of them at the same time. With
    ``early_stop`` the left-out fold ends the boosting when it no longer gains; else every member
    grows its ``rounds`` trees."""
    if early_stop:
        jobs = [Job(m, fold=i) for m in members for i in range(k)]
        models = fit_boosters(rows, jobs, task)
    else:
        whole = rows.withColumnsRenamed({"fold": "outer"}).withColumn("fold", F.lit(-2))
        models = fit_boosters(whole, [Job(m, outer=i) for m in members for i in range(k)], task)
    return from_flat(task, k, [m.name for m in members], models)
