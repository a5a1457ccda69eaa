"""Which features the boosters use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.learning.bagging import FoldModels


def fold_importances(models: FoldModels, names: Sequence[str], kind: str = "gain") -> DataFrame:
    """Rows (member, fold, feature, importance) of all features, 0 where no tree used one: shares
    of the gain of all splits ('gain'), or numbers of splits ('splits')."""
    rows = []
    for member, folds in models.models.items():
        for i, model in enumerate(folds):
            values = model.importances(kind)
            if kind == "gain" and values.sum() > 0:
                values = values / values.sum()
            rows += [(member, i, name, float(v)) for name, v in zip(names, values)]
    schema = "member STRING, fold INT, feature STRING, importance DOUBLE"
    return SparkSession.active().createDataFrame(rows, schema)


def mean_importances(importances: DataFrame) -> DataFrame:
    """Mean over folds per member and feature; largest first."""
    return (
        importances.groupBy("member", "feature")
        .agg(F.avg("importance").alias("importance"))
        .orderBy(F.desc("importance"), "member", "feature")
    )
