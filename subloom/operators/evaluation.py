"""Scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subloom.functions.numeric import to_class
from subloom.operators.medians import exact_medians
from subloom.operators.skew import checked_broadcast
from subloom.session import materialize, write_through


def binary_scores(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Row and class counts, F1, accuracy and recall of class 1 (0 where undefined)."""
    marked = df.select(
        *by, F.col(label).cast("int").alias("y"), to_class(F.col(score), threshold).alias("p")
    )
    hits = lambda y, p: F.count(F.when((F.col("y") == y) & (F.col("p") == p), 1))
    counts = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("p") == 1, 1)).alias("predicted_1"),
        F.count(F.when(F.col("p") == 0, 1)).alias("predicted_0"),
        hits(1, 1).alias("tp"),
        hits(0, 1).alias("fp"),
        hits(1, 0).alias("fn"),
        hits(0, 0).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "recall": ratio(tp, tp + fn),
        }
    ).drop("tp", "fp", "fn", "tn")


def roc_auc(df: DataFrame, label: str, score: str) -> float:
    """Exact area under the ROC curve; equal scores count half. Sorted by range, in parallel."""
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s"))
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="s", labelCol="y", metricName="areaUnderROC", numBins=0
    )
    return evaluator.evaluate(rows)


def roc_auc_by(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Rows (by.., rows, auc): the exact area under the ROC curve of every group, in one pass for
    all groups; equal scores count half, and a group of one class has null. Rows without label or
    score do not count.

    Equal scores of a group collapse before they move. They are sorted by range over the cluster;
    how many of class 0 lie below follows from a running count inside each range and the totals of
    the group's ranges before it, so no task holds more than a range.
    """
    marked = df.select(*by, F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    ones, zeros = (F.count(F.when(F.col("y") == k, 1)) for k in (1, 0))
    counts = (
        marked.filter("y is not null and s is not null")
        .groupBy(*by, "s")
        .agg(ones.alias("ones"), zeros.alias("zeros"))
    )
    ordered = materialize(counts.orderBy(*by, "s")).withColumn("part", F.spark_partition_id())
    parts = ordered.groupBy(*by, "part").agg(F.sum("zeros").alias("n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        parts.select(
            *[F.col(c).alias(f"_{c}") for c in by],
            F.col("part").alias("_part"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        )
    )
    same = F.col("part") == F.col("_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy("part", *by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(checked_broadcast(offsets), same).withColumn(
        "below", F.col("offset") + F.coalesce(F.sum("zeros").over(inside), F.lit(0))
    )
    # twice the pairs in order, in whole numbers: the order of rows makes no difference
    won = F.sum(F.col("ones") * (2 * F.col("below") + F.col("zeros"))).cast("double")
    pairs = F.sum("ones").cast("double") * F.sum("zeros")
    return placed.groupBy(*by).agg(
        (F.sum("ones") + F.sum("zeros")).alias("rows"), F.try_divide(won, 2 * pairs).alias("auc")
    )


def binary_scores_by_model(
    df: DataFrame, label: str, scores: Sequence[str], by: Sequence[str], threshold: float = 0.5
) -> DataFrame:
    """Rows (model, by.., rows, predicted_1, predicted_0, f1, accuracy, recall, auc) for every
    score column and group, from one frame of all of them."""
    entries = F.array(
        *[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores]
    )
    long = write_through(
        df.select(*by, F.col(label).alias("label"), F.explode(entries).alias("e")).select(
            *by, "label", "e.*"
        ),
        "model-scores",
    )
    keys = ["model", *by]
    auc = roc_auc_by(long, "label", "score", keys).drop("rows")
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    renamed = auc.withColumnsRenamed({c: f"_{c}" for c in keys})
    counts = binary_scores(long, "label", "score", threshold, keys)
    return counts.join(renamed, same, "left").drop(*[f"_{c}" for c in keys])


def error_scores(
    df: DataFrame, diff: str, by: Sequence[str], row_bound: int | None = None
) -> DataFrame:
    """Rows, mean squared error and median absolute error per group."""
    errors = df.select(*by, F.col(diff).alias("diff"), F.abs(F.col(diff)).alias("median_abs"))
    means = errors.groupBy(*by).agg(
        F.count("diff").alias("rows"), F.avg(F.pow("diff", F.lit(2))).alias("mse")
    )
    return means.join(exact_medians(errors, by, ["median_abs"], row_bound), list(by))


def mean_over_folds(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    return scores.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
