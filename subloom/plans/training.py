"""Training and scoring of both pipelines from their stored feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.functions.numeric import to_class
from subloom.functions.rowwise import row_mean
from subloom.learning.bagging import FoldModels, fit_folds
from subloom.learning.matrix import Matrix, feature_matrix, unstored_matrix
from subloom.learning.members import CHURN_MEMBERS, GAP_MEMBERS, Member
from subloom.operators.correction import DateLimits, with_corrected_date
from subloom.operators.evaluation import binary_scores, error_scores
from subloom.operators.profiles import split_by_label
from subloom.plans.replacement import NOT_FEATURES

# Folds of each pipeline.
CHURN_FOLDS = 4
GAP_FOLDS = 8
DATE_COLUMNS = """MSISDN HIS_UP_TIME1 UP_TIME Jan_uptime1 Feb_uptime1 1v3 2v3 11v22 21v32 ans_13
    ans_23""".split()


def churn_matrix(features: DataFrame, k: int = CHURN_FOLDS) -> Matrix:
    return feature_matrix(features, "USER_ID", "IS_LOST", k, exclude=["CUST_ID"])


def gap_matrix(features: DataFrame, k: int = GAP_FOLDS, stored: bool = True) -> Matrix:
    make = feature_matrix if stored else unstored_matrix
    return make(features, "USER_ID", "gap_label", k, exclude=NOT_FEATURES, keep=DATE_COLUMNS)


def churn_parts(matrix: Matrix) -> tuple[DataFrame, DataFrame]:
    """Train and test part: rows of class 0 or 1, and all others."""
    return split_by_label(matrix.rows, "label", (0, 1))


def gap_parts(matrix: Matrix) -> tuple[DataFrame, DataFrame]:
    """Train and test part: rows with the true date, and all others. A train row without an
    earlier date has no gap to learn from; it is scored with its part all the same."""
    return split_by_label(matrix.rows, "UP_TIME")


def labelled(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("label").isNotNull())


def pair_mean(df: DataFrame, members: Sequence[Member]) -> DataFrame:
    return df.withColumn("score", row_mean([f"pred_{m.name}" for m in members]))


def train_churn(
    matrix: Matrix, members: Sequence[Member] = CHURN_MEMBERS[:1], k: int = CHURN_FOLDS
) -> tuple[FoldModels, DataFrame]:
    """Fold models and out-of-fold scores with the class at 0.5."""
    train, _ = churn_parts(matrix)
    models = fit_folds(train, members, "clf", k)
    scored = pair_mean(models.out_of_fold(train), members)
    return models, scored.withColumn("IS_LOST", to_class(F.col("score")))


def score_churn(matrix: Matrix, models: FoldModels) -> DataFrame:
    _, test = churn_parts(matrix)
    return models.bagged(test).withColumn("IS_LOST", to_class(F.col("score")))


def churn_fold_scores(scored: DataFrame) -> DataFrame:
    return binary_scores(scored, "label", "score", by=["fold"])


def train_gap(
    matrix: Matrix,
    limits: DateLimits,
    members: Sequence[Member] = GAP_MEMBERS,
    k: int = GAP_FOLDS,
) -> tuple[FoldModels, DataFrame]:
    """Fold models and out-of-fold corrected dates of the whole train part, with their error in
    days where both dates are known."""
    models = fit_gap(matrix, members, k)
    return models, held_out_gap(matrix, models, limits)


def fit_gap(matrix: Matrix, members: Sequence[Member] = GAP_MEMBERS, k: int = GAP_FOLDS) -> FoldModels:
    train, _ = gap_parts(matrix)
    return fit_folds(labelled(train), members, "reg", k)


def held_out_gap(matrix: Matrix, models: FoldModels, limits: DateLimits) -> DataFrame:
    train, _ = gap_parts(matrix)
    means = [f"pred_{name}" for name in models.models]
    scored = models.out_of_fold(train).withColumn("score", row_mean(means))
    return with_corrected_date(scored, "score", limits)


def score_gap(matrix: Matrix, models: FoldModels, limits: DateLimits) -> DataFrame:
    _, test = gap_parts(matrix)
    return with_corrected_date(models.bagged(test), "score", limits, truth=None)


def gap_fold_scores(dated: DataFrame) -> DataFrame:
    """For a stored frame of out-of-fold dates."""
    return error_scores(dated, "diff", ["fold"], dated.count())
