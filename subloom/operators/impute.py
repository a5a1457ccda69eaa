"""Filling nulls with a statistic of the whole column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.operators.medians import exact_medians


def _fill(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), stats.select(c).scalar()) for c in columns}
    )


def fill_with_mean(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None):
    """Nulls become the mean over ``fit_on`` (the frame itself unless given)."""
    stats = (df if fit_on is None else fit_on).agg(*[F.avg(c).alias(c) for c in columns])
    return _fill(df, stats, columns)


def fill_with_median(
    df: DataFrame,
    columns: Sequence[str],
    fit_on: DataFrame | None = None,
    row_bound: int | None = None,
):
    """Nulls become the exact median over ``fit_on``."""
    source = df if fit_on is None else fit_on
    return _fill(df, exact_medians(source, [], columns, row_bound), columns)
