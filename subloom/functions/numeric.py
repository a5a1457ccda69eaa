"""Rounding, binning and null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Age bin edges and labels, right-closed.
AGE_EDGES = (-10, 1, 18, 25, 30, 35, 40, 45, 50, 60, 100)
AGE_LABELS = (-1, 0, 1, 2, 3, 4, 5, 6, 7, 8)


def right_closed_bins(value: Column, edges: Sequence[float], labels: Sequence[int]) -> Column:
    """Label of the interval ``(edge, next edge]``; null outside all of them."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval")
    chain = F.when(value <= edges[0], F.lit(None).cast("int"))
    for upper, label in zip(edges[1:], labels):
        chain = chain.when(value <= upper, F.lit(label))
    return chain


def age_bin(age: Column) -> Column:
    return right_closed_bins(F.coalesce(age, F.lit(-1.0)), AGE_EDGES, AGE_LABELS)


def half_even(value: Column) -> Column:
    """Round to a whole number, ties to the even one."""
    return F.bround(value)


def to_class(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or cannot be told."""
    return F.when(condition, 1).otherwise(0)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark counts NaN as a value; the statistics here must not."""
    doubles = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
