"""Statistics across the columns of one row. Nulls are skipped throughout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def count_present(names: Sequence[str]) -> Column:
    return reduce(add, [c.isNotNull().cast("int") for c in _cols(names)])


def row_min(names: Sequence[str]) -> Column:
    return F.least(*_cols(names)) if len(names) > 1 else F.col(names[0])


def row_max(names: Sequence[str]) -> Column:
    return F.greatest(*_cols(names)) if len(names) > 1 else F.col(names[0])


def row_sum(names: Sequence[str]) -> Column:
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in _cols(names)])


def row_mean(names: Sequence[str]) -> Column:
    return F.try_divide(row_sum(names).cast("double"), count_present(names))


def row_median(names: Sequence[str]) -> Column:
    return sorted_median(F.sort_array(F.array_compact(F.array(*_cols(names)))))


def sorted_median(values: Column) -> Column:
    """Middle of a sorted array without nulls; null when it is empty."""
    n = F.size(values)
    low = F.get(values, ((n - 1) / 2).cast("int"))
    high = F.get(values, (n / 2).cast("int"))
    return (low + high) / 2
