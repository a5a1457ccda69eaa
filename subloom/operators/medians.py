"""Exact medians for groups of any size.

``F.median`` keeps every distinct value of a group in one buffer. Here a histogram with bins of
equal ratio tells which bin holds the middle; only that bin's values are counted, spread over
the cluster by value; a second, even cut of the bin leaves few values to rank. Every step but
the last combines on the map side, and no step holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from subloom.operators.skew import BROADCAST_ROWS, HEAVY_ROWS
from subloom.session import materialize

# Bins per factor e of the values' size, and even parts a bin is cut into afterwards.
BINS = 1024
PARTS = 4096
# Ranks of the two middle values, from 1.
LOW, HIGH = "(n + 1) div 2", "n div 2 + 1"


def exact_medians(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    row_bound: int | None = None,
    group_bound: int | None = None,
    period_col: str | None = None,
    period_sets: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """One row per key with the exact median of each column (null if it has no values; NaN
    counts as none).

    ``row_bound`` is a known upper bound on the rows of ``df``; few enough rows go through
    ``F.median`` in one pass. ``group_bound`` is one on the keys; few are broadcast. With
    ``period_sets`` there is one row per key and ``set`` of periods; rows are counted per period
    and only the counts are repeated for each set. The rows are read twice, right away; the
    counts in between are stored.
    """
    keys = list(keys)
    df = df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns})
    if row_bound is not None and row_bound <= HEAVY_ROWS and period_sets is None:
        return df.groupBy(*keys).agg(*[F.median(c).alias(c) for c in columns])
    items = [f"x{i}" for i in range(len(columns))]
    row_keys = [*keys, period_col] if period_sets else keys
    wide = df.select(*row_keys, *[F.col(c).alias(x) for c, x in zip(columns, items)])
    long = wide.unpivot(row_keys, items, "item", "x")
    bins = long.groupBy(*row_keys, "item", _bin(F.col("x")).alias("bin")).agg(
        F.count("x").alias("rows"), F.min("x").alias("first"), F.max("x").alias("last")
    )
    if period_sets:
        keys = [*keys, "set"]
        bins = (
            bins.withColumn("set", F.explode(sets_of(F.col(period_col), period_sets)))
            .groupBy(*keys, "item", "bin")
            .agg(
                F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")
            )
        )
    bins = materialize(bins)
    group = [*keys, "item"]
    ends = bins.withColumns(
        {
            "upto": F.sum("rows").over(_running(group, "bin")),
            "n": F.sum("rows").over(Window.partitionBy(*group)),
        }
    )
    middle = (
        ends.filter(_holds(LOW) | _holds(HIGH))
        .groupBy(*group)
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.min(F.col("upto") - F.col("rows")).alias("before"),
            F.max("n").alias("n"),
        )
    )
    if period_sets:
        periods = F.create_map(
            *[x for n, ps in period_sets.items() for x in (F.lit(n), F.array(*map(F.lit, ps)))]
        )
        middle = middle.withColumn(period_col, F.explode(periods[F.col("set")]))
    pairs = sum(map(len, period_sets.values())) if period_sets else 1
    if group_bound is not None and group_bound * len(items) * pairs <= BROADCAST_ROWS:
        middle = F.broadcast(middle)
    inside = materialize(
        long.join(middle, [*row_keys, "item"])
        .filter(F.col("x").between(F.col("first"), F.col("last")))
        .groupBy(*group, _part().alias("part"), "x")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(c) for c in ("n", "before")])
    )
    parts = inside.groupBy(*group, "part").agg(
        F.sum("rows").alias("rows"), *[F.max(c).alias(c) for c in ("n", "before")]
    )
    found = (
        parts.withColumn("upto", F.col("before") + F.sum("rows").over(_running(group, "part")))
        .filter(_holds(LOW) | _holds(HIGH))
        .select(*group, "part", (F.col("upto") - F.col("rows")).alias("start"))
    )
    ranked = inside.join(found, [*group, "part"]).withColumn(
        "upto", F.col("start") + F.sum("rows").over(_running([*group, "part"], "x"))
    )
    at = lambda rank: F.max(F.when(_holds(rank), F.col("x")))
    medians = ranked.groupBy(*group).agg(((at(LOW) + at(HIGH)) / 2).alias("median"))
    result = medians.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("item") == x, F.col("median"))).alias(c)
            for c, x in zip(columns, items)
        ]
    )
    return bins.select(*keys).distinct().join(result, keys, "left") if keys else result


def sets_of(period: Column, period_sets: Mapping[str, Sequence]) -> Column:
    """Names of the sets a period belongs to."""
    return F.array_compact(
        F.array(*[F.when(period.isin(list(ps)), F.lit(n)) for n, ps in period_sets.items()])
    )


def _bin(x: Column) -> Column:
    """Grows with ``x``; a bin spans a fixed ratio of sizes."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * BINS)


def _part() -> Column:
    """Kept long: Spark may evaluate it before the bin's limits are checked."""
    width = F.col("last") - F.col("first")
    share = F.coalesce(F.try_divide(F.col("x") - F.col("first"), width), F.lit(0.0))
    return F.floor(share * PARTS)


def _running(keys: Sequence[str], order: str) -> WindowSpec:
    return (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _holds(rank: str) -> Column:
    """Whether the values counted in this row cover the rank."""
    at = F.expr(rank)
    return (F.col("upto") >= at) & (F.col("upto") - F.col("rows") < at)
