"""Finding and separating keys that hold too many rows for one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.session import materialize

# A key with more rows than this is never gathered into one array.
HEAVY_ROWS = 100_000
# Frames up to this many rows may be broadcast; their size is counted first.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class HeavyKeys:
    """Keys above the row limit; at most (all rows / limit) of them."""

    frame: DataFrame
    keys: tuple[str, ...]
    count: int

    def _side(self) -> DataFrame:
        return F.broadcast(self.frame) if self.count <= BROADCAST_ROWS else self.frame

    def only(self, df: DataFrame) -> DataFrame:
        return df.join(self._side(), list(self.keys), "left_semi")

    def without(self, df: DataFrame) -> DataFrame:
        return df.join(self._side(), list(self.keys), "left_anti")


def find_heavy_keys(
    df: DataFrame,
    keys: Sequence[str],
    limit: int = HEAVY_ROWS,
    row_bound: int | None = None,
    weight: str | None = None,
) -> HeavyKeys | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    ``row_bound`` is a known upper bound on the rows of ``df`` (a Parquet row count costs
    only the footers); below the limit no key can be heavy and nothing runs. Otherwise one
    counting pass over the key columns decides, with map-side combine. ``weight`` is a column
    of row counts, for a frame that is counted in part already.
    """
    if row_bound is not None and row_bound <= limit:
        return None
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.groupBy(*keys).agg(rows.alias("rows"))
    frame = materialize(counted.filter(F.col("rows") > limit).select(*keys))
    count = frame.count()
    return HeavyKeys(frame, tuple(keys), count) if count else None


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a frame for broadcast if counting it shows it is small; else leave the join
    strategy to Spark. Pass a frame that is cheap to count (a file scan or a materialized
    one)."""
    return F.broadcast(df) if df.count() <= limit else df
