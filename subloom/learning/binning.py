"""Feature values as small bin numbers, with edges from mergeable summaries of all rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bins of a feature; bin 0 is for missing values.
BINS = 64
# Weighted points that a task sends per feature: every distinct value if there are no more.
POINTS = 1_024
# Summaries of a feature that meet in one task.
FAN_IN = 64
# Cells of a matrix of doubles that a task makes at a time.
CELLS = 2_000_000


def vector_parts(column: str = "features") -> list[Column]:
    """The size, places and values of vectors, as Python is to be sent them: sparse ones stay so."""
    parts = F.unwrap_udt(column)
    return [parts[name].alias(name) for name in ("size", "indices", "values")]


def dense(batch: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
    """Matrices of consecutive rows from vector parts, as (first row, row after the last, matrix);
    missing entries are NaN. No matrix has many more than ``CELLS`` cells."""
    if not len(batch):
        return
    size = int(max(batch["size"].fillna(0).max(), max(map(len, batch["values"]))))
    step = max(1, CELLS // max(size, 1))
    places, values = batch["indices"].tolist(), batch["values"].tolist()
    for a in range(0, len(values), step):
        b = min(a + step, len(values))
        x = np.zeros((b - a, size))
        for k in range(a, b):
            if places[k] is None:
                x[k - a] = values[k]
            else:
                x[k - a, places[k]] = values[k]
        yield a, b, x


def thinned(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their weights; beyond ``most``, evenly spaced ranks stand for
    what lies between them."""
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights, len(values))
    if len(values) <= most:
        return values, weights
    ranks = np.cumsum(weights)
    cell = np.minimum((ranks * most / ranks[-1] - 1e-9).astype(int), most - 1)
    last = np.flatnonzero(np.diff(cell, append=-1))
    return values[last], np.diff(ranks[last], prepend=0.0)


def edges_of(values: np.ndarray, weights: np.ndarray, bins: int) -> list[float]:
    """Upper edges of all bins but the last: half-way between neighbours while every value can
    have a bin, else at values of evenly spaced ranks."""
    most = bins - 1  # one is for missing values
    values, weights = thinned(values, weights, len(values) or 1)
    if len(values) <= most:
        return ((values[:-1] + values[1:]) / 2).tolist()
    picked, _ = thinned(values, weights, most)
    return picked[:-1].tolist()


def bin_edges(rows: DataFrame, size: int, bins: int = BINS) -> list[np.ndarray]:
    """Edges of each of ``size`` features in the vector column ``features``. Tasks summarise their
    rows in at most ``POINTS`` values a feature; the summaries of up to ``FAN_IN`` tasks are merged
    at a time."""

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, zeros = [(np.zeros(0), np.zeros(0))] * size, np.zeros(size)
        for batch in batches:
            for _, _, x in dense(batch):
                zeros += (x == 0).sum(axis=0)
                for j in np.flatnonzero((x != 0).any(axis=0)):
                    seen = x[:, j][(x[:, j] != 0) & ~np.isnan(x[:, j])]
                    held[j] = _added(held[j], seen, np.ones(len(seen)))
        yield _frame(
            (j, *(_added(held[j], np.zeros(1), zeros[j : j + 1]) if zeros[j] else held[j]))
            for j in range(size)
        )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return _frame(
            (j, *thinned(*_joined(part), POINTS)) for j, part in group.groupby("feature", sort=True)
        )

    def edges(group: pd.DataFrame) -> pd.DataFrame:
        found = [
            (j, edges_of(*_joined(part), bins)) for j, part in group.groupby("feature", sort=True)
        ]
        return pd.DataFrame(found, columns=["feature", "edges"])

    shape = "feature int, values array<double>, weights array<double>"
    sent = rows.select(*vector_parts()).mapInPandas(summaries, shape)
    tasks = rows.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        some = F.spark_partition_id() % tasks
        sent = sent.groupBy("feature", some.alias("some")).applyInPandas(merge, shape)
    # few tasks leave small summaries: several features then share a group
    together = F.floor(F.col("feature") / max(1, FAN_IN * 8 // tasks))
    merged = sent.groupBy(together.alias("some")).applyInPandas(edges, "feature int, edges array<double>")
    out = [np.zeros(0)] * size
    for r in merged.collect():
        out[r["feature"]] = np.array(r["edges"])
    return out


def _added(summary: tuple[np.ndarray, np.ndarray], values: np.ndarray, weights: np.ndarray):
    return thinned(np.r_[summary[0], values], np.r_[summary[1], weights], POINTS)


def _joined(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(part[c].tolist()) for c in ("values", "weights"))


def _frame(rows: Iterable[tuple]) -> pd.DataFrame:
    lists = [(j, v.tolist(), w.tolist()) for j, v, w in rows]
    return pd.DataFrame(lists, columns=["feature", "values", "weights"])


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """0 for missing, else 1 + the number of edges below the value."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j]))
    return out
