"""Embedding whitening by the leading principal components.

Vectors become integers, so that their sums and deviations are exact. One pass sums them, a second
one adds up centred outer products task by task; what reaches the driver is one matrix of the
dimension squared, whatever the number of rows. There, Householder reflections make the covariance
tridiagonal, Sturm counts bisect for its leading eigenvalues, and inverse iteration, with the
vectors of close eigenvalues made orthogonal again, gives the components. These (components times
dimension numbers) go back to the tasks, which project every vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.llm.words import as_text
from subloom.session import write_through

# The grid on which entries are rounded down, and what keeps them positive.
GRID = 1024
SHIFT = 100_000
# Entries of this size and beyond have no exact place on the grid.
BEYOND = 2.0**50
COMPONENTS = 8
# Vectors multiplied at a time.
ROWS = 4_096


def _householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix, and the
    reflections in the order in which they were applied."""
    a, n = a.copy(), len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        mirrors.append(v)
        norm = np.copysign(np.linalg.norm(v), v[0])
        if norm == 0:
            continue
        v[0] += norm
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -norm
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def _below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative pivots of a Sturm sequence."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    pivot = diagonal[0] - points
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - points - e * e / pivot
        count += pivot < 0
    return count


def _largest(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each to the last bit that bisection can give."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    high += np.spacing(np.abs(high)) * 4
    place = len(diagonal) - 1 - np.arange(k)
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        under = _below(diagonal, off, middle) <= place
        low, high = np.where(under, middle, low), np.where(under, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, b: np.ndarray, tiny: float) -> np.ndarray:
    """A tridiagonal system by elimination with row exchanges; pivots of 0 become ``tiny``."""
    n = len(diagonal)
    d, u, uu, b = diagonal.copy(), np.append(off, 0.0), np.zeros(n), b.copy()
    low = off.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low[i] = low[i], d[i]
            u[i], d[i + 1] = d[i + 1], u[i]
            uu[i], u[i + 1] = u[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        d[i] = d[i] or tiny
        f = low[i] / d[i]
        d[i + 1] -= f * u[i]
        u[i + 1] -= f * uu[i]
        b[i + 1] -= f * b[i]
    d[-1] = d[-1] or tiny
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - u[i] * x[i + 1] - uu[i] * x[i + 2]) / d[i]
    return x[:n]


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows.

    The largest entry of a vector is positive. Vectors of equal eigenvalues are some orthonormal
    basis of their space.
    """
    scale = np.abs(matrix).max(initial=0.0)
    k = min(k, len(matrix))
    if scale == 0:
        return np.zeros(k), np.eye(len(matrix))[:k]
    diagonal, off, mirrors = _householder(matrix / scale)
    values = _largest(diagonal, off, k)
    size = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)
    tiny, close = size * np.finfo(float).eps, size * 1e-3
    vectors = np.zeros((k, len(matrix)))
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > close:
            first = i
        mates = vectors[first:i]
        x = np.random.default_rng(i).uniform(0.5, 1.5, len(matrix))
        # equal values are set apart by a few last bits, so that their solves differ
        shifted = diagonal - (value - (i - first) * tiny)
        for _ in range(5):
            x = _solve(shifted, off, x, tiny)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= mates.T @ (mates @ x)
            x /= np.linalg.norm(x)
        vectors[i] = x
    for j in range(len(mirrors) - 1, -1, -1):
        v = mirrors[j]
        vectors[:, j + 1 :] -= 2 * np.outer(vectors[:, j + 1 :] @ v, v)
    sign = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])
    return values * scale, vectors * sign[:, None]


def on_grid(vector, grid: int = GRID, shift: int = SHIFT):
    """Entries as longs: floor(grid * c) + shift."""
    return F.transform(vector, lambda c: F.floor(grid * c.cast("double")) + F.lit(shift).cast("long"))


def _batches(batch: pd.DataFrame, column: str) -> Iterator[np.ndarray]:
    for at in range(0, len(batch), ROWS):
        yield np.vstack(batch[column].iloc[at : at + ROWS])


def _totals(df: DataFrame, column: str, size: int) -> list:
    """Sums over an array column, place by place; of longs exact, at any size. Each task sends
    one row per place."""
    exact = df.schema[column].dataType.elementType.simpleString() == "bigint"

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [0] * size
        for batch in batches:
            for x in _batches(batch, column):  # 4,096 longs below 2^51 add up to less than 2^63
                total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        yield pd.DataFrame({"at": np.arange(size), "x": list(map(repr, total))})

    kind, back = ("decimal(38,0)", int) if exact else ("double", float)
    sent = df.select(column).mapInPandas(parts, "at int, x string")
    out = [0] * size
    for r in sent.groupBy("at").agg(F.sum(F.col("x").cast(kind)).alias("x")).collect():
        out[r["at"]] = back(r["x"])
    return out


def _scatter(df: DataFrame, column: str, centre: np.ndarray) -> np.ndarray:
    """Sum of the outer products of an array column about ``centre``. Each task sends one row per
    dimension."""
    size = len(centre)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            for x in _batches(batch, column):
                x = x - centre
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(size), "part": list(total)})

    sent = df.select(column).mapInPandas(parts, "i int, part array<double>")
    entries = sent.select("i", F.posexplode("part").alias("j", "x"))
    out = np.zeros((size, size))
    for r in entries.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return out


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), one per usable row
    and component, components numbered from 1 by falling eigenvalue.

    ``n`` is the number of usable rows; ``deviation`` the exact sum over dimensions of
    (n * x - S)^2, null beyond the range of a long; ``whitened`` the centred vector's projection
    over the root of the eigenvalue; ``explained`` the eigenvalue's share of the trace;
    ``identity_error`` how far the covariance of ``whitened`` is from the identity at most.

    Rows are left out if the vector is null or empty, holds an entry that is null, not finite or
    2^50 / 1024 and more in size, or is not of the commonest length (the least of several; vectors
    of other lengths lie in other spaces). A component without variance has ``whitened`` null and
    does not count in ``identity_error`` (0 if none has any); with no variance at all ``explained``
    is 0. Repeated rows count each; a null id stays null; other columns are not read. Without
    usable rows there is no row.
    """
    spark = vectors.sparkSession
    entry = F.col(vector_column)
    usable = entry.isNotNull() & F.forall(
        entry, lambda c: F.coalesce(F.abs(c.cast("double")) < BEYOND / GRID, F.lit(False))
    )
    clean = vectors.filter(usable & (F.size(entry) > 0))
    sizes = clean.groupBy(F.size(entry).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    kind = vectors.schema[id_column].dataType.simpleString()
    shape = (
        f"{id_column} {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    if common is None:
        return spark.createDataFrame([], shape)
    size, n = common["size"], common["n"]
    rows = clean.filter(F.size(entry) == size).select(
        as_text(F.col(id_column)).alias("id"), on_grid(entry).alias("x")
    )
    total = _totals(rows, "x", size)
    mean = np.array([s / n for s in total])
    covariance = _scatter(rows, "x", mean) / n
    values, axes = leading_eigenpairs((covariance + covariance.T) / 2, components)
    trace = float(np.trace(covariance))
    real = values > trace * size * np.finfo(float).eps
    weights = axes / np.sqrt(np.where(real, values, 1.0))[:, None]
    exact_sums = np.array(total, object)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                x = np.vstack(part["x"])
                yield pd.DataFrame(
                    {
                        "id": part["id"],
                        "deviation": _deviations(x, n, exact_sums),
                        "whitened": list((x - mean) @ weights.T),
                    }
                )

    projected = write_through(
        rows.mapInPandas(project, "id string, deviation string, whitened array<double>"), "whitened"
    )
    centre = np.array(_totals(projected, "whitened", len(values))) / n
    spread = _scatter(projected, "whitened", centre) / n
    part = (spread - np.eye(len(values)))[np.ix_(real, real)]
    error = float(np.abs(part).max(initial=0.0))
    shares = [float(v / trace) if trace else 0.0 for v in values]
    place = F.col("component")
    varies = F.get(F.array(*map(F.lit, real.tolist())), place)
    return projected.select(
        "id", "deviation", F.posexplode("whitened").alias("component", "value")
    ).select(
        F.col("id").cast(kind).alias(id_column),
        (place + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        F.when(varies, F.col("value")).alias("whitened"),
        F.get(F.array(*map(F.lit, shares)), place).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[str | None]:
    """Exact sums of squares of n * x - S as text; None beyond a long. Whole numbers of any size
    only where 64 bits might not do."""
    most = float(max(map(abs, sums), default=0)) + float(n) * float(np.abs(x).max(initial=0))
    if most**2 * x.shape[1] < 2.0**62:
        d = n * x - sums.astype(np.int64)
        return (d * d).sum(axis=1).astype(str).tolist()
    exact = [sum(int(c) ** 2 for c in n * row.astype(object) - sums) for row in x]
    return [str(s) if s < 2**63 else None for s in exact]
