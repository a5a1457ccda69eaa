"""From a feature table to labelled vectors, stored by fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.operators.folds import fold_of
from subloom.session import write_through


@dataclass(frozen=True)
class Matrix:
    """Rows (keys and kept columns, label, features, fold) and the features' names."""

    rows: DataFrame
    names: tuple[str, ...]

    def fold(self, i: int) -> DataFrame:
        """Only that fold's files are read."""
        return self.rows.filter(F.col("fold") == i)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``features``: a vector with NaN where a value is missing. Vector columns, such as sparse
    one-hot codes, go in as they are."""
    vectors = {f.name for f in df.schema if f.dataType.typeName() == "vectorudt"}
    known = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
        for c in features
        if c not in vectors
    }
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid="keep"
    )
    return assembler.transform(df.withColumns(known))


def feature_matrix(
    df: DataFrame,
    key: str,
    label: str,
    k: int,
    seed: int = 0,
    features: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> Matrix:
    """Assemble every numeric column (or ``features``) and store the rows by fold."""
    matrix = unstored_matrix(df, key, label, k, seed, features, exclude, keep)
    return Matrix(write_through(matrix.rows, "matrix", partition_by=["fold"]), matrix.names)


def unstored_matrix(
    df: DataFrame,
    key: str,
    label: str,
    k: int,
    seed: int = 0,
    features: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> Matrix:
    left_out = {key, label, *exclude}
    if features is None:
        features = [c for c, t in df.dtypes if t not in ("string", "date") and c not in left_out]
    rows = assemble(df, features).select(
        key,
        *[c for c in keep if c != key],
        F.col(label).cast("double").alias("label"),
        "features",
        fold_of(F.col(key), k, seed).alias("fold"),
    )
    return Matrix(rows, tuple(_names(df, features)))


def _names(df: DataFrame, features: Sequence[str]) -> list[str]:
    """A name per place of the assembled vectors; places of a vector column are numbered."""
    names = []
    for c in features:
        width = df.schema[c].metadata.get("ml_attr", {}).get("num_attrs")
        names += [c] if width is None else [f"{c}_{i}" for i in range(width)]
    return names
