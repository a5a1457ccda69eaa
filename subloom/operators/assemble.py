"""Joining feature tables to the user list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def fill_constant(df: DataFrame, columns: Sequence[str], value: int) -> DataFrame:
    """Replace nulls by ``value``, as text in text columns."""
    types = dict(df.dtypes)
    return df.fillna({c: str(value) if types[c] == "string" else value for c in columns})


def attach_features(
    users: DataFrame, features: Sequence[DataFrame], key: str, fill: int | None = 0
) -> DataFrame:
    """Left-join each feature table (one row per key) to the users; fill what is missing.

    All sides are partitioned by the key already, so the joins themselves move nothing.
    """
    out = users
    for table in features:
        out = out.join(table, key, "left")
    if fill is None:
        return out
    names = [c for table in features for c in table.columns if c != key]
    return fill_constant(out, names, fill)
