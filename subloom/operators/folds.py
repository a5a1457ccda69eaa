"""Fold numbers from the key itself, so they do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_of(key: Column, k: int, seed: int = 0) -> Column:
    """A fold from 0 for every row; rows with a null key share one."""
    known = F.coalesce(key.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), known).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int")
