"""Feature tables and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",)) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def write_result(df: DataFrame, path: str, columns: Sequence[str], sep: str = ",") -> None:
    """Headerless text, one line per row."""
    df.select(*columns).write.mode("overwrite").csv(path, sep=sep, header=False)


def write_diagnostics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
