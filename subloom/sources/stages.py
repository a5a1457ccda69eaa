"""Results of a run's stages in one folder, so that a run goes on where it stopped."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from subloom.session import listing, own_tables, remove

Made = TypeVar("Made")
MANIFEST = "key STRING, schema STRING"


class Stages:
    """Every stage is stored under its name with a manifest: a digest of the run's settings, the
    stage's own and those of the stages it needs, and the schema. A stage whose manifest agrees is read, any other one
    is made again, and so are those that need it. ``ran`` lists the stages made by this object."""

    def __init__(self, spark: SparkSession, folder: str, settings: Mapping[str, object]):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings = json.dumps(settings, sort_keys=True, default=str)
        self.keys: dict[str, str] = {}
        self.ran: list[str] = []

    def table(
        self,
        name: str,
        make: Callable[[], DataFrame],
        needs: Sequence[str] = (),
        own: object = None,
        partition_by: Sequence[str] = (),
    ) -> DataFrame:
        """The stored table of a stage. What ``make`` keeps in the shared folder is removed."""

        def save(df: DataFrame, path: str) -> str:
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
            return df.schema.json()

        def load(path: str) -> DataFrame:
            return self.spark.read.parquet(path)

        return self.saved(name, make, save, load, needs, own)

    def saved(
        self,
        name: str,
        make: Callable[[], Made],
        save: Callable[[Made, str], str | None],
        load: Callable[[str], Made],
        needs: Sequence[str] = (),
        own: object = None,
    ) -> Made:
        """As ``table``, for anything that can be saved to a path and loaded from it."""
        parts = [name, self.settings, own, [self.keys[n] for n in needs]]
        key = json.dumps(parts, sort_keys=True, default=str)
        self.keys[name] = hashlib.sha256(key.encode()).hexdigest()
        path, manifest = f"{self.folder}/{name}", f"{self.folder}/{name}.manifest"
        if self._finished(manifest) != self.keys[name]:
            remove(self.spark, manifest)  # from here on there is no valid result
            with own_tables(self.spark):
                schema = save(make(), path)
            row = [(self.keys[name], schema or "")]
            self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.json(manifest)
            self.ran.append(name)
        return load(path)

    def _finished(self, manifest: str) -> str | None:
        if not listing(self.spark, manifest):
            return None
        return self.spark.read.schema(MANIFEST).json(manifest).first()["key"]

    def drop(self) -> None:
        """Removes the run's folder."""
        remove(self.spark, self.folder)
