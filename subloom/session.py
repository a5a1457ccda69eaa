"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local session, where driver and executors share one disk, may fall back to a
    temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="subloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


# Paths given out in this process, for ``own_tables``.
_GIVEN: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _GIVEN.append(path)
    return path


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what was stored in the shared folder inside. Results must have been
    written elsewhere by then."""
    before = len(_GIVEN)
    try:
        yield
    finally:
        for path in _GIVEN[before:]:
            remove(spark, path)
        del _GIVEN[before:]


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder of any file system that Spark reaches; nothing if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of change of the files at a path, hidden ones left out; empty if
    there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(place)]
    return sorted(f for f in found if not f[0].startswith(("_", ".")))


# Spark removes a query's shuffle files when it has ended, not when the driver's JVM happens to
# collect its plan. Plans take the setting that holds when they are made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside leave no shuffle files: for those whose results are stored."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, cut the lineage, survive lost executors."""
    shared_dir(df.sparkSession)
    with short_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def write_through(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Store a wide table in the shared folder and read it back: computed once, and later
    readers fetch only the columns they use."""
    path = work_path(df.sparkSession, name)
    with short_shuffles(df.sparkSession):
        df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
