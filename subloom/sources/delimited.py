"""Headerless delimited extracts and headered lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subloom.functions.numeric import nan_to_null
from subloom.operators.profiles import tag_and_union
from subloom.session import write_through

# Charsets Spark reads without the legacy switch.
_PLAIN_CHARSETS = {"UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE"}

# Date layouts, with and without a time of day.
DATE_FORMATS = (
    "yyyyMMdd",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "yyyyMMddHHmmss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
)


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Spark reads and writes few charsets unless told to accept all of Java's."""
    if encoding.upper() not in _PLAIN_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    encoding: str = "UTF-8",
    sep: str = "|",
    header: bool = False,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Columns by position with the given types, never inferred.

    Dates and times (``TIMESTAMP_NTZ``) are read as text and parsed leniently: a value in none of
    the formats becomes null instead of failing the job; ``read_checked`` lists what is lost. A
    date leaves out a time of day, a time keeps it (``with_times``). A charset outside
    ``_PLAIN_CHARSETS`` switches the session to accept all of Java's.
    """
    wanted = _struct(schema)
    allow_charset(spark, encoding)
    raw = T.StructType(
        [T.StructField(f.name, T.StringType() if _is_day(f) else f.dataType) for f in wanted]
    )
    df = spark.read.csv(path, schema=raw, sep=sep, encoding=encoding, header=header)
    days = {f.name: _parsed(f, date_formats) for f in wanted if _is_day(f)}
    return nan_to_null(df.withColumns(days))


@dataclass(frozen=True)
class Extract:
    """``rows`` of the wanted columns; ``rejects`` (file, text, reason) of lines left out; and
    ``counts``: of 'rows', 'rejects', 'malformed' lines, and of unreadable values by column."""

    rows: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def read_checked(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    encoding: str = "UTF-8",
    sep: str = "|",
    header: bool = False,
    date_formats: Sequence[str] = DATE_FORMATS,
    keep_unreadable: bool = False,
) -> Extract:
    """As ``read_delimited``, but lines that can't be read become a table of their own.

    A line is malformed when it has too few or too many fields; a value is unreadable when it is
    not blank and not of its column's type. ``reason`` is 'malformed' or the names of the columns,
    ``text`` the line. With ``keep_unreadable`` unreadable values are counted and become null, and
    only malformed lines are left out. The files are read once: rows and rejects are stored
    together, apart by folder, and counted on the way.
    """
    wanted = _struct(schema)
    allow_charset(spark, encoding)
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])
    lines = spark.read.csv(
        path,
        schema=T.StructType([*raw.fields, T.StructField(_LINE, T.StringType())]),
        sep=sep,
        encoding=encoding,
        header=header,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=_LINE,
    )
    values = {f.name: _value(f, date_formats) for f in wanted}
    malformed = F.col(_LINE).isNotNull()
    bad = {
        c: ~malformed & (F.trim(F.col(c)) != "") & v.isNull() for c, v in values.items()
    }
    bad = {c: F.coalesce(b, F.lit(False)) for c, b in bad.items()}
    names = F.concat_ws(", ", *[F.when(b, F.lit(c)) for c, b in bad.items()])
    reason = F.when(malformed, "malformed").otherwise(names)
    refused = malformed if keep_unreadable else reason != ""
    fields = F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit("")) for c in values])
    checked = lines.select(
        *[v.alias(c) for c, v in values.items()],
        F.col("_metadata.file_path").alias("_file"),
        F.when(refused, F.coalesce(_LINE, fields)).alias("_text"),
        reason.alias("_reason"),
        refused.alias("_refused"),
        *[b.alias(f"_bad_{c}") for c, b in bad.items()],
    )
    seen = Observation()
    counted = checked.observe(
        seen,
        F.count_if(~F.col("_refused")).alias("rows"),
        F.count_if("_refused").alias("rejects"),
        F.count_if(F.col("_reason") == "malformed").alias("malformed"),
        *[F.count_if(f"_bad_{c}").alias(f"_bad_{c}") for c in bad],
    ).drop(*[f"_bad_{c}" for c in bad])
    stored = write_through(counted, "extract", ["_refused"])
    rejects = stored.filter("_refused").select(
        F.col("_file").alias("file"), F.col("_text").alias("text"), F.col("_reason").alias("reason")
    )
    counts = {c.removeprefix("_bad_"): int(n) for c, n in seen.get.items()}
    return Extract(nan_to_null(stored.filter("NOT _refused").select(*values)), rejects, counts)


_LINE = "_line"


def with_times(schema: str | T.StructType) -> T.StructType:
    """The schema with its dates as times without a zone."""
    return T.StructType(
        [
            T.StructField(f.name, T.TimestampNTZType() if isinstance(f.dataType, T.DateType) else f.dataType)
            for f in _struct(schema)
        ]
    )


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _is_day(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DateType, T.TimestampNTZType))


def _value(field: T.StructField, formats: Sequence[str]) -> Column:
    if _is_day(field):
        return _parsed(field, formats)
    text = F.col(field.name)
    return text if isinstance(field.dataType, T.StringType) else text.try_cast(field.dataType)


def _parsed(field: T.StructField, formats: Sequence[str]) -> Column:
    text = F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        return F.coalesce(*[F.try_to_date(text, p) for p in formats])
    times = [F.try_to_timestamp(text, F.lit(p)) for p in formats]
    return F.coalesce(*times).cast("timestamp_ntz")


def read_lookup(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return read_delimited(spark, path, schema, sep=",", header=True)


def read_extracts(
    spark: SparkSession,
    train: Mapping[str, str],
    test: Mapping[str, str],
    schemas: Mapping[str, str],
    unused: Mapping[str, Sequence[str]],
    encodings: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All tables of a pipeline: train and test files unioned, each row tagged in ``split``,
    unused columns left out. ``train`` and ``test`` map table names to paths."""
    encodings = encodings or {}
    return {
        name: tag_and_union(
            *[
                read_delimited(spark, paths[name], ddl, encodings.get(name, "UTF-8"))
                for paths in (train, test)
            ]
        ).drop(*unused[name])
        for name, ddl in schemas.items()
    }
