"""Category codes, one-hot columns, brand flags and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subloom.functions.numeric import flag
from subloom.operators.assemble import fill_constant
from subloom.operators.skew import BROADCAST_ROWS, checked_broadcast
from subloom.session import materialize

# Above this many levels a dense one-hot table is refused.
MAX_DENSE_LEVELS = 1_000
# Up to this many levels a column is encoded without a join.
LITERAL_LEVELS = 128

# Brand flag -> spellings.
BRANDS = {
    "unknown": ["**"],
    "apple": ["苹果"],
    "huawei": ["华为", "荣耀"],
    "xiaomi": ["小米"],
    "vivo": ["vivo"],
    "oppo": ["oppo"],
    "samsung": ["三星"],
    "meizu": ["魅族"],
    "lenovo": ["联想"],
    "leshi": ["乐视"],
    "coolpad": ["酷派"],
    "bbk": ["步步高"],
    "Nokia": ["诺基亚", "Nokia"],
    "jinli": ["金立"],
    "zte": ["中兴"],
    "smartisan": ["锤子"],
    "htc": ["HTC"],
    "tianyu": ["天语"],
}


@dataclass(frozen=True)
class Levels:
    """Codes of every level: rows (item, value, code), and how many each column has."""

    frame: DataFrame
    sizes: dict[str, int]


def fit_levels(df: DataFrame, columns: Sequence[str]) -> Levels:
    """Number the distinct values of each column from 0 in their natural order.

    One pass for all columns; repeated values collapse before the shuffle. The levels are
    sorted by range over the cluster and numbered by position, never gathered in one task.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("item"),
                (
                    F.col(c).cast("double")
                    if isinstance(types[c], T.NumericType)
                    else F.lit(None).cast("double")
                ).alias("number"),
                F.col(c).cast("string").alias("value"),
            )
            for c in columns
        ]
    )
    distinct = (
        df.select(F.explode(cells).alias("c")).select("c.*").filter("value is not null").distinct()
    )
    ordered = materialize(distinct.orderBy("item", "number", "value"))
    counts = (
        ordered.groupBy(F.spark_partition_id().alias("part"), "item").count().collect()
    )
    sizes = {c: 0 for c in columns}
    before: dict[int, int] = {}
    for row in counts:
        sizes[row["item"]] += row["count"]
        before[row["part"]] = before.get(row["part"], 0) + row["count"]
    start, offsets = 0, {}
    for part in sorted(before):
        offsets[part], start = start, start + before[part]
    firsts, start = {}, 0
    for c in sorted(columns):
        firsts[c], start = start, start + sizes[c]
    if not before:
        return Levels(ordered.select("item", "value", F.lit(0).alias("code")), sizes)
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    position = _lookup(offsets, F.spark_partition_id()) + in_part
    code = position - _lookup(firsts, F.col("item"))
    return Levels(ordered.select("item", "value", code.cast("int").alias("code")), sizes)


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), key)


def encode(df: DataFrame, levels: Levels, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its code; values without one (nulls) stay null.

    Short level lists become literals, so nothing is joined; medium ones are broadcast; long
    ones are joined by shuffle.
    """
    short = [c for c in columns if levels.sizes[c] <= LITERAL_LEVELS]
    values = {c: [] for c in short}
    rows = levels.frame.filter(F.col("item").isin(short)).collect() if short else []
    for row in sorted(rows, key=lambda r: r["code"]):
        values[row["item"]].append(row["value"])
    out, codes = df, {}
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        if c in short:
            known = F.array(*[F.lit(v) for v in values[c]]).cast("array<string>")
            codes[c] = F.nullif(F.array_position(known, text), F.lit(0)) - 1
            continue
        side = levels.frame.filter(F.col("item") == c).select(
            F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}")
        )
        if levels.sizes[c] <= BROADCAST_ROWS:
            side = F.broadcast(side)
        out = out.join(side, text == F.col(f"_value{i}"), "left")
        codes[c] = F.col(f"_code{i}")
    return out.select(*[codes[c].cast("int").alias(c) if c in codes else c for c in df.columns])


def encode_categories(
    df: DataFrame, columns: Sequence[str], null_code: int | None = -1
) -> DataFrame:
    """Sorted codes over the whole frame, which is read twice: store a costly one first. Nulls first become ``null_code``, a level like any
    other; with None they stay null."""
    filled = df if null_code is None else fill_constant(df, columns, null_code)
    return encode(filled, fit_levels(filled, columns), columns)


def one_hot(df: DataFrame, columns: Sequence[str], limit: int = MAX_DENSE_LEVELS) -> DataFrame:
    """A 0/1 column ``{column}_{value}`` per level in place of each column.

    The frame is read twice: store a costly one first. Values count as text and null is a level of its own, ``nan``. A column with more than
    ``limit`` levels is refused, because a table has no room for so many columns; use
    ``one_hot_vectors`` for it.
    """
    text = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns})
    levels = fit_levels(text, columns)
    large = {c: n for c, n in levels.sizes.items() if n > limit}
    if large:
        raise ValueError(f"too many levels for dense columns: {large}")
    rows = sorted(levels.frame.collect(), key=lambda r: (r["item"], r["code"]))
    flags = {
        f"{r['item']}_{r['value']}": (F.col(r["item"]) == r["value"]).cast("int") for r in rows
    }
    kept = [c for c in df.columns if c not in columns]
    return text.select(*kept, *[e.alias(n) for n, e in flags.items()])


def one_hot_vectors(
    df: DataFrame, columns: Sequence[str], suffix: str = "_levels"
) -> tuple[DataFrame, Levels]:
    """A sparse 0/1 vector ``{column}{suffix}`` with a place per level in place of each column, for
    any number of levels, and the levels: the code of a level is its place.

    The frame is read twice: store a costly one first. Values count as text and null is a level of
    its own, ``nan``. The vectors go into a feature matrix as they are.
    """
    text = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns})
    levels = fit_levels(text, columns)
    coded = encode(text, levels, columns)
    model = OneHotEncoder(
        inputCols=list(columns), outputCols=[f"{c}{suffix}" for c in columns], dropLast=False
    ).fit(coded)
    return model.transform(coded).drop(*columns), levels


def brand_flags(brand: Column) -> dict[str, Column]:
    return {f"is_{name}": flag(brand.isin(spellings)) for name, spellings in BRANDS.items()}


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a lookup table on one or several keys, broadcast if counted small."""
    return df.join(checked_broadcast(table), list(keys), "left")
