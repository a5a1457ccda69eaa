"""Per-user statistics over sets of periods: cumulative trailing windows and single periods.

One pass per source table. Ordinary users are gathered into one small array of rows (a single
shuffle that moves each source row once) and every statistic is read off that array. Users
with more rows than one task should hold go through aggregates with map-side combine and
bracketed medians instead; both give the same numbers. Distinct counts and modes come from
value counts, which spread a large user over the cluster by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subloom.functions.numeric import nan_to_null
from subloom.operators.medians import exact_medians
from subloom.operators.skew import HeavyKeys

NUMERIC_STATS = ("mean", "max", "min", "median", "sum", "count")
VALUE_STATS = ("nunique", "mode")


@dataclass(frozen=True)
class PeriodSpec:
    """Statistics wanted of one column.

    ``sets`` limits them to some period sets; ``where`` leaves out rows for this column only;
    ``labels`` replaces the ``{name}_{stat}`` part of an output name.
    """

    column: str
    stats: Sequence[str]
    sets: Sequence[str] | None = None
    where: Column | None = None
    name: str | None = None
    labels: Mapping[str, str] = field(default_factory=dict)

    def output(self, set_name: str, stat: str) -> str:
        return f"{set_name}_{self.labels.get(stat, f'{self.name or self.column}_{stat}')}"


def trailing_sets(periods: Sequence, template: str = "{}mon") -> dict[str, list]:
    """The newest period, the newest two, the newest three and so on."""
    return {template.format(n): list(periods[:n]) for n in range(1, len(periods) + 1)}


def single_sets(periods: Sequence, template: str = "{}") -> dict[str, list]:
    return {template.format(p): [p] for p in periods}


@dataclass(frozen=True)
class _Measure:
    """One input column, under a short name, with the (set, stat, output) wanted of it."""

    name: str
    source: Column
    wanted: tuple[tuple[str, str, str], ...]

    def stats(self) -> set[str]:
        return {stat for _, stat, _ in self.wanted}


def period_features(
    df: DataFrame,
    key: str,
    period_col: str,
    period_sets: Mapping[str, Sequence],
    specs: Sequence[PeriodSpec],
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """One row per key with any row in the periods; columns ``{set}_{name}_{stat}``.

    Sums and counts are 0 and other statistics null where a set holds no values.
    """
    periods = list(dict.fromkeys(p for ps in period_sets.values() for p in ps))
    rows = df.filter(F.col(period_col).isin(periods) & F.col(key).isNotNull())
    numeric = _measures(specs, period_sets, NUMERIC_STATS)
    valued = _measures(specs, period_sets, VALUE_STATS)

    parts = []
    if numeric:
        narrow = _narrow(rows, key, period_col, numeric)
        if heavy is None:
            parts.append(_from_arrays(narrow, key, periods, period_sets, numeric))
        else:
            light = _from_arrays(heavy.without(narrow), key, periods, period_sets, numeric)
            large = _from_partials(
                heavy.only(narrow), key, periods, period_sets, numeric, heavy.count
            )
            parts.append(light.unionByName(large))
    if valued:
        narrow = _narrow(rows, key, period_col, valued)
        parts.append(_from_value_counts(narrow, key, periods, period_sets, valued))
    features = reduce(lambda left, right: left.join(right, key), parts)
    names = [s.output(n, stat) for n in period_sets for s in specs if _uses(s, n) for stat in s.stats]
    return features.select(key, *names)


def _uses(spec: PeriodSpec, set_name: str) -> bool:
    return spec.sets is None or set_name in spec.sets


def _measures(specs, period_sets, kinds) -> list[_Measure]:
    """Specs of the same column over the same rows share one measure."""
    unknown = {s for spec in specs for s in spec.stats} - set(NUMERIC_STATS) - set(VALUE_STATS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    grouped: dict[tuple, list] = {}
    for i, spec in enumerate(specs):
        wanted = [
            (n, stat, spec.output(n, stat))
            for n in period_sets
            if _uses(spec, n)
            for stat in spec.stats
            if stat in kinds
        ]
        if wanted:
            whole = spec.where is None
            value = F.col(spec.column)
            source = value if whole else F.when(spec.where, value)
            grouped.setdefault((spec.column, None if whole else i), [source, []])[1].extend(wanted)
    return [
        _Measure(f"v{i}", source, tuple(wanted))
        for i, (source, wanted) in enumerate(grouped.values())
    ]


def _narrow(rows: DataFrame, key: str, period_col: str, measures: Sequence[_Measure]) -> DataFrame:
    """NaN counts as missing, on every path."""
    return nan_to_null(
        rows.select(
            key, F.col(period_col).alias("period"), *[m.source.alias(m.name) for m in measures]
        )
    )


def _sum_type(df: DataFrame, name: str) -> str:
    return "bigint" if isinstance(df.schema[name].dataType, T.IntegralType) else "double"


def _from_arrays(df, key, periods, period_sets, measures) -> DataFrame:
    """Written as SQL text: hundreds of columns are costly to build one call at a time."""
    packed = df.groupBy(key).agg(
        F.collect_list(F.struct("period", *[m.name for m in measures])).alias("rows")
    )
    names = list(period_sets)
    wanted = {}
    for m in measures:
        for n, stat, _ in m.wanted:
            wanted.setdefault((m.name, names.index(n)), set()).add(stat)
    by_set = packed.selectExpr(
        f"`{key}`",
        *[
            f"{_rows_in('rows', period_sets[names[i]], periods)} AS s{i}"
            for i in sorted({i for _, i in wanted})
        ],
    )
    arrays = by_set.selectExpr(
        f"`{key}`",
        *[
            f"{'sort_array' if 'median' in stats else ''}(array_compact(s{i}.{v})) AS {v}_{i}"
            for (v, i), stats in wanted.items()
        ],
    )
    types = {m.name: _sum_type(df, m.name) for m in measures}
    return arrays.selectExpr(
        f"`{key}`",
        *[
            f"{_array_stat(f'{m.name}_{names.index(n)}', stat, types[m.name])} AS `{output}`"
            for m in measures
            for n, stat, output in m.wanted
        ],
    )


def _rows_in(rows: str, wanted: Sequence, periods: Sequence) -> str:
    if set(wanted) == set(periods):
        return rows
    values = ", ".join(f"'{p}'" if isinstance(p, str) else str(p) for p in wanted)
    return f"filter({rows}, row -> row.period IN ({values}))"


def _array_stat(values: str, stat: str, sum_type: str) -> str:
    total = f"aggregate({values}, CAST(0 AS {sum_type}), (total, x) -> total + x)"
    middle = f"get({values}, (size({values}) - 1) div 2) + get({values}, size({values}) div 2)"
    return {
        "count": f"CAST(size({values}) AS BIGINT)",
        "max": f"array_max({values})",
        "min": f"array_min({values})",
        "median": f"({middle}) / 2",
        "sum": total,
        "mean": f"try_divide(CAST({total} AS DOUBLE), size({values}))",
    }[stat]


def _from_partials(df, key, periods, period_sets, measures, key_count: int) -> DataFrame:
    partial = df.groupBy(key, "period").agg(
        *[
            agg(m.name).alias(f"{m.name}_{tag}")
            for m in measures
            for tag, agg in (("sum", F.sum), ("count", F.count), ("max", F.max), ("min", F.min))
        ]
    )
    kept = [c for c in partial.columns if c not in (key, "period")]
    wide = partial.groupBy(key).agg(
        *[
            F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{c}_{j}")
            for j, p in enumerate(periods)
            for c in kept
        ]
    )
    types = {m.name: _sum_type(df, m.name) for m in measures}

    def combined(m: _Measure, set_name: str, stat: str) -> Column:
        at = [periods.index(p) for p in period_sets[set_name]]
        cells = lambda tag: [F.col(f"{m.name}_{tag}_{j}") for j in at]
        if stat in ("max", "min"):
            pick = F.greatest if stat == "max" else F.least
            return pick(*cells(stat)) if len(at) > 1 else cells(stat)[0]
        total = reduce(add, [F.coalesce(c, F.lit(0).cast(types[m.name])) for c in cells("sum")])
        count = reduce(add, [F.coalesce(c, F.lit(0).cast("long")) for c in cells("count")])
        return {"sum": total, "count": count}.get(
            stat, F.try_divide(total.cast("double"), count)
        )

    plain = wide.select(
        key,
        *[
            combined(m, n, stat).alias(output)
            for m in measures
            for n, stat, output in m.wanted
            if stat != "median"
        ],
    )
    with_median = [m for m in measures if "median" in m.stats()]
    if not with_median:
        return plain
    by_set = exact_medians(
        df,
        [key],
        [m.name for m in with_median],
        group_bound=key_count,
        period_col="period",
        period_sets=period_sets,
    )
    medians = by_set.groupBy(key).agg(
        *[
            F.max(F.when(F.col("set") == n, F.col(m.name))).alias(output)
            for m in with_median
            for n, stat, output in m.wanted
            if stat == "median"
        ]
    )
    return plain.join(medians, key)


def _from_value_counts(df, key, periods, period_sets, measures) -> DataFrame:
    numbered = list(enumerate(measures))
    types = {m.name: df.schema[m.name].dataType for m in measures}

    def cell(i: int) -> Column:
        return F.struct(
            F.lit(i).alias("item"),
            *[
                (F.col(m.name) if j == i else F.lit(None).cast(types[m.name])).alias(m.name)
                for j, m in numbered
            ],
        )

    long = df.select(key, "period", F.explode(F.array(*[cell(i) for i, _ in numbered])).alias("c"))
    counted = long.groupBy(key, "c.item", *[f"c.{m.name}" for m in measures]).agg(
        *[
            F.count(F.when(F.col("period") == p, F.lit(1))).alias(f"n{j}")
            for j, p in enumerate(periods)
        ]
    )

    def seen(i: int, m: _Measure, set_name: str) -> tuple[Column, Column]:
        times = reduce(add, [F.col(f"n{periods.index(p)}") for p in period_sets[set_name]])
        return (F.col("item") == i) & F.col(m.name).isNotNull() & (times > 0), times

    def stat_of(i: int, m: _Measure, set_name: str, stat: str) -> Column:
        present, times = seen(i, m, set_name)
        if stat == "nunique":
            return F.count(F.when(present, F.lit(1)))
        best = F.min(F.when(present, F.struct((-times).alias("rank"), F.col(m.name).alias("value"))))
        return best["value"]

    return counted.groupBy(key).agg(
        *[stat_of(i, m, n, stat).alias(output) for i, m in numbered for n, stat, output in m.wanted]
    )
