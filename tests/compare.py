"""Run queries beside their SQL and report differences.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
    benchmark labels conversations""".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _normal(rows, order):
    out = []
    for row in rows:
        cells = tuple(row[i] for i in order)
        out.append(tuple(None if isinstance(c, float) and c != c else c for c in cells))
    return sorted(out, key=lambda r: tuple((c is not None, str(type(c)), c if c is not None else 0) for c in r))


def _kind(name: str) -> str:
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN"}
    return kinds.get(name, name)


def differences(df, con, sql: str) -> list[str]:
    """Empty when schema, row count and all values agree exactly."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"only spark {set(df.columns) - set(names)}, only sql {set(names) - set(df.columns)}"]
    for name, kind in df.dtypes:
        if _kind(kind) != types[name]:
            problems.append(f"type of {name}: spark {kind}, sql {types[name]}")
    order = sorted(names)
    got = _normal([tuple(r) for r in df.collect()], [df.columns.index(n) for n in order])
    want = _normal(expected, [names.index(n) for n in order])
    if len(got) != len(want):
        problems.append(f"rows: spark {len(got)}, sql {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [f"{n}: {x!r} / {y!r}" for n, x, y in zip(order, g, w) if x != y]
        problems.append(f"{len(bad)} rows differ, first: {cells[:6]}")
    return problems


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from subloom.session import build_session

    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con, oracles, failed = connect(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                problems = differences(df, con, oracles[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:  # report and go on
            problems = [str(error)[:1500]]
        failed += bool(problems)
        print(name, "ok" if not problems else problems, f"{time.time() - start:.1f}s", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
