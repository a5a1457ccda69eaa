"""Seconds per query, as one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8),
BENCH_QUERIES optionally the queries, separated by commas. Learning queries run over the tables in
BENCH_LEARNING_DIR (not at all if that is not set) and are listed apart.
"""

from __future__ import annotations

import json
import os
import sys
import time

from subloom.plans.queries import LEARNING, RELATIONAL
from subloom.session import build_session


# Python workers import the package, wherever this is started from.
ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else [*RELATIONAL, *LEARNING]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = {**RELATIONAL, **LEARNING}

    def timed(wanted: list[str], folder: str) -> dict[str, float]:
        seconds = {}
        for name in wanted:
            start = time.perf_counter()
            df = queries[name](spark, folder)
            df.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
            print(name, seconds[name], file=sys.stderr)
        return seconds

    seconds = timed([n for n in names if n in RELATIONAL], folder)
    small = os.environ.get("BENCH_LEARNING_DIR")
    learning = timed([n for n in names if n in LEARNING], small) if small else {}
    print(
        json.dumps(
            {
                "metric": "relational_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "learning": learning,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
