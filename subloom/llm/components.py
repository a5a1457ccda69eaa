"""Connected components of a graph held as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every node on the least of all."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of ``edges`` (a, b): root is the least node that can be
    reached, itself included. Rounds of large and small stars until nothing moves; each round is
    checkpointed, and a node with many neighbours is one minimum and one split join."""
    now = materialize(edges.filter("a <> b").select("a", "b").distinct())
    mark = lambda df: tuple(
        df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )
    last = None
    while (state := mark(now)) != last:
        last = state
        now = materialize(_star(_star(now, True), False))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
