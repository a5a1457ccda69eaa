"""Benchmark items inside documents, by size-partitioned MinHash containment.

The items, not the documents, carry sketches: the least ``k`` shingle hashes of each item. An item
of which at least ``threshold`` is in a document misses fewer than ``k`` shingles there when ``k``
is chosen from the size class, so at least one of its sketch is in the document, however long
that is. What the sketches find is verified by counting the item's shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subloom.llm.words import SHINGLE, let, runs_of, word_list
from subloom.operators.skew import checked_broadcast
from subloom.session import materialize


def item_shingles(items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """Rows (item, length, shingle, item_shingles): distinct runs of five words, or all words of
    a shorter item, which then is one run of that length."""
    listed = items.select(
        F.col(item_column).alias("item"), word_list(F.col(text_column)).alias("words")
    ).filter("item IS NOT NULL AND size(words) > 0")
    rows = []
    for length in range(1, SHINGLE + 1):
        fits = F.size("words") == length if length < SHINGLE else F.size("words") >= length
        rows.append(
            listed.filter(fits).select(
                "item",
                F.lit(length).alias("length"),
                F.explode(F.array_distinct(runs_of(F.col("words"), length))).alias("shingle"),
            )
        )
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    out = out.distinct()
    sizes = out.groupBy("item").agg(F.count(F.lit(1)).alias("item_shingles"))
    return out.join(sizes, "item")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """The least ``floor((1 - threshold) * u) + 1`` shingles of each item, where ``u`` is the
    upper end of its size class, a power of two."""
    lists = shingles.groupBy("item", "item_shingles").agg(
        F.array_sort(F.collect_set(F.struct("shingle", "length"))).alias("least")
    )
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("item_shingles")))
    k = F.floor(F.round((1 - threshold) * upper, 6)).cast("int") + 1
    return lists.select(F.explode(F.slice("least", F.lit(1), k)).alias("s")).select(
        "s.shingle", "s.length"
    ).distinct()


def document_runs(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (doc, length, shingle) for every run of the given lengths in (doc, text)."""

    def tagged(length: int) -> Callable[[Column], Column]:
        return lambda h: F.struct(F.lit(length).alias("length"), h.alias("shingle"))

    def runs(words: Column) -> Column:
        return F.concat(*[F.transform(runs_of(words, n), tagged(n)) for n in lengths])

    # Outer, so that Spark doesn't compute the list once more to see whether it is empty.
    if len(lengths) == 1:
        hashes = runs_of(word_list(F.col("text")), lengths[0])
        out = docs.select("doc", F.lit(lengths[0]).alias("length"), F.explode_outer(hashes).alias("shingle"))
    else:
        out = docs.select("doc", F.explode_outer(let(word_list(F.col("text")), runs)).alias("s")).select("doc", "s.*")
    return out.filter("shingle IS NOT NULL")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.75,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Rows (id, item, item_shingles, shared, containment): documents that hold at least
    ``threshold`` of an item's distinct shingles (five words; an item of fewer words is one run
    of all its words). Words are taken after lower-casing A-Z.

    Null and empty texts hold nothing and are held by nothing; so are rows with a null id. Rows
    that repeat an id count as one document or item. Other columns are not read. Sketches and
    item shingles are broadcast only if counting shows them small; Spark joins them by shuffle
    otherwise. No documents or no items give no rows.
    """
    shingles = materialize(item_shingles(items, item_column, item_text_column))
    lengths = sorted(r[0] for r in shingles.select("length").distinct().collect()) or [SHINGLE]
    rows = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    rows = rows.filter("doc IS NOT NULL")
    sketch = materialize(sketches(shingles, threshold))
    on = ["length", "shingle"]
    found = materialize(
        document_runs(rows, lengths)
        .join(checked_broadcast(sketch), on, "left_semi")
        .join(checked_broadcast(shingles.drop("item_shingles")), on)
        .select("doc", "item")
        .distinct()
    )
    suspects = materialize(found.select("doc").distinct())
    held = (
        document_runs(rows.join(checked_broadcast(suspects), "doc", "left_semi"), lengths)
        .join(checked_broadcast(shingles), on)
        .distinct()
        .join(found, ["doc", "item"], "left_semi")
        .groupBy("doc", "item", "item_shingles")
        .agg(F.count(F.lit(1)).alias("shared"))
        .withColumn("containment", F.col("shared") / F.col("item_shingles"))
        .filter(F.col("containment") >= threshold)
    )
    return held.withColumnsRenamed({"doc": id_column, "item": item_column})
