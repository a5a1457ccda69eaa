"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, so equal texts give equal chunks.
Every distinct chunk travels once per task, to be compared byte by byte with the chunks of the
same digest; that makes digests verified identifiers. A text is then its list of identifiers,
and only those lists are compared: long texts never move again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subloom.llm.words import as_text
from subloom.session import materialize, write_through

# Chunk sizes in bytes: no cut before the least, one at the most, else by content.
LEAST, MOST, CUT_BITS = 2_048, 32_768, 12
# A task forgets the chunks it has sent beyond so many bytes.
SENT_BYTES = 32_000_000
# A group is joined apart beyond so many rows, and beyond this share of all rows; so there are at
# most ``SHARE`` such groups.
COPIES, SHARE = 1_000, 100_000
GEAR = np.random.default_rng(17).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Chunk ends. The hash of a position covers the 32 bytes that end there."""
    if len(data) <= LEAST:
        return [len(data)]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    marks = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, at = [], 0
    while len(data) - at > LEAST:
        k = np.searchsorted(marks, at + LEAST)
        end = int(marks[k]) if k < len(marks) else len(data)
        at = min(end, at + MOST, len(data))
        ends.append(at)
    if at < len(data):
        ends.append(len(data))
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def normalized(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null counts as empty."""
    return (text or "").encode().lower()


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest_bytes: int = 16,
) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256, recipe), one per row of ``docs``.

    Texts are equal when they are after lower-casing A-Z; null and empty are equal. Of equal
    texts the largest id stays. Rows that repeat an id and its text are all marked as that
    document is. A null id stays only where the whole group has none. ``recipe`` is the list of
    chunk identifiers. Other columns are not read. An empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType
    rows = docs.select(as_text(F.col(id_column)).alias("id"), F.col(text_column).alias("text"))

    def digest(chunk: bytes) -> bytes:
        return hashlib.blake2b(chunk, digest_size=digest_bytes).digest()

    def recipes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [normalized(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "recipe": [b"".join(map(digest, chunks(t))) for t in texts],
                    "n_bytes": [len(t) for t in texts],
                    "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
                }
            )

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[bytes] = set()
        size = 0
        for batch in batches:
            fresh = []
            for text in batch["text"]:
                for chunk in chunks(normalized(text)):
                    if chunk not in sent:
                        sent.add(chunk)
                        fresh.append(chunk)
                        size += len(chunk)
                if size > SENT_BYTES:
                    yield pd.DataFrame({"digest": map(digest, fresh), "chunk": fresh})
                    sent, size, fresh = set(), 0, []
            yield pd.DataFrame({"digest": list(map(digest, fresh)), "chunk": fresh})

    schema = "id string, recipe binary, n_bytes long, text_sha256 string"
    made = rows.mapInPandas(recipes, schema).withColumn("id", F.col("id").cast(kind))
    found = write_through(made, "recipes")
    distinct = (
        rows.select("text")
        .mapInPandas(contents, "digest binary, chunk binary")
        .repartition("digest")
        .dropDuplicates(["digest", "chunk"])
    )
    shared = materialize(
        distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    )
    if not shared.isEmpty():
        found = _refined(rows, distinct, shared, found, digest)
    same = found.groupBy("recipe", "n_bytes").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    out = _with_group(found, same, ["recipe", "n_bytes"])
    return out.select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "recipe",
    )


def _with_group(found: DataFrame, same: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group's columns. Rows of very large groups are not gathered: their groups,
    at most ``SHARE`` of them, go to the rows."""
    least = max(COPIES, found.count() // SHARE)
    large = materialize(same.filter(F.col("group_size") > least))
    if large.isEmpty():
        return found.join(same, keys)
    others = found.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return others.join(same, keys).unionByName(found.join(F.broadcast(large), keys))


def _refined(rows, distinct, shared, found, digest) -> DataFrame:
    """Recipes in which a digest that stands for several contents carries its content's number.
    Taken only when there is such a digest; then each different text is chunked once more."""
    order = Window.partitionBy("digest").orderBy("chunk")
    numbered = materialize(
        distinct.join(shared, "digest", "left_semi").withColumn("variant", F.row_number().over(order))
    )

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                data = normalized(text)
                name = hashlib.sha256(data).hexdigest()
                out += [(name, len(data), i, digest(c), c) for i, c in enumerate(chunks(data))]
            yield pd.DataFrame(out, columns=["text_sha256", "n_bytes", "i", "digest", "chunk"])

    schema = "text_sha256 string, n_bytes long, i int, digest binary, chunk binary"
    parts = rows.select("text").mapInPandas(listed, schema).dropDuplicates()
    mark = F.concat(F.hex("digest"), F.lpad(F.hex(F.coalesce("variant", F.lit(0))), 8, "0"))
    lists = (
        parts.join(numbered, ["digest", "chunk"], "left")
        .groupBy("text_sha256", "n_bytes")
        .agg(F.array_sort(F.collect_set(F.struct("i", mark.alias("mark")))).alias("marks"))
        .select("text_sha256", "n_bytes", F.unhex(F.array_join("marks.mark", "")).alias("recipe"))
    )
    return found.drop("recipe").join(lists, ["text_sha256", "n_bytes"])
