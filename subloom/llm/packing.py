"""Best-fit-decreasing packing of token pieces into sequences of fixed length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.llm.token_counts import encoder
from subloom.llm.words import as_text
from subloom.session import write_through

# Pieces packed together; more pieces make more groups, whatever the key distribution.
GROUP_PIECES = 20_000


def token_pieces(
    docs: DataFrame,
    path: str,
    limit: int,
    end_id: int = 0,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``,
    cut into pieces of ``limit`` ids, the last one shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, ids in zip(batch["id"], enc.texts(batch["text"])):
                ids += end
                for k in range(math.ceil(len(ids) / 4 / limit)):
                    part = ids[4 * limit * k : 4 * limit * (k + 1)]
                    row = (key, k, limit * k, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4")) if with_ids else row)
            out = pd.DataFrame(rows, columns=names)
            yield out

    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[id_column].dataType
    schema = "id string, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(as_text(F.col(id_column)).alias("id"), F.col(text_column).alias("text"))
    pieces = rows.mapInPandas(cut, schema + ", ids array<long>" * with_ids)
    return pieces.withColumn("id", F.col("id").cast(kind))


class CapacityTree:
    """Segment tree over remaining capacities 0..limit: which have an open bin."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += change
            at >>= 1

    def tightest(self, length: int) -> int:
        """The least capacity of at least ``length`` that has an open bin, or -1."""
        at, tree = length + self.leaves, self.open
        if tree[at]:
            return length
        while at > 1:  # up to the first right neighbour that holds a bin, then down to its left
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(lengths: list[int], limit: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; the longest are placed first, ties in the given order."""
    tree, bins = CapacityTree(limit), [[] for _ in range(limit + 1)]
    place, offset, used = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        capacity = tree.tightest(lengths[i])
        if capacity < 0:
            capacity, at, used = limit, used, used + 1
        else:
            at = bins[capacity].pop()
            tree.add(capacity, -1)
        place[i], offset[i] = at, limit - capacity
        if left := capacity - lengths[i]:
            bins[left].append(at)
            tree.add(left, 1)
    return place, offset


def pack(pieces: DataFrame, limit: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add (sequence_id, offset) to stored ``pieces`` with a ``length`` of 1 to ``limit``.

    Pieces are dealt at random into groups of about ``group_pieces``, so every group has the
    corpus's mix of lengths and wastes at most its last sequences; each group is packed by
    best-fit decreasing in one task. Only the piece's columns move. Full pieces are sequences of
    their own group like the others. No piece, no row.
    """
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "piece"], kind="stable")
        bins, offsets = best_fit(group["length"].tolist(), limit)
        first = int(group["grp"].iloc[0]) << 32
        return group.assign(sequence_id=np.add(bins, first), offset=offsets).drop(columns="grp")

    kind = pieces.schema["id"].dataType
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "piece", F.lit(5)), F.lit(groups)))
    dealt = dealt.withColumn("id", as_text(F.col("id")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.drop("grp").schema)
    placed = dealt.groupBy("grp").applyInPandas(
        place, f"{fields}, sequence_id long, offset long"
    )
    return placed.withColumn("id", F.col("id").cast(kind))


def pack_documents(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Documents as packed training sequences: rows (id, piece, start, length, ids_crc32[, ids],
    sequence_id, offset), one per piece. ``with_ids`` adds the ids themselves.

    Null and empty texts are the end id alone. Repeated rows are packed each. Texts of any length
    are cut, never shortened. Other columns are not read. An empty table gives no rows.
    """
    pieces = token_pieces(docs, path, limit, end_id, with_ids, id_column, text_column)
    stored = write_through(pieces, "pieces")
    return pack(stored, limit).withColumnRenamed("id", id_column)
