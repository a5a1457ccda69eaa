"""Repeated byte strings by grouping hashes at content-aligned samples.

This takes the place of a suffix array: no suffix is compared or ranked by its bytes and there is
no periodic difference cover. Strings are equal when their 64-bit hashes are. Of every ``length``
bytes the position with the least rolling hash is sampled, so equal strings have their sample at
the same offset, and about one position in 85 is kept at 200 bytes.

1. Samples are dealt into buckets by the hash of their first bytes and grouped one bucket at a
   time by that hash and the hash of the whole stretch of strings that have this sample: equal
   stretches are repeated as a whole, a sample that occurs once ends here.
2. Only where a sample is repeated but its stretch isn't, the strings at every byte of the stretch
   are grouped by their hashes, again one bucket at a time.

A task first settles what repeats among its own documents and sends one of each, so a frequent
passage is as many entries as there are batches. No task holds more than a bucket. A bucket answers
in one row for each block of documents, not for each document, which has samples in most buckets; a
block then gives one row for each of its documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subloom.llm.arrays import BYTE, mixed, pack, unpack
from subloom.llm.words import as_text
from subloom.operators.skew import checked_broadcast
from subloom.session import materialize, write_through

LENGTH, GRAM = 200, 32
BATCH_BYTES, BUCKET_BYTES = 4_000_000, 40_000_000
# Strings compared one by one in a bucket.
BUCKET_STRINGS = 1_000_000
GEAR = np.random.default_rng(29).integers(0, 2**32, 256, dtype=np.uint32)
ROOT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ROOT), -1, 2**64))
WHOLE, DETAIL = 1, 2


class Powers:
    """Powers of a number modulo 2^64, made longer when needed."""

    def __init__(self, base: np.uint64):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(2 * n, self.base, np.uint64)
            steps[0] = 1
            self.values = np.multiply.accumulate(steps)
        return self.values


UP, DOWN = Powers(ROOT), Powers(INVERSE)


class Hashes:
    """64-bit hashes of any substrings of one text."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * UP.upto(n + 1)[:n], out=self.sums[1:])
        self.down = DOWN.upto(n + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def samples(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, and the first and last start of the strings that have each sample."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    # Hash and place in one number, so that the leftmost of equal hashes is least.
    low = h[GRAM - 1 :].astype(np.uint64) << np.uint64(32) | np.arange(len(h) - GRAM + 1, dtype=np.uint64)
    span, wide = 1, length - GRAM + 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if wide > span:
        low = np.minimum(low[: -(wide - span)], low[wide - span :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def _settled(gram: np.ndarray, rank: np.ndarray, doc: np.ndarray):
    """Of entries (gram, rank): the order, the first of each different one and its count."""
    order = np.lexsort((rank, gram))
    g, r = gram[order], rank[order]
    new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
    return order, new, np.diff(np.r_[new, len(order)])


def _sent(docs: list, gram, rank, doc, lo, hi, buckets: int, weight=None) -> Iterator[pd.DataFrame]:
    """Rows for the buckets: one entry of each different (gram, rank); and for what is repeated in
    this batch already, rows for the documents."""
    order, new, count = _settled(gram, rank, doc)
    first = order[new]
    total = count if weight is None else np.add.reduceat(weight[order], new)
    again = order[np.repeat(count > 1, count)]
    bucket = (gram[first] % np.uint64(buckets)).astype(np.int64)
    place = np.argsort(bucket, kind="stable")
    first, total, bucket = first[place], np.minimum(total[place], 2), bucket[place]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    out = []
    for b, (i, j) in enumerate(zip(ends, ends[1:])):
        if j > i:
            mine = first[i:j]
            used, at = np.unique(doc[mine], return_inverse=True)
            out.append(
                {
                    "bucket": b,
                    "ids": [docs[k][0] for k in used],
                    "keys": [docs[k][1] for k in used],
                    "grams": gram[mine].tobytes(),
                    "ranks": pack(rank[mine], "<u8"),
                    "spots": pack(np.stack([at, lo[mine], hi[mine] - lo[mine], total[i:j]]), "<u4"),
                }
            )
    yield pd.DataFrame(out, columns=["bucket", "ids", "keys", "grams", "ranks", "spots"])
    rows = []
    again = again[np.argsort(doc[again], kind="stable")]
    where = np.flatnonzero(np.r_[True, np.diff(doc[again]) != 0]) if len(again) else []
    for a, b in zip(where, [*where[1:], len(again)]):
        k = doc[again[a]]
        code = np.full(b - a, WHOLE)
        spots = np.stack([lo[again[a:b]], hi[again[a:b]], code]).astype("<u4").tobytes()
        # Dealt at random: these rows only pass through.
        rows.append({"bucket": int(k) % buckets, "ids": [docs[k][0]], "keys": [docs[k][1]], "done": spots})
    yield pd.DataFrame(rows, columns=["bucket", "ids", "keys", "done"])


ENTRY = "bucket int, ids array<string>, keys array<long>, grams binary, ranks binary, spots binary, done binary"


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[list]:
    """Lists of (id, key, bytes, spots) of about BATCH_BYTES."""
    batch, size = [], 0
    for frame in frames:
        spots = frame["spots"] if "spots" in frame else [None] * len(frame)
        for key, row, text, own in zip(frame["id"], frame["key"], frame["text"], spots):
            batch.append((key, row, np.frombuffer((text or "").encode(), np.uint8), own))
            size += len(batch[-1][2])
            if size > BATCH_BYTES:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _framed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        if len(part):
            yield part.reindex(columns=["bucket", "ids", "keys", "grams", "ranks", "spots", "done"]).astype(object).where(lambda x: x.notna(), None)


def _ranked(rows: pd.DataFrame, whole_only: bool, blocks: int) -> pd.DataFrame:
    """Sort one bucket. Per document the stretches that are repeated as a whole (WHOLE) and those
    whose strings must be compared one by one (DETAIL), one row for each block of documents."""
    out_docs: list = []
    out_spots: list[np.ndarray] = []
    plain = rows[rows["done"].isna()]
    for row in rows[rows["done"].notna()].itertuples(index=False):
        out_docs.append((row.ids[0], row.keys[0]))
        out_spots.append(np.frombuffer(row.done, "<u4").reshape(3, -1))
    if len(plain):
        gram = np.concatenate([np.frombuffer(x, np.uint64) for x in plain["grams"]])
        rank = np.concatenate([unpack(x, "<u8") for x in plain["ranks"]])
        parts = [unpack(x, "<u4").reshape(4, -1).astype(np.int64) for x in plain["spots"]]
        names = [(i, k) for ids, keys in zip(plain["ids"], plain["keys"]) for i, k in zip(ids, keys)]
        shift = np.cumsum([0, *map(len, plain["ids"])])
        doc, lo, hi, total = np.concatenate([p + [[s], [0], [0], [0]] for p, s in zip(parts, shift)], axis=1)
        hi = lo + hi  # sent as lengths
        order, new, count = _settled(gram, rank, doc)
        copies = np.add.reduceat(total[order], new)
        sort_gram = gram[order][new]
        group = np.flatnonzero(np.r_[True, sort_gram[1:] != sort_gram[:-1]])
        ranks = np.diff(np.r_[group, len(new)])
        single = np.add.reduceat((copies == 1).astype(np.int64), group)
        # Strings are compared one by one where a rank that occurs once stands beside others.
        compare = np.repeat((single > 0) & (ranks > 1), ranks)
        code = np.where(copies > 1, WHOLE, 0) | np.where(compare, DETAIL, 0)
        each = np.repeat(code, count)
        # Of equal stretches only the first is compared.
        later = np.ones(len(order), bool)
        later[new] = False
        each[later] &= WHOLE
        back = np.empty(len(order), np.int64)
        back[order] = each
        if whole_only:
            back &= WHOLE
        use = np.flatnonzero(back)
        use = use[np.argsort(doc[use], kind="stable")]
        where = np.flatnonzero(np.r_[True, np.diff(doc[use]) != 0]) if len(use) else []
        for a, b in zip(where, [*where[1:], len(use)]):
            mine = use[a:b]
            out_docs.append(names[doc[mine[0]]])
            out_spots.append(np.stack([lo[mine], hi[mine], back[mine]]))
    block = np.array([k for _, k in out_docs], np.int64) % blocks
    out = []
    for b in np.unique(block):
        mine = np.flatnonzero(block == b)
        out.append(
            {
                "block": b,
                "ids": [out_docs[k][0] for k in mine],
                "keys": [out_docs[k][1] for k in mine],
                "sizes": pack(np.array([out_spots[k].shape[1] for k in mine]), "<u4"),
                "spots": pack(np.concatenate([out_spots[k] for k in mine], axis=1), "<u4"),
            }
        )
    return pd.DataFrame(out, columns=["block", "ids", "keys", "sizes", "spots"])


BLOCK = "block int, ids array<string>, keys array<long>, sizes binary, spots binary"


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One row (id, key, spots, detail) for each document of a block; ``detail`` strings must be
    compared one by one."""
    found: dict[tuple, list[np.ndarray]] = {}
    for row in rows.itertuples(index=False):
        spots, ends = unpack(row.spots, "<u4").reshape(3, -1), np.cumsum(unpack(row.sizes, "<u4"))
        for key, part in zip(zip(row.ids, row.keys), np.split(spots, ends[:-1], axis=1)):
            found.setdefault(key, []).append(part)
    spots = [np.concatenate(parts, axis=1) for parts in found.values()]
    return pd.DataFrame(
        {
            "id": pd.Series([i for i, _ in found], dtype=object),
            "key": pd.Series([k for _, k in found], dtype="int64"),
            "spots": [x.tobytes() for x in spots],
            "detail": [int((x[1].astype(np.int64) - x[0] + 1)[x[2] & DETAIL > 0].sum()) for x in spots],
        }
    )


def _spots(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(p, "<u4").reshape(3, -1).astype(np.int64) for p in parts], axis=1)


def _row_key(id_column: str, text_column: str) -> Column:
    return F.xxhash64(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")))


def repeated_strings(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Stored rows (id, key, spots): for documents with repeated strings, packed triples (first
    start, last start, 1) of strings of ``length`` bytes that start elsewhere too. ``key`` tells
    rows of one id apart by their text; rows that repeat both are each other's copies."""
    rows = docs.select(
        as_text(F.col(id_column)).alias("id"), _row_key(id_column, text_column).alias("key"), F.col(text_column).alias("text")
    )
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    # About 24 bytes for one position in 85, and as many again for strings compared one by one.
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    found = "id string, key long, spots binary, detail long"

    def sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames):
            cols: list[list] = [[], [], [], [], []]
            for k, (_, _, data, _) in enumerate(batch):
                if len(data) >= length:
                    at, lo, hi = samples(data, length)
                    h = Hashes(data)
                    # Equal ranks: equal bytes, and the sample at the same place in them.
                    rank = h.of(lo, hi + length) + mixed((at - lo).astype(np.uint64) << np.uint64(20) | (hi - lo).astype(np.uint64))
                    for c, x in zip(cols, (h.of(at, at + GRAM), rank, np.full(len(at), k), lo, hi)):
                        c.append(x)
            if cols[0]:
                yield from _framed(_sent(batch, *map(np.concatenate, cols), buckets))

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames):
            cols: list[list] = [[], [], [], []]
            for k, (_, _, data, own) in enumerate(batch):
                spots = _spots(own)
                spots = spots[:, (spots[2] & DETAIL) > 0]
                size = spots[1] - spots[0] + 1
                start = np.repeat(spots[0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                weight = np.repeat(np.where(spots[2] & WHOLE, 2, 1), size)
                for c, x in zip(cols, (Hashes(data).of(start, start + length), np.full(len(start), k), start, weight)):
                    c.append(x)
            gram, doc, start, weight = map(np.concatenate, cols)
            yield from _framed(_sent(batch, gram, np.zeros(len(gram), np.uint64), doc, start, start, finer, weight))

    first = write_through(
        rows.mapInPandas(sampled, ENTRY)
        .groupBy("bucket")
        .applyInPandas(lambda part: _ranked(part, False, buckets), BLOCK)
        .groupBy("block")
        .applyInPandas(_merged, found),
        "samples",
    )
    open_ = first.filter("detail > 0").select("id", "key", F.array("spots").alias("spots"))
    strings = first.agg(F.sum("detail")).first()[0] or 0
    finer = max(1, math.ceil(strings / BUCKET_STRINGS))
    # Where the documents to compare are few, the others' texts stay where they are.
    keys = checked_broadcast(materialize(open_.select("key").distinct()))
    second = (
        _with_text(rows.join(keys, "key", "left_semi"), open_)
        .mapInPandas(compared, ENTRY)
        .groupBy("bucket")
        .applyInPandas(lambda part: _ranked(part, True, buckets), BLOCK)
        .groupBy("block")
        .applyInPandas(_merged, found)
    )
    both = first.unionByName(second).drop("detail")
    return write_through(both.withColumn("id", F.col("id").cast(docs.schema[id_column].dataType)), "repeats")


def _with_text(rows: DataFrame, spots: DataFrame, how: str = "inner") -> DataFrame:
    other = spots.withColumnsRenamed({"id": "o_id", "key": "o_key"})
    same = rows["id"].eqNullSafe(other["o_id"]) & (rows["key"] == other["o_key"])
    return rows.join(other, same, how).drop("o_id", "o_key")


def spans_of(parts: list[bytes] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the repeated strings of one document."""
    if parts is None or not len(parts):
        return []
    spots = _spots(parts)
    spots = spots[:, (spots[2] & WHOLE) > 0]
    if not spots.shape[1]:
        return []
    order = np.argsort(spots[0], kind="stable")
    start, stop = spots[0][order], np.maximum.accumulate(spots[1][order] + length)
    new = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    return list(zip(start[new].tolist(), stop[np.r_[new[1:] - 1, len(stop) - 1]].tolist()))


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    with_bytes: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]), one per row of ``docs``.

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in
    the same document or another, as UTF-8 and judged on the input; strings don't cross documents.
    ``spans`` are the removed (start, stop), ``kept`` the remaining bytes, which may cut a
    character. Null counts as empty. Repeated rows lose what they share. A null id stays null;
    other columns are not read. An empty table gives no rows.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spots = repeated_strings(docs, length, id_column, text_column)
    rows = docs.select(
        F.col(id_column).alias("id"), _row_key(id_column, text_column).alias("key"), F.col(text_column).alias("text")
    )
    per_doc = spots.groupBy("id", "key").agg(F.collect_list("spots").alias("spots"))
    kind = docs.schema[id_column].dataType

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, parts in zip(frame["id"], frame["text"], frame["spots"]):
                data = (text or "").encode()
                spans = spans_of(parts, length)
                edges = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (key, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans)
                out.append((*row, kept) if with_bytes else row)
            done = pd.DataFrame(out, columns=names)
            yield done

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_bytes]
    schema = (
        "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:long,stop:long>>" + ", kept binary" * with_bytes
    )
    marked = _with_text(rows, per_doc, "left").withColumn("id", as_text(F.col("id")))
    return marked.mapInPandas(cut, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_column)
