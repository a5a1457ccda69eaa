"""Near-duplicate documents by a metric-space join under the Jaccard distance.

Documents are sets of word shingles, and 1 - similarity is a metric. Pivots are documents:

- Every shingle that matters to a set (its rarest quarter, outside of which no similar pair can
  have all of its overlap) names the pivot of its holders, the set with the least hash; holders
  whose size allows no link with another holder are left out. A set belongs to the region of each
  pivot it is named, so any linked pair shares a region. A linked pair has several of these
  shingles in common, so a set stays away from regions that few of its shingles name.
- Within a region the distances to the pivot are computed. Sets within the threshold are linked to
  it and are one component from then on; the others are ordered by their distance, and by the
  triangle inequality only sets whose distances differ by the threshold at most can be linked.
- What isn't in one component yet is joined recursively around new pivots. A region that is too
  large for a task is cut into shells by distance; sets of a shell are replicated into the next.

Everything is exact up to 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.llm.arrays import hash_words, mixed, pack, unpack
from subloom.llm.components import components
from subloom.llm.words import as_text
from subloom.operators.skew import BROADCAST_ROWS, checked_broadcast
from subloom.session import materialize, write_through

SHINGLE = 5
# Counters that order shingles by rarity, in pieces; entries of one bucket; sets of one region
# that a task joins; recursions before a region is cut into blocks instead.
CELLS, PIECES = 1 << 18, 64
# Beside the least overlap of one, an eighth of a set must be found among its rarest shingles.
MORE = 8
COUNTERS = "piece int, part int, counts binary"
BUCKET_ENTRIES, REGION_SETS, DEPTH = 2_000_000, 1_500, 4
BATCH_BYTES = 6_000_000
ODD = np.random.default_rng(41).integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


class Sets:
    """The shingle sets of many texts as one array: texts from ``start`` on with ``size`` items each."""

    def __init__(self, owner: np.ndarray, items: np.ndarray, texts: int):
        # One number for text and item finds the repeats; then back to the order of texts.
        _, once = np.unique(items + owner.astype(np.uint64) * ODD[3], return_index=True)
        once = once[np.argsort(owner[once], kind="stable")]
        self.owner, self.items = owner[once], items[once]
        self.size = np.bincount(self.owner, minlength=texts)
        self.start = np.cumsum(self.size) - self.size

    def of(self, i: int) -> np.ndarray:
        return self.items[self.start[i] : self.start[i] + self.size[i]]

    def names(self) -> np.ndarray:
        """A hash of each set, as a signed number; 0 for empty sets."""
        full = np.flatnonzero(self.size)
        out = np.zeros(len(self.size), np.int64)
        if len(full):
            one, two = (np.add.reduceat(mixed(x), self.start[full]) for x in (self.items, self.items * ODD[1]))
            both = one * ODD[0] + two * ODD[1] + self.size[full].astype(np.uint64) * ODD[2]
            out[full] = mixed(both).astype(np.int64)
        return out

    def rarest(self, rarity: np.ndarray, percent: int, more: int = 0):
        """Owner, item and place of each set's rarest items, of which sets with a similarity of
        ``percent`` share at least one; with ``more``, at least ``size // more`` beside that one
        and so many items more. Rarity, then 38 bits of the item are the order."""
        rank = rarity[cells_of(self.items)] << np.uint64(38) | self.items >> np.uint64(26)
        order = np.argsort(self.owner.astype(np.uint64) << np.uint64(44) | rank, kind="stable")
        place = np.arange(len(order)) - self.start[self.owner]
        head = place < (self.size - -(-self.size * percent // 100) + 1 + beside(self.size, more))[self.owner]
        return self.owner[head], self.items[order[head]], place[head]


def beside(size: np.ndarray, more: int) -> np.ndarray:
    return size // more if more else np.zeros_like(size)


class Shingles:
    """Sets of shingle hashes of texts; words already seen are not hashed again."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes]) -> Sets:
        """Hashes of the five-word runs of each text; of all its words if they are fewer."""
        if len(self.number) > 500_000:
            self.__init__()
        number, known = self.number, len(self.number)
        flat: list[int] = []
        size = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.lower().split()
            size[i] = len(words)
            flat += [number.setdefault(w, len(number)) for w in words]
        if len(number) > known:
            self.hashes = np.concatenate([self.hashes, hash_words(list(number)[known:])])
        h = self.hashes[np.array(flat, np.int64)]
        first = np.cumsum(size) - size
        room = np.repeat(first + size, size) - np.arange(len(h))  # words from here to the text's end
        owners, items = [], []
        for k in range(1, SHINGLE + 1):
            if k < SHINGLE:
                at = first[size == k]
            else:
                at = np.flatnonzero(room >= SHINGLE)
            total = np.full(len(at), k, np.uint64)
            for i in range(k):
                total += h[at + i] * ODD[i]
            owners.append(np.searchsorted(first + size, at, side="right"))
            items.append(mixed(total))
        return Sets(np.concatenate(owners), np.concatenate(items), len(texts))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of about BATCH_BYTES of text, with the text as bytes."""
    for batch in batches:
        batch = batch.assign(text=[(t or "").encode() for t in batch["text"]])
        part = np.cumsum([len(t) for t in batch["text"]]) // BATCH_BYTES
        for p in np.unique(part):
            yield batch[part == p]


def cells_of(items: np.ndarray) -> np.ndarray:
    return (items % np.uint64(CELLS)).astype(np.int64)


def counter_pieces(counts: np.ndarray) -> pd.DataFrame:
    """A task's counters as rows (piece, part, counts)."""
    part = TaskContext.get().partitionId() % 256
    packed = [pack(p, "<u8") for p in np.split(counts, PIECES)]
    return pd.DataFrame({"piece": range(PIECES), "part": part, "counts": packed})


def _described(docs: DataFrame) -> DataFrame:
    """Stored rows (id, n, name) for each document, and rows (piece, part, counts) of counters."""

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker, counts = Shingles(), np.zeros(CELLS, np.int64)
        for chunk in _chunks(batches):
            sets = maker.sets(list(chunk["text"]))
            counts += np.bincount(cells_of(sets.items), minlength=CELLS)
            yield pd.DataFrame({"id": chunk["id"], "n": sets.size, "name": sets.names()})
        yield counter_pieces(counts)

    def framed(batches):
        for out in described(batches):
            yield out.reindex(columns=["id", "n", "name", "piece", "part", "counts"]).astype(object).where(lambda x: x.notna(), None)

    kind = docs.schema["id"].dataType
    schema = "id string, n long, name long, piece int, part int, counts binary"
    out = docs.withColumn("id", as_text(F.col("id"))).mapInPandas(framed, schema)
    return write_through(out.withColumn("id", F.col("id").cast(kind)), "sets")


def rarity_of(pieces: DataFrame) -> np.ndarray:
    """The counters of all tasks together: for each cell how often it is used, in octaves above the mean: a table of fixed size."""

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpack(c, "<u8").astype(np.int64) for c in rows["counts"])
        return rows.iloc[:1].assign(counts=[pack(total, "<u8")])

    by_part = pieces.groupBy("piece", "part").applyInPandas(added, COUNTERS)
    whole = by_part.groupBy("piece").applyInPandas(added, COUNTERS).orderBy("piece").collect()
    if not whole:
        return np.zeros(CELLS, np.uint64)
    counts = np.concatenate([unpack(r["counts"], "<u8") for r in whole]).astype(float)
    octave = np.floor(np.log2(np.maximum(counts, 1) / max(counts.mean(), 1)))
    return np.clip(octave, 0, 63).astype(np.uint64)


def shared_heads(
    docs: DataFrame, batch_sets, rarity: np.ndarray, entries: int, percent: int, found, schema: str
) -> DataFrame:
    """Deal the rarest shingles of all sets into buckets by hash and apply ``found`` to each
    bucket's (shingle, name, n, place), sorted by shingle and name. ``batch_sets`` makes Sets of
    an iterator of frames; of equal sets in a batch only the first is sent."""
    buckets = max(1, math.ceil(entries / BUCKET_ENTRIES))

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sets in batch_sets(batches):
            names, once = np.unique(sets.names(), return_index=True)
            owner, flat, place = sets.rarest(rarity, percent, MORE)
            number = np.full(len(sets.size), -1)
            number[once] = np.arange(len(once))
            use = number[owner] >= 0
            owner, flat, place = number[owner[use]], flat[use], place[use]
            bucket = (flat % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            size = sets.size[once]
            out = []
            for b, (i, j) in enumerate(zip(ends, ends[1:])):
                if j > i:
                    mine = order[i:j]
                    used, at = np.unique(owner[mine], return_inverse=True)
                    parts = (flat[mine], at.astype("<u4"), place[mine].astype("<u4"), names[used], size[used])
                    out.append((b, *(pack(x, x.dtype) if x.dtype == "<u4" else x.tobytes() for x in parts)))
            yield pd.DataFrame(out, columns=["bucket", "shingles", "at", "place", "names", "sizes"])

    def gathered(rows: pd.DataFrame) -> pd.DataFrame:
        at = [unpack(x, "<u4") for x in rows["at"]]
        name = np.concatenate([np.frombuffer(x, np.int64)[i] for x, i in zip(rows["names"], at)])
        size = np.concatenate([np.frombuffer(x, np.int64)[i] for x, i in zip(rows["sizes"], at)])
        shingle = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["shingles"]])
        place = np.concatenate([unpack(x, "<u4") for x in rows["place"]])
        order = np.argsort(shingle)
        shingle = shingle[order]
        first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        many = np.repeat(np.diff(np.r_[first, len(shingle)]) > 1, np.diff(np.r_[first, len(shingle)]))
        order, shingle = order[many], shingle[many]
        inner = np.lexsort((name[order], shingle))
        order, shingle = order[inner], shingle[inner]
        name = name[order]
        new = np.ones(len(name), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])
        shingle, name, order = shingle[new], name[new], order[new]
        starts = np.ones(len(name), bool)
        starts[1:] = shingle[1:] != shingle[:-1]
        first = np.flatnonzero(starts)
        count = np.diff(np.r_[first, len(name)])
        many = np.repeat(count > 1, count)
        return found(shingle[many], name[many], size[order][many], place[order][many])

    rows = docs.mapInPandas(
        sent, "bucket int, shingles binary, at binary, place binary, names binary, sizes binary"
    )
    return rows.groupBy("bucket").applyInPandas(gathered, schema)


def similar_sizes(shingle: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Marks those holders of a shingle of which another holder's size allows a link."""
    order = np.lexsort((size, shingle))
    s, n = shingle[order], size[order]
    near = (s[1:] == s[:-1]) & (n[:-1] * 100 >= n[1:] * percent)  # sizes rise
    out = np.zeros(len(s), bool)
    out[order[1:][near]] = True
    out[order[:-1][near]] = True
    return out


def counted_pairs(pivot: np.ndarray, name: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Different rows (pivot, name, sum of shingles)."""
    order = np.lexsort((pivot, name))
    pivot, name, shingles = pivot[order], name[order], shingles[order]
    first = np.ones(len(name), bool)
    first[1:] = (name[1:] != name[:-1]) | (pivot[1:] != pivot[:-1])
    at = np.flatnonzero(first)
    total = np.add.reduceat(shingles, at) if len(at) else shingles
    return np.stack([pivot[at], name[at], total], 1)


def spared(size: np.ndarray, percent: int) -> np.ndarray:
    """How many of its rarest shingles a set of that size may leave unnamed. Of a linked pair, each
    has at least 1 + ``size // MORE`` of the common shingles among its rarest, the same ones up to
    the smaller number; so one is left if both leave out half of what the smallest partner has."""
    return -(-size * percent // 100) // MORE // 2


def needed_regions(name: np.ndarray, shingles: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Marks the regions of each name but those named by its fewest shingles, together ``most`` at
    most."""
    order = np.lexsort((shingles, name))
    n, sums = name[order], np.cumsum(shingles[order])
    first = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else np.zeros(0, np.int64)
    before = np.repeat(sums[first] - shingles[order][first], np.diff(np.r_[first, len(n)]))
    out = np.zeros(len(name), bool)
    out[order] = sums - before > most[order]
    return out


def _regions(docs: DataFrame, rarity: np.ndarray, entries: int, percent: int) -> DataFrame:
    """Rows (pivot, name): which sets meet in the region of which pivot. Sets of which too few of
    the rarest shingles are in any other set are similar to none and left out."""

    def batch_sets(batches: Iterator[pd.DataFrame]) -> Iterator[Sets]:
        maker = Shingles()
        for chunk in _chunks(batches):
            yield maker.sets(list(chunk["text"]))

    # A bucket answers in one row for each block of names: a set has shingles in most buckets.
    blocks = max(1, math.ceil(entries / BUCKET_ENTRIES))

    def met(shingle, name, size, place) -> pd.DataFrame:
        use = similar_sizes(shingle, size, percent)
        shingle, name, size = shingle[use], name[use], size[use]
        first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(name) else np.zeros(0, np.int64)
        pivot = np.repeat(name[first], np.diff(np.r_[first, len(name)]))
        pairs = counted_pairs(pivot, name, np.ones(len(name), np.int64))
        names, at, shared = np.unique(name, return_index=True, return_counts=True)
        ours, theirs = names % blocks, pairs[:, 1] % blocks
        out = []
        for b in np.unique(ours):
            mine = ours == b
            told = np.stack([names[mine], size[at][mine], shared[mine]])
            out.append((b, pairs[theirs == b].tobytes(), told.tobytes()))
        return pd.DataFrame(out, columns=["block", "pairs", "told"])

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in rows["pairs"]])
        name, size, shared = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in rows["told"]], axis=1)
        names, at, which = np.unique(name, return_index=True, return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, which, shared)
        enough = total > size[at] // MORE
        pairs = pairs[np.isin(pairs[:, 1], names[enough])]
        pivot, name, shingles = counted_pairs(*pairs.T).T
        most = spared(size[at], percent)[np.searchsorted(names, name)]
        needed = needed_regions(name, shingles, most)
        return pd.DataFrame({"pivot": pivot[needed], "name": name[needed]})

    found = shared_heads(docs, batch_sets, rarity, entries, percent, met, "block int, pairs binary, told binary")
    regions = write_through(found.groupBy("block").applyInPandas(near, "pivot long, name long"), "regions")
    # Where a set is left alone nothing can be linked.
    alone = regions.groupBy("pivot").agg(F.count(F.lit(1)).alias("sets")).filter("sets = 1").select("pivot")
    return materialize(regions.join(checked_broadcast(materialize(alone)), "pivot", "left_anti"))


class Region:
    """Sets of one region, with exact distances from any of them to all."""

    def __init__(self, names: np.ndarray, sets: list[np.ndarray]):
        self.names = names
        self.size = np.array([len(s) for s in sets], np.int64)
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.cumsum(self.size) - self.size
        self.mark = np.zeros(self.flat.max() + 1, np.int64)
        self.root = np.arange(len(names))

    def shared_with(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i and the others."""
        mine = self.flat[self.start[i] : self.start[i] + self.size[i]]
        self.mark[mine] = 1
        if len(others) == len(self.names):
            out = np.add.reduceat(self.mark[self.flat], self.start)
        else:
            out = np.array([self.mark[self.flat[s : s + n]].sum() for s, n in zip(self.start[others], self.size[others])], np.int64)
        self.mark[mine] = 0
        return out

    def join(self, percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect every component of the region. With ``left`` (a mask) only pairs
        between the two sides need to be found."""
        n, links = len(self.names), []
        reach = 1 - percent / 100
        done = np.zeros(n, bool)
        distances: list[np.ndarray] = []
        while True:
            open_ = np.flatnonzero(~done)
            roots, count = np.unique(self.root[open_], return_counts=True)
            if len(roots) < 2:
                return links
            pivot = open_[self.root[open_] == roots[np.argmin(count)]][0]
            near = self.root != self.root[pivot]
            near &= np.minimum(self.size, self.size[pivot]) * 100 >= np.maximum(self.size, self.size[pivot]) * percent
            for d in distances:  # triangle inequality; what is unknown is nan
                near &= ~(np.abs(d - d[pivot]) > reach + 1e-9)
            done[pivot] = True
            others = np.flatnonzero(near)
            if not len(others):
                continue
            if 4 * len(others) > n:
                others = np.arange(n)
            both = self.shared_with(pivot, others)
            union = self.size[others] + self.size[pivot] - both
            if len(distances) < 8:
                d = np.full(n, np.nan)
                d[others] = 1 - both / union
                distances.append(d)
            for j in others[100 * both >= percent * union]:
                if self.root[j] != self.root[pivot]:
                    links.append((int(self.names[pivot]), int(self.names[j])))
                    self.root[self.root == self.root[j]] = self.root[pivot]


def _links_within(regions: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) that connect the components of each group of rows (region, name, items)."""

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("name")
        region = Region(rows["name"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["items"]])
        return pd.DataFrame(region.join(percent), columns=["a", "b"], dtype="int64")

    return regions.groupBy("region").applyInPandas(solved, "a long, b long")


def _shells(large: DataFrame, level: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """One recursion of regions that are too large for a task. Rows (region, name, items) are
    dealt at random over tasks, each with the region's pivot, its least name; returned are the
    links to pivots, and the next regions: shells of width 1 - threshold around the pivot, each
    with the sets of the shell within it. The innermost shell alone is one component already."""
    reach = 1 - percent / 100
    pivots = large.groupBy("region").agg(F.min("name").alias("pivot"), F.count(F.lit(1)).alias("sets"))
    parts = F.ceil(F.col("sets") / REGION_SETS).cast("int")
    pivots = materialize(pivots.withColumn("parts", parts))
    members = large.join(pivots, "region").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    leaders = members.filter("name = pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = members.filter("name <> pivot").unionByName(leaders).select("region", "part", "pivot", "name", "items")

    def measured(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("name").reset_index(drop=True)
        region = Region(rows["name"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["items"]])
        i = int(np.flatnonzero(rows["name"] == rows["pivot"])[0])
        both = region.shared_with(i, np.arange(len(rows)))
        union = region.size + region.size[i] - both
        shell = np.floor((1 - both / union) / reach - 1e-9).astype(np.int64)
        shell = np.where(100 * both >= percent * union, 0, np.maximum(shell, 1))
        return rows.assign(shell=shell)[rows["name"] != rows["pivot"]]

    schema = "region string, part int, pivot long, name long, items binary, shell int"
    told = write_through(rows.groupBy("region", "part").applyInPandas(measured, schema), f"shells-{level}")
    links = told.filter("shell = 0").select(F.col("pivot").alias("a"), F.col("name").alias("b"))
    here = told.withColumn("to", F.explode(F.array("shell", F.col("shell") + 1)))
    filled = told.filter("shell > 0").select("region", F.col("shell").alias("to")).distinct()
    following = here.join(filled, ["region", "to"]).select(
        F.concat_ws("/", "region", F.col("to").cast("string")).alias("region"), "name", "items"
    )
    return links, following


def _blocks(large: DataFrame) -> DataFrame:
    """Every two blocks of a region as a region, for what pivots could not take apart."""
    half = REGION_SETS // 2
    sizes = large.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("blocks"))
    numbered = large.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return numbered.withColumn("other", other).select(
        F.concat_ws("#", "region", F.least("block", "other"), F.greatest("block", "other")).alias("region"),
        "name",
        "items",
    )


def _too_large(regions: DataFrame) -> DataFrame:
    """The regions that hold more sets than a task joins."""
    sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("sets"))
    return materialize(sizes.filter(F.col("sets") > REGION_SETS).select("region"))


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.75,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (id, n_shingles, component_id), one per row of ``docs``.

    A document is the set of its five-word shingles (fewer words: all of them as one), words taken
    as ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Documents link when their Jaccard similarity
    is at least ``threshold``, in whole percents; component_id is the least id that links reach.
    Null, empty and wordless texts have no shingles, link with nothing and keep their own id.
    Repeated rows are each returned. A row with a null id links with nothing and has a null
    component_id. Other columns are not read. An empty table gives no rows.
    """
    percent = round(threshold * 100)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    described = _described(rows)
    rarity = rarity_of(described.filter("piece IS NOT NULL").select("piece", "part", "counts"))
    sets = described.filter("piece IS NULL").select("id", "n", "name")
    heads = F.sum(F.floor(F.col("n") * (100 - percent) / 100 + F.col("n") / MORE) + 1)
    entries = sets.agg(heads).first()[0] or 0
    regions = _regions(rows.filter("id IS NOT NULL"), rarity, entries, percent)
    # One document of each set stands for it.
    holders = sets.filter("n > 0 AND id IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"))
    listed = regions.join(holders, "name").groupBy("id", "name").agg(F.collect_list("pivot").alias("pivots"))

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Shingles()
        for chunk in _chunks(batches):
            out = []
            sets = maker.sets(list(chunk["text"]))
            for i, (name, own, pivots) in enumerate(zip(chunk["name"], sets.names(), chunk["pivots"])):
                if own == name:  # rows of one id may differ
                    out += [(str(p), name, sets.of(i).tobytes()) for p in pivots]
            yield pd.DataFrame(out, columns=["region", "name", "items"])

    if regions.count() <= BROADCAST_ROWS:  # then the lists are small too, and no text moves
        listed = F.broadcast(listed)
    full = rows.join(listed, "id").mapInPandas(filled, "region string, name long, items binary")
    counted = regions.withColumn("region", F.col("pivot").cast("string"))
    links, level = [], 0
    while not (big := _too_large(counted)).isEmpty():
        if level == DEPTH:
            full = _blocks(full)
            break
        large = write_through(full.join(checked_broadcast(big), "region", "left_semi"), f"large-{level}")
        links.append(_links_within(full.join(checked_broadcast(big), "region", "left_anti"), percent))
        to_pivots, full = _shells(large, level, percent)
        links.append(to_pivots)
        counted = full
        level += 1
    links.append(_links_within(full, percent))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    roots = components(edges)
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    placed = sets.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn(
        "root", F.coalesce("root", "name")
    )
    least = placed.filter(linked).groupBy("root").agg(F.min("id").alias("component_id"))
    own = F.when(linked, F.col("component_id")).otherwise(F.col("id"))
    return placed.join(least, "root", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), own.alias("component_id")
    )
