"""Gradient boosting of many models at once, one tree at a time.

The rows stand in blocks of bin numbers. What a round leaves behind is every model's score of
every row, kept beside the blocks; the next tree is grown on the gradient at those scores, so a
round costs the same at any number of trees, and nothing is fitted twice. A tree is grown from
histograms of the gradient by node, feature and bin: tasks add up their blocks, equal keys meet,
and only best splits reach the driver. Models of all members and folds advance in the same jobs.

Gradients are rounded to multiples of a power of two chosen so that sums over all rows are exact.
Trees therefore do not depend on how rows are partitioned, and lost tasks can be run again.

A table with few cells would spend its time on the start of jobs. There a task holds all rows of a
model (``LOCAL_CELLS`` bin numbers, or ``BUSY`` times as many) and takes it through many rounds with
the same functions; the trees are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.learning.binning import BINS, bin_edges, dense, to_bins, vector_parts
from subloom.learning.members import Member, best_round
from subloom.learning.trees import (
    TURNED,
    Coded,
    Leaves,
    Limits,
    Picked,
    Tree,
    Walk,
    best_splits,
    by_feature,
    finish,
    grow,
    histogram,
    leaves_in,
    picked,
    predict,
    shared_sums,
)
from subloom.session import materialize, shared_dir

# Bin numbers (rows times features) of a model that one task may hold, and how many times as many
# where there is a model for every other core at least, which then are busy that way, too.
LOCAL_CELLS = 32_000_000
BUSY = 5
# Bin numbers of a block of rows, those looked at and histogram cells added up at a time.
RECORD_CELLS = 16_000_000
BLOCK_CELLS = 8_000_000
HISTOGRAM_CELLS = 1_000_000
# Histogram cells of unfinished trees that are kept, so that only one of two children is added up.
KEPT_CELLS = 32_000_000
# Rows from which a node's histogram is added up on its own.
OWN_ROWS = 16_384
# Rounds of the first job of Spark where a task has a model to itself.
FIRST_ROUNDS = 250
# Rounds after which the scores are stored in the shared folder, which ends their lineage.
STORE_EVERY = 25
# Exact sums of doubles stay below 2^53.
EXACT_BITS = 52


@dataclass(frozen=True)
class Job:
    """A model to train: its settings, the fold left out to end the boosting, and the outer fold
    that it does not see at all (-1: none)."""

    member: Member
    fold: int = -1
    outer: int = -1


@dataclass(frozen=True)
class Setup:
    task: str
    edges: list[np.ndarray]
    bases: list[float]
    gradient_unit: float
    weight_unit: float
    error_unit: float

    @cached_property
    def starts(self) -> np.ndarray:
        """The first histogram cell of each feature, and the number of all cells."""
        return np.cumsum([0, *(len(e) + 2 for e in self.edges)])


@dataclass
class Block:
    """Rows as bin numbers, labels, folds, outer folds and hashes that tell rows apart."""

    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    outer: np.ndarray
    mark: np.ndarray

    @staticmethod
    def stacked(blocks: Sequence[Block]) -> Block:
        return Block(*(np.concatenate([getattr(b, f.name) for b in blocks]) for f in fields(Block)))

    def rows(self, picked: np.ndarray) -> Block:
        return Block(*(getattr(self, f.name)[picked] for f in fields(Block)))


@dataclass
class Booster:
    """A trained model: ``base`` plus the values of the trees' leaves. ``errors`` are those of
    the held-out rows by round, beyond the last tree too."""

    task: str
    base: float
    size: int
    trees: list[Tree]
    errors: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Values, or the probability of class 1, for rows with NaN where missing."""
        raw = predict(self._walks, x, self.base)
        return 1 / (1 + np.exp(-raw)) if self.task == "clf" else raw

    @cached_property
    def _walks(self) -> list[Walk]:
        return [Walk.of(tree, self.size) for tree in self.trees]

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def importances(self, kind: str = "gain") -> np.ndarray:
        """Per feature the gain of its splits ('gain') or their number ('splits')."""
        out = np.zeros(self.size)
        for tree in self.trees:
            for feature, gain in zip(tree.feature, tree.gain):
                if feature >= 0:
                    out[feature] += gain if kind == "gain" else 1
        return out


def _unit(rows: int, bound: float) -> float:
    """A power of two so large that ``rows`` multiples of it up to ``bound`` add up exactly."""
    return 2.0 ** (np.ceil(np.log2(max(rows, 1) * max(bound, 1e-30))) - EXACT_BITS)


def _gradient(task: str, score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if task == "clf":
        p = 1 / (1 + np.exp(-score))
        return p - label, p * (1 - p)
    return score - label, np.ones(len(label))


def _loss(task: str, score: np.ndarray, label: np.ndarray) -> np.ndarray:
    if task == "clf":
        return np.logaddexp(0, score) - label * score
    return (score - label) ** 2


def _drawn(mark: np.ndarray, member: Member, round_: int) -> np.ndarray:
    """Which rows a round sees, by their hashes; the same ones for ``redraw`` rounds."""
    if member.sample >= 1:
        return np.ones(len(mark), bool)
    x = mark + np.uint64((round_ // member.redraw + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x < np.uint64(member.sample * 2**64)


def _columns(job: Job, round_: int, size: int) -> np.ndarray:
    """Which features a round sees."""
    share = int(np.ceil(job.member.columns * size))
    if share >= size:
        return np.arange(size)
    r = np.random.default_rng([round_, job.fold + 1, zlib.crc32(job.member.name.encode())])
    return np.sort(r.choice(size, share, replace=False))


@dataclass
class Share:
    """A model's rows by feature, those that it trains on first (``seen`` of them), then others;
    ``held`` are the places of those that end its boosting."""

    coded: Coded
    label: np.ndarray
    mark: np.ndarray
    seen: int
    held: np.ndarray


def _sides(block: Block, job: Job) -> tuple[np.ndarray, np.ndarray]:
    """Which rows a model trains on, and which ones end its boosting."""
    inside, own = block.outer != job.outer, block.fold == job.fold
    return inside & ~own, inside & own


def _order(block: Block, job: Job) -> tuple[np.ndarray, int, np.ndarray]:
    """The rows with those that a model trains on before all others, their number, and the places
    of its held-out rows in this order."""
    seen, held = _sides(block, job)
    order = np.concatenate([np.flatnonzero(seen), np.flatnonzero(~seen)])
    return order, int(np.count_nonzero(seen)), np.flatnonzero(held[order])


def _share(block: Block, order: np.ndarray, seen: int, held: np.ndarray, setup: Setup) -> Share:
    bins = np.empty(block.bins.shape[::-1], np.uint8)
    for a in range(0, len(order), TURNED):
        bins[:, a : a + TURNED] = block.bins[order[a : a + TURNED]].T
    return Share(Coded(bins.T, setup.starts), block.label[order], block.mark[order], seen, held)


@dataclass
class Drawn:
    """The rows that a model sees in a round, by leaf; ``sums`` gives gradients and curvatures of
    some of them in units."""

    coded: Coded
    leaves: Leaves
    sums: Callable[[np.ndarray | slice], tuple[np.ndarray, np.ndarray]]


def _in_units(score: np.ndarray, label: np.ndarray, setup: Setup) -> tuple[np.ndarray, np.ndarray]:
    g, h = _gradient(setup.task, score, label)
    return np.rint(g / setup.gradient_unit), np.rint(h / setup.weight_unit)


def _draw(share: Share, score: np.ndarray, job: Job, round_: int, setup: Setup) -> Drawn:
    rows, seen = None, share.seen
    if job.member.sample < 1:
        drawn = _drawn(share.mark[:seen], job.member, round_)
        left_out = np.concatenate([np.flatnonzero(~drawn), np.arange(seen, len(score))])
        rows, seen = np.concatenate([np.flatnonzero(drawn), left_out]), int(drawn.sum())
    g, h = _in_units(score[: share.seen], share.label[: share.seen], setup)
    leaves = Leaves(share.coded.bins, rows, seen)
    return Drawn(share.coded, leaves, lambda some: (picked(g, some), picked(h, some)))


def _histograms(drawn: Drawn, nodes: Sequence[int], setup: Setup) -> np.ndarray:
    """Sums in units, for some leaves of an unfinished tree; those of many rows one by one."""
    cells = setup.starts[-1]
    out = np.zeros((len(nodes), 3, cells))
    step = max(1, BLOCK_CELLS // max(len(drawn.coded.bins), 1))
    few = []
    for slot, node in enumerate(nodes):
        rows = drawn.leaves.seen(node)
        if isinstance(rows, slice) or len(rows) >= OWN_ROWS:
            for part in _parts(rows, step):
                own = Picked(drawn.coded, part)
                out[slot] += histogram(own, None, *drawn.sums(part), 1, setup.starts)[0]
        elif len(rows):
            few.append((slot, rows))
    if few:
        slots = [slot for slot, _ in few]
        rows = np.concatenate([r for _, r in few])
        place = np.repeat(np.arange(len(few)), [len(r) for _, r in few])
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            own, at = Picked(drawn.coded, part), place[a : a + step]
            out[slots] += histogram(own, at, *drawn.sums(part), len(few), setup.starts)
    return out


def _parts(rows: np.ndarray | slice, step: int) -> Iterator[np.ndarray | slice]:
    if isinstance(rows, slice):
        yield from (slice(a, min(a + step, rows.stop)) for a in range(rows.start, rows.stop, step))
    else:
        yield from (rows[a : a + step] for a in range(0, len(rows), step))


def _derived(shares, sums: np.ndarray, kept: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The wanted nodes' sums from those that were added up and their parents'."""
    out = {}
    for (node, parent, wanted), own in zip(shares, sums):
        for n in wanted:
            out[n] = own if n == node else kept[parent] - own
    return out


def _keeps(limits: Limits, setup: Setup) -> int:
    """Histogram cells that a tree may keep."""
    return 3 * int(setup.starts[-1]) * limits.most_leaves


def _answers(sums: np.ndarray, limits: Limits, columns: np.ndarray, setup: Setup) -> list:
    """Best split and sums of each node from its histogram."""
    real = sums * np.array([setup.gradient_unit, setup.weight_unit, 1.0])[:, None]
    totals = map(tuple, real[:, :, : setup.starts[1]].sum(axis=2).tolist())
    return list(zip(best_splits(real, limits, columns, setup.starts), totals))


def _node_groups(nodes: Sequence[int], cells: int) -> Iterator[Sequence[int]]:
    most = max(1, HISTOGRAM_CELLS // max(cells, 1))
    for at in range(0, len(nodes), most):
        yield nodes[at : at + most]


def _error_sum(score: np.ndarray, label: np.ndarray, setup: Setup) -> float:
    """Of held-out rows."""
    return float(np.rint(_loss(setup.task, score, label) / setup.error_unit).sum())


def _advance(block: Block, score: np.ndarray, job: Job, first: int, rounds: int, setup: Setup):
    """Some rounds of a model whose rows are all here: the new scores, trees and error sums."""
    order, seen, held = _order(block, job)
    share = _share(block, order, seen, held, setup)
    out = np.empty_like(score)
    out[order], trees, errors = _advanced(share, score[order], job, first, rounds, setup)
    return out, trees, errors


def _advanced(share: Share, score: np.ndarray, job: Job, first: int, rounds: int, setup: Setup):
    trees, errors, size = [], [], len(setup.edges)
    limits = job.member.limits
    keep = _keeps(limits, setup) <= KEPT_CELLS
    for round_ in range(first, first + rounds):
        columns = _columns(job, round_, size)
        drawn = _draw(share, score, job, round_, setup)
        growing = grow(limits)
        grown, nodes = next(growing)
        kept: dict[int, np.ndarray] = {}
        while True:
            drawn.leaves.follow(grown)
            answers = {}
            if keep:
                shares = shared_sums(grown, nodes)
                sums = _histograms(drawn, [n for n, _, _ in shares], setup)
                kept |= _derived(shares, sums, kept)
                for _, parent, _ in shares:
                    kept.pop(parent, None)
            for group in _node_groups(nodes, 3 * setup.starts[-1]):
                if keep:
                    sums = np.stack([kept[n] for n in group])
                else:
                    sums = _histograms(drawn, group, setup)
                answers |= dict(zip(group, _answers(sums, limits, columns, setup)))
            try:
                grown, nodes = growing.send(answers)
            except StopIteration as end:
                tree = finish(*end.value, limits, setup.edges, job.member.step)
                break
        drawn.leaves.follow(grown)
        score = _raised(score, drawn.leaves, leaves_in(tree, grown), tree)
        trees.append(tree)
        errors.append(_error_sum(score[share.held], share.label[share.held], setup))
    return score, trees, errors


def _raised(score: np.ndarray, leaves: Leaves, places: Sequence[int], tree: Tree) -> np.ndarray:
    """Scores with one more tree; ``places`` are the tree's nodes of the leaves that hold the rows."""
    out = score.copy()
    for leaf, (rows, _) in leaves.held.items():
        out[rows] += tree.value[places[leaf]]
    return out


def _scores_after(trees: Iterable[Tree], bins: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Scores with some trees more, for bin numbers by feature."""
    for tree in trees:
        leaves = Leaves(bins, None, 0)
        leaves.follow(tree)
        score = _raised(score, leaves, range(len(tree.feature)), tree)
    return score


def _blocks(rows: DataFrame, edges: list[np.ndarray], parts: int | None = None) -> RDD:
    """Rows as blocks, dealt out over ``parts`` partitions if that is given; each row's hash covers
    all its columns but the vector."""
    others = [c for c, t in rows.dtypes if t != "vector"]
    shared = rows.sparkSession.sparkContext.broadcast(edges)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, x in dense(batch):
                part = batch.iloc[a:b]
                columns = (
                    to_bins(x, shared.value),
                    part["label"].to_numpy(np.float64),
                    part["fold"].to_numpy(np.int32),
                    part["outer"].to_numpy(np.int32),
                    part["mark"].to_numpy(np.int64).astype(np.uint64),
                )
                yield pd.DataFrame({str(i): [c.tobytes()] for i, c in enumerate(columns)})

    def block(r) -> Block:
        kinds = (np.uint8, np.float64, np.int32, np.int32, np.uint64)
        parts = [np.frombuffer(x, kind) for x, kind in zip(r, kinds)]
        return Block(parts[0].reshape(len(parts[1]), len(edges)), *parts[1:])

    columns = rows.select(
        *vector_parts(),
        F.col("label").cast("double").alias("label"),
        F.col("fold").cast("int").alias("fold"),
        F.col("outer").cast("int").alias("outer"),
        F.xxhash64(*others).alias("mark"),
    )
    def larger(blocks: Iterator[Block]) -> Iterator[Block]:
        held, cells = [], 0
        for b in blocks:
            if held and cells + b.bins.size > RECORD_CELLS:
                yield whole(held)
                held, cells = [], 0
            held.append(b)
            cells += b.bins.size
        if held:
            yield whole(held)

    def whole(held: Sequence[Block]) -> Block:  # feature by feature, as tasks want it
        out = Block.stacked(held)
        return replace(out, bins=by_feature(out.bins).T)

    shape = ", ".join(f"`{i}` binary" for i in range(5))
    made = columns.mapInPandas(binned, shape)
    stored = materialize(made.repartition(parts) if parts else made)
    return stored.rdd.map(block).mapPartitions(larger)


def fit_boosters(rows: DataFrame, jobs: Sequence[Job], task: str, bins: int = BINS) -> list[Booster]:
    """Train all jobs on rows (features, label, fold, outer, any others): one model per job, on the
    rows outside its folds, with the held-out error of every round. ``outer`` may be absent.

    ``features`` are vectors of one length with NaN where a value is missing; each split learns
    the side of missing values. Rows need a label and a fold. Without rows a model has no trees and
    base 0.
    """
    shared_dir(rows.sparkSession)
    first = rows.select("features").first()
    if first is None:
        return [Booster(task, 0.0, 0, []) for _ in jobs]
    if "outer" not in rows.columns:
        rows = rows.withColumn("outer", F.lit(-2))
    size = len(first["features"])
    edges = bin_edges(rows, size, bins)
    setup, held_out = _set_up(rows, jobs, task, edges)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.count() * size <= LOCAL_CELLS * (BUSY if 2 * len(jobs) >= cores else 1):
        trees, errors = _run_local(_blocks(rows, edges), jobs, setup, held_out)
    else:
        # a task sends one sum of histograms per model, so there are only as many as run at a time
        trees, errors = _run_spread(_blocks(rows, edges, cores), jobs, setup, held_out)
    out = []
    for job, base, mine, curve in zip(jobs, setup.bases, trees, errors):
        kept = best_round(curve, job.member.patience)[0] if job.fold >= 0 else len(mine)
        out.append(Booster(task, base, size, mine[:kept], curve))
    return out


def _set_up(rows: DataFrame, jobs: Sequence[Job], task: str, edges: list[np.ndarray]):
    """Units for exact sums, every model's base score, and its number of held-out rows."""
    label = F.col("label").cast("double")
    whole = rows.agg(
        F.count(label).alias("n"), F.min(label).alias("low"), F.max(label).alias("high")
    ).first()
    n, low, width = whole["n"], whole["low"], whole["high"] - whole["low"]
    reach = 4 * max(width, 1e-12)
    # whole multiples of a unit, so that the sums do not depend on the order of rows
    unit = _unit(n, max(width, 1e-12))
    groups = (
        rows.groupBy("fold", "outer")
        .agg(
            F.count(label).alias("n"), F.sum(F.rint((label - low) / unit).cast("long")).alias("sum")
        )
        .orderBy("fold", "outer")
        .collect()
    )
    bases, held_out = [], []
    for job in jobs:
        mine = [g for g in groups if g["outer"] != job.outer]
        own = [g for g in mine if g["fold"] != job.fold]
        mean = low + unit * sum(g["sum"] for g in own) / max(sum(g["n"] for g in own), 1)
        p = min(max(mean, 1e-6), 1 - 1e-6)
        bases.append(float(np.log(p / (1 - p))) if task == "clf" else float(mean))
        held_out.append(sum(g["n"] for g in mine if g["fold"] == job.fold))
    if task == "clf":
        units = _unit(n, 1.0), _unit(n, 1.0), _unit(n, 64.0)
    else:
        units = _unit(n, reach), _unit(n, 1.0), _unit(n, reach**2)
    return Setup(task, edges, bases, *units), held_out


def _going_on(jobs: Sequence[Job], trees: list[list[Tree]], errors: list[list[float]]) -> list[int]:
    return [
        i
        for i, job in enumerate(jobs)
        if len(trees[i]) < job.member.rounds
        and not (job.fold >= 0 and errors[i] and best_round(errors[i], job.member.patience)[1])
    ]


def _run_local(blocks: RDD, jobs: Sequence[Job], setup: Setup, held_out: list[int]):
    """One task per model, which reads all blocks. A job of Spark takes a model on until it ends, by
    as many rounds at most as all jobs before it, so that the scores, which a task makes anew from the
    trees there are, cost no more than one look at the rows for each tree grown."""
    sc = blocks.context
    settings = sc.broadcast((list(jobs), setup, held_out))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    whole = blocks.coalesce(1)
    trees, errors = [[] for _ in jobs], [[] for _ in jobs]
    done = 0
    while live := _going_on(jobs, trees, errors):
        live.sort(key=lambda i: -jobs[i].member.limits.most_leaves)  # the longest ones first
        before = [sc.broadcast((trees[i], errors[i])) for i in live]
        rounds = max(done, FIRST_ROUNDS)

        def work(at, some, live=live, before=before, rounds=rounds):
            jobs, setup, held_out = settings.value
            i = live[at]
            yield i, *_taken_on(some, jobs[i], setup, setup.bases[i], held_out[i], rounds, *before[at].value)

        for i, new, sums in sc.union([whole] * len(live)).mapPartitionsWithIndex(work).collect():
            trees[i] += new
            errors[i] += sums
        done += rounds
        for b in before:
            b.unpersist()
    blocks.unpersist()
    return trees, errors


def _taken_on(
    blocks: Iterable[Block],
    job: Job,
    setup: Setup,
    base: float,
    held_out: int,
    rounds: int,
    trees: list[Tree],
    errors: list[float],
):
    """New trees and errors of a model, ``rounds`` at most."""
    share = _gathered(blocks, job, setup)
    score = np.full(len(share.label), base)
    score = _scores_after(trees, share.coded.bins, score)
    trees, errors, first = list(trees), list(errors), len(trees)
    while len(trees) < first + rounds and _going_on([job], [trees], [errors]):
        some = min(job.member.patience, job.member.rounds - len(trees))
        score, new, sums = _advanced(share, score, job, len(trees), some, setup)
        trees += new
        errors += [s * setup.error_unit / max(held_out, 1) for s in sums]
    return trees[first:], errors[first:]


def _gathered(blocks: Iterable[Block], job: Job, setup: Setup) -> Share:
    """A model's rows; those of its outer fold are left out."""
    parts = [b.rows(np.flatnonzero(b.outer != job.outer)) for b in blocks]
    block = Block.stacked(parts)
    parts.clear()
    return _share(block, *_order(block, job), setup)


# A record at a time on either side of a zip: the usual batches would come a hundred at once.
SINGLY = BatchedSerializer(CPickleSerializer(), 1)


def _run_spread(blocks: RDD, jobs: Sequence[Job], setup: Setup, held_out: list[int]):
    """Histograms of all models are added up over the cluster, one request of all trees a time.

    The blocks are stored once; a round leaves only new scores, a record for each block.
    """
    sc = blocks.context
    bases = np.array(setup.bases)
    blocks = blocks._reserialize(SINGLY).persist(StorageLevel.MEMORY_AND_DISK)
    scores = blocks.map(lambda b: np.tile(bases, (len(b.label), 1)).T)
    scores = scores._reserialize(SINGLY).persist(StorageLevel.MEMORY_AND_DISK)
    trees, errors = [[] for _ in jobs], [[] for _ in jobs]
    settings = sc.broadcast((list(jobs), setup))
    count = 0
    while live := _going_on(jobs, trees, errors):
        round_ = {i: len(trees[i]) for i in live}
        grown: dict[int, Tree] = {}
        state = blocks.zip(scores)
        for some in _together(live, jobs, setup):
            grown |= _grow_spread(state, some, round_, settings)
        new = sc.broadcast(grown)
        moved = state.map(lambda x, new=new: _moved(*x, new.value))
        moved = moved._reserialize(SINGLY).persist(StorageLevel.MEMORY_AND_DISK)
        count += 1
        if count % STORE_EVERY == 0:
            moved.checkpoint()
        sums = blocks.zip(moved).map(lambda x, live=live: _error_sums(*x, live, *settings.value))
        for i, total in zip(live, sums.treeReduce(np.add)):
            trees[i].append(grown[i])
            errors[i].append(total * setup.error_unit / max(held_out[i], 1))
        scores.unpersist()
        scores = moved
    scores.unpersist()
    blocks.unpersist()
    return trees, errors


def _together(live: Sequence[int], jobs: Sequence[Job], setup: Setup) -> list[list[int]]:
    """Models whose trees grow at the same time: as many as may keep their histograms; a model that
    may not is alone."""
    out, cells = [], KEPT_CELLS + 1
    for i in live:
        own = _keeps(jobs[i].member.limits, setup)
        if cells + own > KEPT_CELLS:
            out.append([])
            cells = 0
        out[-1].append(i)
        cells += own
    return out


def _grow_spread(state: RDD, some: list[int], round_: dict[int, int], settings) -> dict[int, Tree]:
    """A tree of each of some models. What is kept of the histograms stays with the model's task of
    the reduce side."""
    sc, (jobs, setup) = state.context, settings.value
    keep = sum(_keeps(jobs[i].member.limits, setup) for i in some) <= KEPT_CELLS
    growing = {i: grow(jobs[i].member.limits) for i in some}
    asked = {i: next(g) for i, g in growing.items()}
    out: dict[int, Tree] = {}
    kept: RDD | None = None
    while asked:
        answers: dict[int, dict] = {i: {} for i in asked}
        if keep:
            shares = {i: shared_sums(*asked[i]) if i in asked else None for i in some}
            trees = {i: tree for i, (tree, _) in asked.items()}
            nodes = {i: [n for n, _, _ in shares[i] or ()] for i in some}
            sums = _sums(state, sc.broadcast((trees, nodes)), some, round_, settings)
            work = _answered(sc.broadcast(shares), round_, settings)
            following = (kept.zip(sums) if kept else sums.map(lambda x: ((0, {}, {}), x))).map(work)
            following = following._reserialize(SINGLY).persist(StorageLevel.MEMORY_AND_DISK)
            found = following.map(lambda x: (x[0], x[2])).collect()
            if kept is not None:
                kept.unpersist()
            kept = following
            for i, mine in found:
                answers.get(i, {}).update(mine)
        else:  # one model
            ((i, (tree, wanted)),) = asked.items()
            for group in _node_groups(wanted, 3 * setup.starts[-1]):
                request = sc.broadcast(({i: tree}, {i: group}))
                work = _answered(sc.broadcast({i: [(n, -1, [n]) for n in group]}), round_, settings)
                sums = _sums(state, request, some, round_, settings)
                for _, _, mine in sums.map(lambda x, work=work: work(((0, {}, {}), x))).collect():
                    answers[i].update(mine)
        for i in list(asked):
            try:
                asked[i] = growing[i].send(answers[i])
            except StopIteration as end:
                member = jobs[i].member
                out[i] = finish(*end.value, member.limits, setup.edges, member.step)
                del asked[i]
    if kept is not None:
        kept.unpersist()
    return out


def _sums(state: RDD, request, some: list[int], round_: dict[int, int], settings) -> RDD:
    """(model, sums of the nodes requested), each model in a partition of its own."""

    def added(pairs):
        jobs, setup = settings.value
        trees, nodes = request.value
        total: dict[int, np.ndarray] = {}
        for block, score in pairs:
            coded = Coded(block.bins, setup.starts)
            for i in some:
                if nodes[i]:
                    drawn = _draw_spread(block, coded, score[i], jobs[i], round_[i], setup)
                    drawn.leaves.follow(trees[i], nodes[i])
                    sums = _histograms(drawn, nodes[i], setup)
                else:
                    sums = np.zeros((0, 3, setup.starts[-1]))
                total[i] = total[i] + sums if i in total else sums
        yield from total.items()

    return state.mapPartitions(added).reduceByKey(np.add, len(some), some.index)._reserialize(SINGLY)


def _answered(shares, round_: dict[int, int], settings):
    """From a model's kept histograms and new sums: (model, kept histograms, answers); a finished
    tree has None for its shares and keeps nothing."""

    def work(pair):
        (_, kept, _), (i, sums) = pair
        if shares.value[i] is None:
            return i, {}, {}
        jobs, setup = settings.value
        limits, columns = jobs[i].member.limits, _columns(jobs[i], round_[i], len(setup.edges))
        found = _derived(shares.value[i], sums, kept)
        answers = {}
        for group in _node_groups(list(found), 3 * setup.starts[-1]):
            mine = _answers(np.stack([found[n] for n in group]), limits, columns, setup)
            answers |= dict(zip(group, mine))
        split = {parent for _, parent, _ in shares.value[i]}
        split |= {n for n, (best, _) in answers.items() if best is None}  # nothing follows from these
        left = {n: hist for n, hist in (kept | found).items() if n not in split}
        return i, left, answers

    return work


def _draw_spread(
    block: Block, coded: Coded, score: np.ndarray, job: Job, round_: int, setup: Setup
) -> Drawn:
    rows = np.flatnonzero(_sides(block, job)[0])
    rows = rows[_drawn(block.mark[rows], job.member, round_)]
    leaves = Leaves(coded.bins, rows, len(rows))
    return Drawn(coded, leaves, lambda some: _in_units(score[some], block.label[some], setup))


def _moved(block: Block, score: np.ndarray, grown: dict[int, Tree]) -> np.ndarray:
    score, bins = score.copy(), by_feature(block.bins)
    for i, tree in grown.items():
        score[i] = _scores_after([tree], bins, score[i])
    return score


def _error_sums(block: Block, score: np.ndarray, live: list[int], jobs: list[Job], setup: Setup):
    held = [np.flatnonzero(_sides(block, jobs[i])[1]) for i in live]
    return np.array([_error_sum(score[i][rows], block.label[rows], setup) for i, rows in zip(live, held)])
