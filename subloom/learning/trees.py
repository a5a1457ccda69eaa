"""Regression trees over binned features: split search, growth by gain, prediction.

Trees are grown without looking at rows: ``grow`` asks for the best splits of some nodes and is
sent them, whoever adds up the histograms.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np


@dataclass(frozen=True)
class Limits:
    """What a tree must keep to. 0 leaves or depth: no such bound."""

    leaves: int
    depth: int
    min_rows: int
    min_weight: float
    penalty: float

    @property
    def most_leaves(self) -> int:
        return self.leaves or 2**self.depth


@dataclass(frozen=True)
class Split:
    """Rows of a bin up to ``bin`` go left, others right; missing values (bin 0) by
    ``missing_left``. ``left`` and ``right`` are sums of gradient, curvature and rows."""

    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: tuple[float, float, float]
    right: tuple[float, float, float]


# Rows below which all features are added up at once. Else features share a pass: their joint cells
# are added up and then summed over all but one of them. From ``PAIR_ROWS`` rows a slot on as many
# share it as have ``PAIR_CELLS`` joint cells, from ``SOME_ROWS`` on those with ``SOME_CELLS``.
FEW_ROWS = 2_048
PAIR_ROWS, PAIR_CELLS = 3_000, 4_096
SOME_ROWS, SOME_CELLS = 150, 256
# Rows whose bin numbers are turned at a time.
TURNED = 2_048


def packs(widths: Sequence[int], most: int) -> list[list[int]]:
    """Features that share a pass: wide ones first, each with the first group that has room."""
    out: list[list[int]] = []
    cells: list[int] = []
    for j in sorted(range(len(widths)), key=lambda j: -widths[j]):
        at = next((i for i, c in enumerate(cells) if c * widths[j] <= most), len(out))
        if at == len(out):
            out.append([])
            cells.append(1)
        out[at].append(j)
        cells[at] *= widths[j]
    return out


class Coded:
    """Rows of bin numbers, feature by feature. ``shared`` has the numbers of joint cells."""

    def __init__(self, bins: np.ndarray, starts: np.ndarray):
        self.bins = by_feature(bins)
        self.widths = np.diff(starts).tolist()
        self._shared: dict[int, list[tuple[list[int], np.ndarray]]] = {}

    def shared(self, most: int) -> list[tuple[list[int], np.ndarray]]:
        if most not in self._shared:
            self._shared[most] = [(f, self._joint(f)) for f in packs(self.widths, most)]
        return self._shared[most]

    def _joint(self, features: Sequence[int]) -> np.ndarray:
        first, *others = features
        if not others:
            return self.bins[first]
        cells = int(np.prod([self.widths[f] for f in features]))
        out = self.bins[first].astype(np.min_scalar_type(cells - 1))
        for f in others:
            out *= self.widths[f]
            out += self.bins[f]
        return out


def by_feature(bins: np.ndarray) -> np.ndarray:
    """(rows, features) turned into (features, rows), some rows at a time, which stay in cache."""
    if bins.flags.f_contiguous:
        return bins.T
    out = np.empty(bins.shape[::-1], bins.dtype)
    for a in range(0, len(bins), TURNED):
        out[:, a : a + TURNED] = bins[a : a + TURNED].T
    return out


class Picked:
    """Some rows, by number or as a slice."""

    def __init__(self, coded: Coded, rows: np.ndarray | slice):
        self.coded, self.rows = coded, rows

    def __len__(self) -> int:
        rows = self.rows
        return rows.stop - rows.start if isinstance(rows, slice) else len(rows)


class Leaves:
    """The rows of a growing tree by leaf, with how many of them are seen: those come first.
    ``rows`` are all of them if None."""

    def __init__(self, bins: np.ndarray, rows: np.ndarray | None, seen: int):
        self.bins = bins
        self.whole = rows is None
        self.held = {0: (np.arange(bins.shape[1]) if rows is None else rows, seen)}

    def seen(self, node: int) -> np.ndarray | slice:
        rows, seen = self.held[node]
        return slice(0, seen) if self.whole and node == 0 else rows[:seen]

    def follow(self, tree: Tree, wanted: Iterable[int] | None = None) -> None:
        """Move rows down to the tree's leaves; with ``wanted`` only towards these nodes."""
        needed = None if wanted is None else _with_above(tree, wanted)
        todo = [n for n in self.held if tree.feature[n] >= 0]
        while todo:
            node = todo.pop()
            rows, seen = self.held.pop(node)
            left = self._go_left(tree, node, rows)
            for child, right in ((tree.left[node], False), (tree.right[node], True)):
                if needed is None or child in needed:
                    side = ~left if right else left
                    self.held[child] = rows.compress(side), int(np.count_nonzero(side[:seen]))
                    if tree.feature[child] >= 0:
                        todo.append(child)

    def _go_left(self, tree: Tree, node: int, rows: np.ndarray) -> np.ndarray:
        v = self.bins[tree.feature[node]]
        v = v if self.whole and node == 0 else v.take(rows)
        if tree.missing_left[node]:
            return v <= tree.bin[node]
        return v - np.uint8(1) < tree.bin[node]  # 0 becomes the largest number


def _with_above(tree: Tree, nodes: Iterable[int]) -> set[int]:
    above = {}
    for node, feature in enumerate(tree.feature):
        if feature >= 0:
            above[tree.left[node]] = above[tree.right[node]] = node
    out: set[int] = set()
    for node in nodes:
        while node is not None and node not in out:
            out.add(node)
            node = above.get(node)
    return out


def histogram(
    bins: np.ndarray | Picked,
    slots: np.ndarray | None,
    g: np.ndarray,
    h: np.ndarray,
    n_slots: int,
    starts: np.ndarray,
) -> np.ndarray:
    """Sums of gradient, curvature and rows by slot and cell: (slots, 3, cells). ``slots`` names
    the slot of each row (None: all have the only one); the bins of feature j are the cells from
    ``starts[j]`` on."""
    some = bins if isinstance(bins, Picked) else Picked(Coded(bins, starts), slice(0, len(bins)))
    coded, rows, n = some.coded, some.rows, len(some)
    cells = starts[-1]
    out = np.empty((n_slots, 3, cells))
    even = bool((h == h[:1]).all())  # then curvature is a multiple of the rows
    # two sums in a pass, as the parts of complex numbers
    both = np.empty(n, np.complex128)
    both.real, both.imag = g, 1 if even else h
    if n < FEW_ROWS:
        at = picked(coded.bins, rows) + starts[:-1, None]
        if slots is not None:
            at += slots * cells
        at = at.ravel()
        sums = np.zeros(n_slots * cells, np.complex128)
        np.add.at(sums, at, np.tile(both, len(coded.bins)))
        sums = sums.reshape(n_slots, cells)
        out[:, 0], out[:, 1] = sums.real, sums.imag
        if not even:
            out[:, 2] = np.bincount(at, None, n_slots * cells).reshape(n_slots, cells)
    else:
        most = PAIR_CELLS if n >= PAIR_ROWS * n_slots else SOME_CELLS if n >= SOME_ROWS * n_slots else 0
        for features, codes in coded.shared(most):
            widths = [coded.widths[f] for f in features]
            joint = int(np.prod(widths))
            at = picked(codes, rows).astype(np.int64)
            if slots is not None:
                at += slots * joint
            sums = np.zeros(n_slots * joint, np.complex128)
            np.add.at(sums, at, both)
            for f, own in zip(features, _margins(sums.reshape(n_slots, joint), widths)):
                out[:, 0, starts[f] : starts[f + 1]] = own.real
                out[:, 1, starts[f] : starts[f + 1]] = own.imag
            if not even:
                sums = np.bincount(at, None, n_slots * joint).reshape(n_slots, joint)
                for f, own in zip(features, _margins(sums, widths)):
                    out[:, 2, starts[f] : starts[f + 1]] = own
    if even:
        out[:, 2] = out[:, 1]
        out[:, 1] *= h[:1]
    return out


def picked(values: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
    """The last axis at some rows."""
    return values[..., rows] if isinstance(rows, slice) else values.take(rows, axis=-1)


def _margins(sums: np.ndarray, widths: Sequence[int]) -> Iterator[np.ndarray]:
    """Sums of joint cells (slots, cells) by the cells of each feature."""
    rest = sums
    for i, width in enumerate(widths):
        if i == len(widths) - 1:
            yield rest
            return
        both = rest.reshape(len(sums), width, -1)
        yield both.sum(axis=2)
        rest = both.sum(axis=1)


def best_splits(
    hists: np.ndarray, limits: Limits, columns: np.ndarray, starts: np.ndarray
) -> list[Split | None]:
    """For each histogram (3, cells) the split of largest gain over the allowed features, edges
    and both directions for missing values; the first of equal ones. None if none gains."""
    feature = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = starts[:-1]
    usable = np.isin(feature, columns)
    usable[first] = False  # the cells of missing values
    cells = np.flatnonzero(usable)
    if not len(cells):
        return [None] * len(hists)
    missing = hists[:, :, first]
    present = hists.copy()
    present[:, :, first] = 0
    upto = np.cumsum(present, axis=2)
    left = (upto - upto[:, :, first][:, :, feature])[:, :, cells]
    holes = cells[(missing[:, 2] > 0).any(axis=0)[feature[cells]]]
    if len(holes):  # once more, with missing values on the left
        again = left[:, :, np.searchsorted(cells, holes)] + missing[:, :, feature[holes]]
        left = np.concatenate([left, again], axis=2)
    total = hists[:, :, : starts[1]].sum(axis=2)
    right = total[:, :, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        score = _value(total[:, 0], total[:, 1], limits)
        gain = _value(left[:, 0], left[:, 1], limits)
        gain += _value(right[:, 0], right[:, 1], limits)
    for side in (left, right):
        gain[(side[:, 2] < limits.min_rows) | (side[:, 1] < limits.min_weight)] = -np.inf
    found: list[Split | None] = []
    for k, at in enumerate(gain.argmax(axis=1)):
        more = gain[k, at] - score[k]
        if not more > 1e-12 * abs(score[k]):
            found.append(None)
            continue
        cell = cells[at] if at < len(cells) else holes[at - len(cells)]
        j, missing_left = feature[cell], bool(at >= len(cells))
        # added up anew, cell by cell of one feature, so that the sums are exact
        sums = hists[k, :, first[j] + 1 : cell + 1].sum(axis=1) + missing_left * missing[k, :, j]
        rest = total[k] - sums
        if missing[k, 2, j] == 0:  # none missing here: later ones follow the larger part
            missing_left = bool(sums[2] >= rest[2])
        parts = tuple(sums.tolist()), tuple(rest.tolist())
        found.append(Split(float(more), int(j), int(cell - first[j]), missing_left, *parts))
    return found


def best_split(
    hist: np.ndarray, limits: Limits, columns: np.ndarray, starts: np.ndarray
) -> Split | None:
    return best_splits(hist[None], limits, columns, starts)[0]


def _value(g, h, limits: Limits):
    return g * g / (h + limits.penalty)


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. ``threshold`` is the value up to which rows go
    left, ``gain`` and ``rows`` are those of training."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)

    def add(self, rows: float = 0.0) -> int:
        for name, empty in (
            ("feature", -1), ("bin", 0), ("missing_left", False), ("left", 0), ("right", 0),
            ("threshold", 0.0), ("value", 0.0), ("gain", 0.0), ("rows", rows),
        ):
            getattr(self, name).append(empty)
        return len(self.feature) - 1

    def split(self, node: int, s: Split) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node] = s.feature, s.bin, s.gain
        self.missing_left[node] = s.missing_left
        self.left[node], self.right[node] = self.add(s.left[2]), self.add(s.right[2])
        return self.left[node], self.right[node]

    def depth(self) -> int:
        below = [0] * len(self.feature)
        for node in range(len(self.feature)):
            if self.feature[node] >= 0:
                below[self.left[node]] = below[self.right[node]] = below[node] + 1
        return max(below)

    def leaf_of(self, x: np.ndarray, binned: bool, start: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, for bin numbers or for values with NaN where missing. ``start``
        has nodes that the rows are known to reach."""
        feature, limit = np.array(self.feature), np.array(self.bin if binned else self.threshold)
        to_left, left, right = map(np.array, (self.missing_left, self.left, self.right))
        node = np.zeros(len(x), np.int64) if start is None else start.copy()
        live = np.arange(len(x))
        while len(live):
            live = live[feature[node[live]] >= 0]
            at = node[live]
            v = x[live, feature[at]]
            missing = v == 0 if binned else np.isnan(v)
            go_left = np.where(missing, to_left[at], v <= limit[at])
            node[live] = np.where(go_left, left[at], right[at])
        return node


Answers = dict[int, tuple[Split | None, tuple[float, float, float]]]


def grow(limits: Limits) -> Generator[tuple[Tree, list[int]], Answers, tuple[Tree, dict]]:
    """Grow one tree, the leaf of largest gain first. Yields the tree so far and nodes whose best
    split (and sums) it wants to be sent; returns the tree and the sums of its nodes.

    Nodes that are likely to be split are asked for ahead of their turn, a level at a time, so
    that a tree takes about as many requests as it is deep. Their turn is then played again with
    all gains known: the result is the same as of one request per split.
    """
    tree = Tree()
    wanted, found, sums, depth = [tree.add()], {}, {}, {0: 0}
    while wanted:
        for node, (split, total) in (yield tree, wanted).items():
            found[node], sums[node] = split, total
        wanted = []
        for node in _turns(tree, found, limits):
            if tree.feature[node] >= 0:
                continue
            split = found[node]
            for child, part in zip(tree.split(node, split), (split.left, split.right)):
                sums[child], depth[child] = part, depth[node] + 1
                deep = limits.depth and depth[child] >= limits.depth
                if deep or part[2] < 2 * limits.min_rows:
                    found[child] = None
                else:
                    wanted.append(child)
    return _cut(tree, set(_turns(tree, found, limits)), sums)


def _turns(tree: Tree, found: dict[int, Split | None], limits: Limits) -> list[int]:
    """Nodes in the order in which they are split, as far as splits are known."""
    turns: list[int] = []
    heap: list[tuple[float, int]] = []

    def offer(node: int) -> None:
        if found.get(node):
            heappush(heap, (-found[node].gain, node))

    offer(0)
    while heap and len(turns) + 1 < limits.most_leaves:
        node = heappop(heap)[1]
        turns.append(node)
        if tree.feature[node] >= 0:
            offer(tree.left[node])
            offer(tree.right[node])
    return turns


def _cut(tree: Tree, kept: set[int], sums: dict) -> tuple[Tree, dict]:
    """Without what was split ahead of a turn that never came."""
    out, totals = Tree(), {}
    todo = [(0, out.add())]
    while todo:
        old, new = todo.pop()
        totals[new] = sums[old]
        out.rows[new] = sums[old][2]
        if old in kept:
            for name in ("feature", "bin", "missing_left", "gain"):
                getattr(out, name)[new] = getattr(tree, name)[old]
            out.left[new], out.right[new] = out.add(), out.add()
            todo += [(tree.left[old], out.left[new]), (tree.right[old], out.right[new])]
    return out, totals


def leaves_in(cut: Tree, tree: Tree) -> np.ndarray:
    """For each node of a tree the leaf that stands for it, or lies above it, in what ``grow`` left
    of the tree. Nodes that stayed inner ones have -1."""
    out = np.full(len(tree.feature), -1)
    todo = [(0, 0)]
    while todo:
        old, new = todo.pop()
        inner = cut.feature[new] >= 0
        if not inner:
            out[old] = new
        if tree.feature[old] >= 0:
            sides = (cut.left[new], cut.right[new]) if inner else (new, new)
            todo += zip((tree.left[old], tree.right[old]), sides)
    return out


def shared_sums(tree: Tree, nodes: Iterable[int]) -> list[tuple[int, int, list[int]]]:
    """What is to be added up for some nodes, as (node, parent, nodes that are wanted): one child of
    each parent, the one with fewer rows. The other one has the rest of the parent's sums. The
    root's parent is -1."""
    wanted = set(nodes)
    out = [(0, -1, [0])] if 0 in wanted else []
    for parent, feature in enumerate(tree.feature):
        pair = [tree.left[parent], tree.right[parent]]
        if feature >= 0 and wanted & set(pair):
            fewer = min(pair, key=lambda n: tree.rows[n])
            out.append((fewer, parent, [n for n in pair if n in wanted]))
    return out


def finish(tree: Tree, totals: dict, limits: Limits, edges: list[np.ndarray], step: float) -> Tree:
    """Set thresholds and leaf values, ``step`` times the Newton step."""
    for node in range(len(tree.feature)):
        g, h, _ = totals[node]
        if tree.feature[node] >= 0:
            e, b = edges[tree.feature[node]], tree.bin[node]
            tree.threshold[node] = float(e[b - 1]) if b <= len(e) else float("inf")
            continue
        weight = h + limits.penalty
        tree.value[node] = -step * g / weight if weight > 0 else 0.0
    return tree


# Rows that walk at a time, so that they stay in cache.
WALKING = 2_048


@dataclass
class Walk:
    """A tree for walking down; a leaf is its own child.

    A comparison with NaN is false. Where missing values go right a row is asked for ``x <= limit``;
    where they go left for ``x > limit``, which is ``-x <= below`` with the next smaller double.
    ``child`` has the node where the answer is no and, one place later, that for yes.
    """

    column: np.ndarray
    limit: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int

    @staticmethod
    def of(tree: Tree, size: int) -> Walk:
        feature, limit = np.array(tree.feature), np.array(tree.threshold)
        own, leaf, turned = np.arange(len(feature)), feature < 0, np.array(tree.missing_left, bool)
        left, right = (np.where(leaf, own, side) for side in (tree.left, tree.right))
        above = np.where(np.isinf(limit), np.nan, np.nextafter(limit, np.inf))
        return Walk(
            np.where(leaf, 0, feature + turned * size),
            np.where(turned, -above, limit),
            np.stack([np.where(turned, left, right), np.where(turned, right, left)], axis=1).ravel(),
            np.array(tree.value),
            tree.depth(),
        )

    def values(self, both: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of rows that begin at ``places`` of ``both``, the values and then their negatives."""
        node = np.zeros(len(places), np.int64)
        for _ in range(self.depth):
            v = both.take(places + self.column.take(node))
            node = self.child.take(2 * node + (v <= self.limit.take(node)))
        return self.value.take(node)


def predict(trees: Sequence[Walk], x: np.ndarray, base: float) -> np.ndarray:
    """``base`` plus the trees' values, for rows with NaN where missing."""
    out = np.full(len(x), base)
    for a in range(0, len(x), WALKING):
        part = x[a : a + WALKING]
        both = np.concatenate([part, -part], axis=1).ravel()
        places = np.arange(len(part)) * (2 * x.shape[1])
        for tree in trees:
            out[a : a + WALKING] += tree.values(both, places)
    return out
