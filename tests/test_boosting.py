import itertools

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from subloom.learning import binning, boosting, trees
from subloom.learning.binning import bin_edges, edges_of, to_bins
from subloom.learning.boosting import Job, fit_boosters
from subloom.learning.members import Member, best_round
from subloom.learning.trees import Limits, best_split, grow, histogram

LIMITS = Limits(leaves=8, depth=0, min_rows=3, min_weight=1e-3, penalty=1.0)
STARTS = np.arange(5) * 13


def table(n=300, seed=0, size=4):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (n, size)).astype(float)
    x[r.random((n, size)) < 0.2] = np.nan
    y = np.round(np.nan_to_num(x[:, 0], nan=20) * 3 + np.nan_to_num(x[:, 1], nan=-5) ** 2 + r.normal(0, 1, n), 3)
    return x, y


def frame(spark, x, y, folds=2, parts=3):
    rows = [(i, Vectors.dense(v), float(t), i % folds) for i, (v, t) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(rows, ["id", "features", "label", "fold"]).repartition(parts)


def value(g, h, limits):
    return g * g / (h + limits.penalty)


def brute(bins, g, h, limits, columns):
    """The largest gain over every feature, edge and direction, row by row."""
    best = 0.0
    for f in columns:
        for b in range(1, bins[:, f].max(initial=0) + 1):
            for missing_left in (False, True):
                left = (bins[:, f] <= b) & (bins[:, f] > 0) | (bins[:, f] == 0) & missing_left
                sides = [(g[s].sum(), h[s].sum(), s.sum()) for s in (left, ~left)]
                if min(s[2] for s in sides) >= limits.min_rows:
                    gain = sum(value(*s[:2], limits) for s in sides) - value(g.sum(), h.sum(), limits)
                    best = max(best, gain)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_split_gain_equals_a_search_over_all(seed):
    x, y = table(80, seed)
    bins = to_bins(x, [np.arange(0.5, 11)] * 4)
    g, h = np.round(y.mean() - y, 3), np.random.default_rng(seed).uniform(0.1, 1, len(y))
    hist = histogram(bins, np.zeros(len(y), int), g, h, 1, STARTS)[0]
    columns = np.array([0, 1, 3]) if seed % 2 else np.arange(4)
    assert best_split(hist, LIMITS, columns, STARTS).gain == pytest.approx(brute(bins, g, h, LIMITS, columns))


def one_by_one(bins, g, h, limits):
    """The leaf of largest gain is split, one request at a time."""

    def split(rows):
        hist = histogram(bins[rows], np.zeros(len(rows), int), g[rows], h[rows], 1, STARTS)[0]
        return best_split(hist, limits, np.arange(bins.shape[1]), STARTS) if len(rows) >= 2 * limits.min_rows else None

    leaves = [(np.arange(len(g)), 0)]
    known = [split(leaves[0][0])]
    while len(leaves) < limits.most_leaves:
        able = [i for i, s in enumerate(known) if s and (not limits.depth or leaves[i][1] < limits.depth)]
        if not able:
            break
        i = max(able, key=lambda i: known[i].gain)
        (rows, depth), s = leaves.pop(i), known.pop(i)
        v = bins[rows, s.feature]
        left = np.where(v == 0, s.missing_left, v <= s.bin)
        for part in (rows[left], rows[~left]):
            leaves.append((part, depth + 1))
            known.append(split(part))
    return sorted(tuple(r.tolist()) for r, _ in leaves)


@pytest.mark.parametrize("leaves, depth", [(8, 0), (40, 0), (5, 2), (0, 3), (2, 0)])
def test_growth_equals_one_split_at_a_time(leaves, depth):
    limits = Limits(leaves, depth, 3, 1e-3, 0.0)
    x, y = table(400, 7)
    bins = to_bins(x, [np.arange(0.5, 11)] * 4)
    g, h = y.mean() - y, np.ones(len(y))
    growing, requests = grow(limits), 0
    tree, nodes = next(growing)
    with pytest.raises(StopIteration) as end:
        while True:
            at, requests = tree.leaf_of(bins, binned=True), requests + 1
            answers = {}
            for node in nodes:
                rows = np.flatnonzero(at == node)
                hist = histogram(bins[rows], np.zeros(len(rows), int), g[rows], h[rows], 1, STARTS)[0]
                answers[node] = best_split(hist, limits, np.arange(4), STARTS), tuple(hist[:, :13].sum(axis=1))
            tree, nodes = growing.send(answers)
    tree, _ = end.value.value
    at = tree.leaf_of(bins, binned=True)
    got = sorted(tuple(np.flatnonzero(at == leaf).tolist()) for leaf in set(at))
    assert got == one_by_one(bins, g, h, limits) and len(got) <= limits.most_leaves
    assert requests < 16 and (not depth or tree.depth() <= depth)


def same(a, b):
    return [vars(t) for t in a.trees] == [vars(t) for t in b.trees] and a.errors == b.errors


@pytest.mark.parametrize("task", ["reg", "clf"])
def test_trees_do_not_depend_on_partitions(spark, monkeypatch, task):
    x, y = table(260, 3)
    y = (y > np.median(y)).astype(float) if task == "clf" else y
    members = [
        Member("a", step=0.3, leaves=7, min_rows=4, columns=0.7, sample=0.8, redraw=5, rounds=7),
        Member("b", step=0.3, depth=3, penalty=1.0, rounds=4),
    ]
    jobs = [Job(m, i) for m in members for i in range(2)]
    local = fit_boosters(frame(spark, x, y), jobs, task)
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 100)
    monkeypatch.setattr(boosting, "HISTOGRAM_CELLS", 2_000)
    monkeypatch.setattr(boosting, "STORE_EVERY", 4)
    for parts in (1, 4):
        spread = fit_boosters(frame(spark, x, y, parts=parts), jobs, task)
        assert all(same(a, b) for a, b in zip(local, spread))
    for job, model in zip(jobs, local):
        held = np.arange(len(y)) % 2 == job.fold
        assert 1 <= len(model.trees) <= len(model.errors) <= job.member.rounds
        assert all(sum(f < 0 for f in t.feature) <= job.member.limits.most_leaves for t in model.trees)
        p = np.clip(model.scores(x[held]), 1e-12, 1 - 1e-12) if task == "clf" else model.scores(x[held])
        loss = (p - y[held]) ** 2 if task == "reg" else -np.log(np.where(y[held] == 1, p, 1 - p))
        assert model.errors[len(model.trees) - 1] == pytest.approx(loss.mean(), rel=1e-5)
        assert loss.mean() < (y.var() if task == "reg" else 0.69)


@pytest.mark.parametrize("few, pair", [(10**9, 0), (0, 0), (0, 10**9)])
def test_histogram_equals_plain_sums(monkeypatch, few, pair):
    """Of all features at once, of two and of one in a pass; also for an odd number of features."""
    monkeypatch.setattr(trees, "FEW_ROWS", few)
    monkeypatch.setattr(trees, "PAIR_ROWS", pair)
    r = np.random.default_rng(4)
    widths = [4, 9, 1, 6, 2]
    starts = np.cumsum([0, *widths])
    bins = np.stack([r.integers(0, w, 500) for w in widths], axis=1).astype(np.uint8)
    slots, g = r.integers(0, 3, 500), r.integers(-(2**40), 2**40, 500).astype(float)
    for h in (r.integers(0, 2**40, 500).astype(float), np.full(500, 8.0)):
        out = histogram(bins, slots, g, h, 3, starts)
        for s, j in itertools.product(range(3), range(5)):
            for b in range(widths[j]):
                mine = (slots == s) & (bins[:, j] == b)
                assert out[s, :, starts[j] + b].tolist() == [g[mine].sum(), h[mine].sum(), mine.sum()]


@pytest.mark.parametrize("task", ["reg", "clf"])
def test_only_one_of_two_children_is_added_up(monkeypatch, task):
    """A level costs at most half of the rows, and the trees are those of adding up all nodes."""
    x, y = table(4_000, 6, size=5)
    y = (y > np.median(y)).astype(float) if task == "clf" else y
    edges = [np.arange(0.5, 11)] * 5
    folds, marks = np.arange(4_000) % 4, np.arange(4_000).astype(np.uint64)
    block = boosting.Block(to_bins(x, edges), y, folds, np.full(4_000, -2), marks)
    setup = boosting.Setup(task, edges, [0.0], 2.0**-30, 2.0**-30, 2.0**-20)
    added, plain = [], boosting.histogram
    monkeypatch.setattr(boosting, "histogram", lambda *a: added.append(len(a[0])) or plain(*a))
    member = Member("m", step=0.3, depth=5)
    args = block, np.zeros(4_000), Job(member, 0), 0, 3, setup
    score, grown, errors = boosting._advance(*args)
    assert sum(added) <= 3 * 3_000 * (1 + 4 / 2)
    monkeypatch.setattr(boosting, "KEPT_CELLS", 0)
    again = boosting._advance(*args)
    assert score.tolist() == again[0].tolist() and errors == again[2]
    assert [vars(t) for t in grown] == [vars(t) for t in again[1]]


def test_spread_models_hold_a_bounded_record_at_a_time(spark, monkeypatch):
    x, y = table(240, 8)
    members = [Member("a", step=0.3, leaves=6, rounds=2), Member("b", step=0.3, depth=2, rounds=2)]
    jobs = [Job(m, i) for m in members for i in range(2)]
    local = fit_boosters(frame(spark, x, y), jobs, "reg")
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    monkeypatch.setattr(boosting, "RECORD_CELLS", 200)
    rows = frame(spark, x, y, parts=12).withColumn("outer", F.lit(-2))
    sizes = boosting._blocks(rows, bin_edges(rows, 4), 2).map(lambda b: b.bins.size).collect()
    assert sum(sizes) == x.size and max(sizes) <= 200
    cells = 3 * int(sum(len(e) + 2 for e in bin_edges(rows, 4)))
    for most in (0, 6 * cells, 16_000_000):  # none kept, one model at a time, all together
        monkeypatch.setattr(boosting, "KEPT_CELLS", most)
        spread = fit_boosters(frame(spark, x, y, parts=5), jobs, "reg")
        assert all(same(a, b) for a, b in zip(local, spread))


def test_boosting_is_resumed(spark):
    """The first trees of a long run are those of a short one, and rounds go on until patience."""
    x, y = table(200, 5)
    short, long = (Member("m", step=0.5, leaves=6, rounds=r, patience=4) for r in (5, 200_000))
    a, b = (fit_boosters(frame(spark, x, y), [Job(m, 0)], "reg")[0] for m in (short, long))
    assert a.errors == b.errors[:5]
    best, done = best_round(b.errors, 4)
    assert done and len(b.trees) == best and b.errors[best - 1] == min(b.errors)
    assert len(b.errors) < 200


def test_only_the_learned_side_of_missing_values_separates(spark):
    """Missing values go with large ones in one feature and with small ones in the other."""
    r = np.random.default_rng(2)
    kind = r.integers(0, 2, 400)
    label = kind.astype(float)
    hidden = r.random(400) < 0.5
    a = np.where(hidden & (kind == 1), np.nan, np.where(kind == 1, 9.0, 1.0))
    b = np.where(hidden & (kind == 0), np.nan, np.where(kind == 1, 9.0, 1.0))
    for column, right in ((a, True), (b, False)):
        x = column[:, None]
        stump = Member("s", step=1.0, leaves=2, rounds=1)
        tree = fit_boosters(frame(spark, x, label), [Job(stump)], "clf")[0].trees[0]
        leaf = tree.leaf_of(x, binned=False)
        assert [{label[leaf == n].mean() for n in set(leaf)}] == [{0.0, 1.0}]
        assert tree.missing_left[0] is not right


def test_edges(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = np.c_[r.integers(0, 5, 5_000), r.normal(size=5_000), np.full(5_000, np.nan), np.ones(5_000)]
    x[::7, 0] = np.nan
    edges = bin_edges(frame(spark, x, np.zeros(5_000), parts=4), 4, 16)
    assert edges[0].tolist() == [0.5, 1.5, 2.5, 3.5] and len(edges[2]) == len(edges[3]) == 0
    counts = np.bincount(to_bins(x, edges)[:, 1], minlength=16)
    assert counts[0] == 0 and len(edges[1]) == 14 and counts[1:].min() > 5_000 / 15 * 0.9
    monkeypatch.setattr(binning, "FAN_IN", 2)  # summaries of 7 tasks in three rounds
    again = bin_edges(frame(spark, x, np.zeros(5_000), parts=7), 4, 16)
    assert again[0].tolist() == edges[0].tolist()
    counts = np.bincount(to_bins(x, again)[:, 1], minlength=16)
    assert len(again[1]) == 14 and counts[1:].min() > 5_000 / 15 * 0.9
    assert edges_of(np.array([3.0, 1, 3]), np.ones(3), 64) == [2.0]


def test_no_rows_and_one_class(spark):
    x, y = table(20)
    jobs = [Job(Member("m", step=0.1, leaves=4, rounds=3), 0)]
    assert fit_boosters(frame(spark, x, y).limit(0), jobs, "reg")[0].scores(x).tolist() == [0.0] * 20
    flat = fit_boosters(frame(spark, x, np.ones(20)), jobs, "clf")[0]
    assert all(flat.scores(x) > 0.99)


def test_a_task_takes_its_model_through_many_rounds(spark, monkeypatch):
    """Jobs of Spark do not grow with the rounds, and what a job begins with is made from the trees."""
    x, y = table(200, 9)
    members = [Member("a", step=0.05, leaves=6, sample=0.8, patience=3), Member("b", step=0.05, depth=2, rounds=90)]
    jobs = [Job(m, i) for m in members for i in range(2)]
    taken, plain = [], type(spark.sparkContext).union
    monkeypatch.setattr(type(spark.sparkContext), "union", lambda sc, rdds: taken.append(len(rdds)) or plain(sc, rdds))
    whole = fit_boosters(frame(spark, x, y), jobs, "reg")
    assert taken == [4] and max(len(m.errors) for m in whole) > 50
    monkeypatch.setattr(boosting, "FIRST_ROUNDS", 20)
    parts = fit_boosters(frame(spark, x, y, parts=4), jobs, "reg")
    assert len(taken) > 2 and all(same(a, b) for a, b in zip(whole, parts))


def test_many_models_share_the_cores_a_model_each(spark, monkeypatch):
    """Beyond LOCAL_CELLS, too, as long as they keep half of the cores busy."""
    x, y = table(60, 1)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(boosting, "LOCAL_CELLS", x.size // 3)
    monkeypatch.setattr(boosting, "_run_spread", lambda *a: pytest.fail("spread"))
    many = [Job(Member(str(i), step=0.3, depth=2, rounds=1)) for i in range(cores)]
    assert len(fit_boosters(frame(spark, x, y), many, "reg")) == cores
    monkeypatch.setattr(boosting, "BUSY", 2)
    with pytest.raises(pytest.fail.Exception):
        fit_boosters(frame(spark, x, y), many, "reg")


def test_features_of_few_bins_share_a_pass():
    assert trees.packs([64, 64, 3, 3, 3, 65], 4_096) == [[5, 2, 3, 4], [0, 1]]
    assert trees.packs([3] * 9, 250) == [[0, 1, 2, 3, 4], [5, 6, 7, 8]]
    assert sorted(sum(trees.packs([300, 2, 64], 256), [])) == [0, 1, 2]
    r = np.random.default_rng(5)
    bins = r.integers(0, 3, (5_000, 40)).astype(np.uint8)
    assert len(trees.Coded(bins, np.arange(41) * 3).shared(trees.PAIR_CELLS)) == 6


@pytest.mark.parametrize("task", ["reg", "clf"])
def test_rows_by_leaf_and_walks_agree_with_one_row_at_a_time(task):
    x, y = table(3_000, 11)
    y = (y > np.median(y)).astype(float) if task == "clf" else y
    edges = [np.arange(0.5, 11)] * 4
    bins, marks = to_bins(x, edges), np.arange(3_000).astype(np.uint64)
    block = boosting.Block(bins, y, np.arange(3_000) % 3, np.full(3_000, -2), marks)
    setup = boosting.Setup(task, edges, [0.0], 2.0**-30, 2.0**-30, 2.0**-20)
    member = Member("m", step=0.3, leaves=12, sample=0.7)
    score, grown, _ = boosting._advance(block, np.zeros(3_000), Job(member, 0), 0, 4, setup)
    x[5] = np.inf, -np.inf, np.inf, -np.inf
    plain = np.zeros(3_000)
    for tree in grown:
        at = tree.leaf_of(bins, binned=True)
        plain += np.array(tree.value)[at]
        leaves = trees.Leaves(np.ascontiguousarray(bins.T), None, 1_000)
        leaves.follow(tree)
        for leaf, (rows, seen) in leaves.held.items():
            assert rows.tolist() == np.flatnonzero(at == leaf).tolist() and seen == (rows < 1_000).sum()
        some = sorted(set(at))[:2]
        part = trees.Leaves(np.ascontiguousarray(bins.T), np.arange(3_000), 0)
        part.follow(tree, some)
        assert all(part.held[n][0].tolist() == np.flatnonzero(at == n).tolist() for n in some)
    assert plain.tolist() == score.tolist()
    whole = np.zeros(3_000)
    for tree in grown:
        whole += np.array(tree.value)[tree.leaf_of(x, binned=False)]
    model = boosting.Booster("reg", 0.0, 4, grown)
    assert model.scores(x).tolist() == whole.tolist()
    flat = trees.Tree(*([v] for v in (0, 2, True, 1, 2, np.inf, 0.0, 1.0, 1.0)))
    flat.left[0], flat.right[0] = flat.add(), flat.add()
    flat.value[1:] = [1.0, 2.0]
    for flat.missing_left[0] in (True, False):
        got = trees.predict([trees.Walk.of(flat, 4)], x, 0.0)
        assert got.tolist() == np.array(flat.value)[flat.leaf_of(x, binned=False)].tolist()
