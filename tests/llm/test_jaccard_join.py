"""The answers of the buckets: rows for blocks of sets, not for each set in each bucket."""

import random

import numpy as np

from subloom.llm import jaccard_join


def test_few_rows_pass_from_buckets(spark, monkeypatch):
    r = random.Random(7)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(40 + i, " ".join([*t[:-1], "other"])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "BUCKET_ENTRIES", 100)
    asked, regions = [], jaccard_join.shared_heads

    def counted(*args):
        out = regions(*args)
        asked.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "shared_heads", counted)
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()))
    assert got == sorted((i, 56, i % 40) for i in range(80))
    buckets = -(-sum(56 // 4 + 56 // 8 + 1 for _ in rows) // 100)
    assert asked[0] <= buckets * buckets  # with a row for each set in each bucket some 1,500


def test_sizes_that_allow_no_link():
    shingle = np.array([1, 1, 1, 2, 2, 3, 3, 3, 3], np.uint64)
    size = np.array([10, 14, 40, 75, 100, 100, 30, 134, 29])
    want = [False, False, False, True, True, False, True, False, True]
    assert jaccard_join.similar_sizes(shingle, size, 75).tolist() == want
    assert len(jaccard_join.similar_sizes(shingle[:0], size[:0], 75)) == 0


def test_regions_named_by_few_shingles():
    name = np.array([5, 5, 5, 5, 7, 7, 9])
    shingles = np.array([9, 1, 2, 1, 4, 3, 2])
    most = np.array([3, 3, 3, 3, 2, 2, 2])
    assert jaccard_join.needed_regions(name, shingles, most).tolist() == [True, False, True, False, True, True, False]
    assert len(jaccard_join.needed_regions(name[:0], shingles[:0], most[:0])) == 0
    sizes = np.arange(1, 2_000)
    for percent in (50, 75, 90, 100):
        spare = jaccard_join.spared(sizes, percent)
        for a, d in zip(sizes, spare):
            low = -(-a * percent // 100)
            assert d + spare[low - 1 : a].max() <= low // jaccard_join.MORE


def test_sets_stay_away_from_chance_regions(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**6)}"
    phrases = [" ".join(word() for _ in range(5)) for _ in range(60)]
    texts = [[" ".join(word() for _ in range(3)) if i % 2 else r.choice(phrases) for i in range(30)] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(60 + i, " ".join([*t[:-1], "other"])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stored, regions = [], jaccard_join._regions
    # As if no shingle were known to be rarer than another.
    monkeypatch.setattr(jaccard_join, "rarity_of", lambda pieces: np.zeros(jaccard_join.CELLS, np.uint64))

    def counted(*args):
        out = regions(*args)
        stored.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_regions", counted)
    got = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(docs).collect()}
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    assert got == dict(enumerate(root))
    assert stored[0] < 3 * len(rows), stored
