import numpy as np
import pytest

from subloom.llm import whitening
from subloom.llm.whitening import leading_eigenpairs, whiten

SCHEMA = "vec_id long, embedding array<float>, id string, x string, deviation int, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "i", "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size, rank", [(1, 1), (2, 2), (3, 3), (17, 17), (64, 64), (40, 3), (30, 0)])
def test_eigenpairs(size, rank):
    r = np.random.default_rng(size)
    a = r.normal(size=(rank, size)) * 10.0 ** r.integers(-3, 4, size)
    m = a.T @ a
    values, vectors = leading_eigenpairs(m, 8)
    want = np.linalg.eigvalsh(m)[::-1][:8]
    assert np.allclose(values, want, rtol=1e-12, atol=1e-13 * max(1, want.max(initial=0)))
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
    assert np.abs(vectors @ m - values[:, None] * vectors).max() < 1e-12 * max(1, want.max(initial=0))


@pytest.mark.parametrize("m", [np.eye(12), np.diag([5.0, 5, 5, 1, 1, 0]), np.ones((9, 9)), np.zeros((4, 4))])
def test_equal_eigenvalues(m):
    values, vectors = leading_eigenpairs(m, 8)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:8], atol=1e-13)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(vectors @ m - values[:, None] * vectors).max() < 1e-12


def plain(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(c) ** 2 for c in n * row.astype(object) - sums.astype(object)) for row in x]
    centred = x - sums / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, centred @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_plain(spark):
    r = np.random.default_rng(4)
    good = (r.normal(size=(700, 20)) @ r.normal(size=(20, 20)) / 30).astype(np.float32).tolist()
    good += [good[0]] * 350  # one common vector
    rows = [(2**60 + i, v) for i, v in enumerate(good)]
    bad = [None, [], [1.0, 2.0], [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] * 20, [1e30] * 20]
    got = whiten(frame(spark, rows + [(i, v) for i, v in enumerate(bad)])).collect()
    n, deviation, white, share = plain(good)
    assert len(got) == 8 * len(good) and {g.n for g in got} == {n}
    sign = {}
    for g in sorted(got, key=lambda g: (g.vec_id, g.component)):
        i, c = g.vec_id - 2**60, g.component - 1
        want = white[i, c]
        sign.setdefault(c, np.sign(want * g.whitened))
        assert g.deviation == deviation[i] and abs(g.whitened * sign[c] - want) < 1e-9
        assert abs(g.explained / share[c] - 1) < 1e-10 and g.identity_error < 1e-9


def test_no_variance_and_null_id(spark):
    got = whiten(frame(spark, [(None, [0.5, 0.25])])).collect()
    assert [(g.vec_id, g.component, g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in got] == [
        (None, 1, 1, 0, None, 0.0, 0.0),
        (None, 2, 1, 0, None, 0.0, 0.0),
    ]
    flat = whiten(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert [g.whitened is None for g in sorted(flat, key=lambda g: g.component)] == [False] * 9 + [True] * 18


def test_empty(spark):
    assert whiten(frame(spark, [])).count() == whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_deviations_beyond_a_long():
    x = np.array([[2**50], [0]])
    assert whitening._deviations(x, 2, np.array([2**50], object)) == [None, None]
    assert whitening._deviations(x // 2**20, 2, np.array([2**30], object)) == [str(2**60)] * 2
