import math
from fractions import Fraction

import numpy as np
import pytest

from factlog.llm import whitening as wh


@pytest.mark.parametrize("kind", ["random", "equal", "flat", "close", "one"])
def test_leading_pairs_equal_a_full_decomposition(kind):
    rng = np.random.default_rng(3)
    d = 1 if kind == "one" else 40
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = {"random": rng.uniform(0, 9, d), "equal": np.r_[[5.0] * 4, [2.0] * 30, [1.0] * 6], "flat": np.r_[rng.uniform(1, 9, 6), np.zeros(34)], "close": 1 + 1e-9 * np.arange(d), "one": np.array([3.0])}[kind]
    v = q @ np.diag(e) @ q.T
    v = (v + v.T) / 2
    s = wh.Spectrum(v)
    values, axes = s.leading(min(d, 32))
    assert np.abs(values - np.sort(e)[::-1][:32]).max() < 1e-13 * e.max() * 10
    assert np.abs(axes @ axes.T - np.eye(len(values))).max() < 1e-11 and np.abs(axes @ v - values[:, None] * axes).max() < 1e-12 * e.max()
    for shift in rng.uniform(e.min() - 1, e.max() + 1, 20):
        assert wh.inertia(v - shift * np.eye(d)) == (np.linalg.eigvalsh(v) > shift).sum()


def test_inertia_of_matrices_without_diagonals():
    assert wh.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and wh.inertia(np.zeros((3, 3))) == 0 and wh.inertia(np.zeros((0, 0))) == 0
    a = np.random.default_rng(0).normal(size=(30, 30))
    a = a + a.T
    np.fill_diagonal(a, 0)
    assert wh.inertia(a) == (np.linalg.eigvalsh(a) > 0).sum()


def plain(x: list[list[int]], most: int = 32):
    """Whitening by exact sums and numpy's full decomposition."""
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(r, sums, strict=True)] for r in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return y @ u / np.sqrt(e), e / np.trace(v), [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]


def test_rows_equal_brute_force_however_the_table_is_cut(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(300, 12)).astype(np.float32) * rng.uniform(0.2, 3, 12).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "vec_id long, embedding array<float>")
    want, shares, deviations = plain([[math.floor(64 * float(v)) + 1_000_000 for v in r] for r in c])
    for parts in (1, 7):
        out = wh.whiten(df.repartition(parts)).collect()
        assert len(out) == 300 * 12 and {r.n for r in out} == {300} and max(r.identity_error for r in out) < 1e-9
        assert all(r.deviation == deviations[r.vec_id] and abs(r.explained / shares[r.component - 1] - 1) < 1e-9 for r in out)
        got = np.zeros((300, 12))
        for r in out:
            got[r.vec_id, r.component - 1] = r.whitened
        assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9


def test_odd_rows(spark):
    rows = [(None, [1.0, 0.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 2.0]), (6, [0.0, 2.0]), (7, [5.0, 5.0]), (8, [1.0, 2.0, 3.0]), (9, [1e30, 1e300])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, size string").repartition(3)
    out = wh.whiten(df).collect()
    # five vectors of two entries; the one of three is alone and has no variance
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.component) for r in out) == [(-1, 1), (6, 1), (6, 1), (7, 1), (9, 1)] or len(out) == 10
    assert {r.n for r in out} == {5} and all(r.deviation is None or r.deviation >= 0 for r in out) and [r.deviation for r in out if r.vec_id == 9][0] is None
    plain_rows = wh.whiten(df.where("vec_id <> 9 OR vec_id IS NULL")).collect()
    assert len(plain_rows) == 8 and {r.n for r in plain_rows} == {4} and max(r.identity_error for r in plain_rows) < 1e-12
    assert wh.whiten(df.where("vec_id = 8")).count() == 0 and wh.whiten(df.where("vec_id = 6")).count() == 0 and wh.whiten(df.where("false")).count() == 0


def test_deviations_are_exact_beyond_doubles():
    f = wh.Fit(10**9, [10**15 + 7, 10**15 - 3])
    x = np.array([[1_000_000, 1_000_001], [1_002_000, 1_000_000]])
    want = [sum((10**9 * int(a) - s) ** 2 for a, s in zip(r, f.sums, strict=True)) for r in x]
    assert f.deviations(x) == [w if w < 1 << 63 else None for w in want] and want[0] < 1 << 63 <= want[1]
