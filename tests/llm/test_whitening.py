from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from fanscope.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x array<string>, n string, i int, total string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(r[0], r[1], 1, ["x"], "n", 0, "t") for r in rows], SCHEMA.replace("array<float>", f"array<{kind}>"))


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def brute(rows):
    """Exact integers of one length, and the covariance as fractions."""
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, dims = len(fit), len(fit[0])
    s = [sum(v[d] for v in fit) for d in range(dims)]
    cov = [[Fraction(n * sum(v[i] * v[j] for v in fit) - s[i] * s[j], n * n) for j in range(dims)] for i in range(dims)]
    return x, n, s, cov


def vectors(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims))
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(rng.normal(size=(n, dims)) @ mix * 0.1 + 0.3)]


def check(spark, rows, kind="float"):
    got = W.whitening_report(table(spark, rows, kind))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    x, n, s, cov = brute([r for r in rows if usable(r[1])])
    dims = len(s)
    v = np.array([[float(c) for c in row] for row in cov])
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    trace = float(sum(cov[d][d] for d in range(dims)))
    assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted(
        ((i, k + 1) for i, u in rows if usable(u) for k in range(min(4, dims))), key=repr)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-9
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(min(4, dims)):
        side = None
        for i, u in x.items():
            r = by[i, k + 1]
            assert r.deviation == sum((n * u[d] - s[d]) ** 2 for d in range(dims))
            assert r.explained == pytest.approx(values[k] / trace, rel=1e-9)
            want = sum((u[d] - s[d] / n) * basis[d, k] for d in range(dims)) / math.sqrt(values[k])
            if side is None and abs(want) > 1e-3:
                side = 1 if (r.whitened > 0) == (want > 0) else -1
            assert r.whitened == pytest.approx((side or 1) * want, abs=1e-6)


@pytest.mark.parametrize(("n", "dims"), [(300, 7), (5000, 3), (40, 1)])
def test_report_against_brute_force(spark, n, dims):
    check(spark, vectors(n, dims))


def test_copies_count_once(spark):
    rows = vectors(50, 5)
    check(spark, rows + [(1000 + k, rows[3][1]) for k in range(300)])


def test_rows_without_a_usable_vector_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, []), (102, [None, 0.0, 0.0]), (103, [nan, 0.0, 0.0]), (104, [0.0, -inf, 0.0]), (None, [-0.0, 0.0, -1e-30])]
    check(spark, vectors(30, 3) + odd)


def test_large_entries_stay_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1, 1]) * 2.0 ** rng.randint(0, 11), rng.random(), float(rng.randint(-5, 5))]) for k in range(200)]
    check(spark, rows, "double")


def test_scatter_of_any_longs():
    rng = random.Random(1)
    y = np.array([[rng.getrandbits(64), rng.getrandbits(40), 0, rng.getrandbits(3)] for _ in range(130)], np.uint64)
    found = W.Scatter(np.array([64, 40, 0, 3]))
    found.add(y[:64])
    found.add(y[64:])
    for i in range(4):
        for j in range(i, 4):
            total = sum(int(found.sums[g, i, j]) << (g * W.WEIGHT_BITS) for g in range(found.parts))
            assert total == sum(int(a[i]) * int(a[j]) for a in y)


def test_no_variance_and_no_rows(spark):
    one = W.whitening_report(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    assert W.whitening_report(table(spark, [])).collect() == []
    line = W.whitening_report(table(spark, [(k, [float(k), 0.0]) for k in range(5)])).collect()  # one dimension of two
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    assert {round(r.explained, 9) for r in line} == {1.0, 0.0}


def test_lengths_are_fitted_separately(spark):
    a, b = vectors(40, 3, 1), [(1000 + i, v) for i, v in vectors(60, 6, 2)]
    both = {(r.vec_id, r.component): r for r in W.whitening_report(table(spark, a + b)).collect()}
    for rows in (a, b):
        for r in W.whitening_report(table(spark, rows)).collect():
            other = both[r.vec_id, r.component]
            assert (r.n, r.deviation) == (other.n, other.deviation) and r.whitened == pytest.approx(other.whitened)


def test_a_deviation_beyond_long_is_null():
    model = W.Model(1 << 22, [0, 0], np.ones(2), np.eye(2), 2.0)
    off = W.deviations(np.array([[1 << 12, 3], [1, 1]], np.int64), model)
    assert off.mask.tolist() == [True, False] and off.data[1] == 2 << 44
