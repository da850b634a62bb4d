"""Splines and recursive filters along segments, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.operators import series

SCHEMA = "src long, seg_id long, pos long, t double, x double, extra string"


def frame(spark, many):
    rows = [(1 + s % 2, s, i, None if t is None else float(t), None if v is None else float(v), "e") for s, (ts, xs) in enumerate(many) for i, (t, v) in enumerate(zip(ts, xs, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def dense_spline(t, y, ends, at):
    """Piecewise cubics by one dense system of their 4 (n - 1) coefficients."""
    n = len(t)
    if n == 1:
        return np.full(len(at), y[0])
    if n == 2:
        return y[0] + (y[1] - y[0]) * (at - t[0]) / (t[1] - t[0])
    if n == 3 and ends == "not-a-knot":
        return np.polyval(np.polyfit(t, y, 2), at)
    m, rows, right = n - 1, [], []

    def row(i, order, u):
        """Derivative of piece i at u from its left knot."""
        out = np.zeros(4 * m)
        c = [[1, u, u * u, u**3], [0, 1, 2 * u, 3 * u * u], [0, 0, 2, 6 * u], [0, 0, 0, 6]][order]
        out[4 * i : 4 * i + 4] = c
        return out

    h = np.diff(t)
    for i in range(m):
        rows += [row(i, 0, 0.0), row(i, 0, h[i])]
        right += [y[i], y[i + 1]]
    for i in range(m - 1):
        for k in (1, 2):
            rows.append(row(i, k, h[i]) - row(i + 1, k, 0.0))
            right.append(0.0)
    if ends == "natural":
        rows += [row(0, 2, 0.0), row(m - 1, 2, h[-1])]
    else:
        rows += [row(0, 3, 0.0) - row(1, 3, 0.0), row(m - 2, 3, 0.0) - row(m - 1, 3, 0.0)]
    coef = np.linalg.solve(np.array(rows), np.array(right + [0.0, 0.0])).reshape(m, 4)
    i = np.clip(np.searchsorted(t, at, "right") - 1, 0, m - 1)
    u = at - t[i]
    return coef[i, 0] + u * (coef[i, 1] + u * (coef[i, 2] + u * coef[i, 3]))


@pytest.mark.parametrize("ends", ["not-a-knot", "natural"])
def test_cubic_fill_is_a_dense_solve(spark, ends):
    rng = np.random.default_rng(4)
    many = []
    for n in (1, 2, 3, 4, 5, 6, 9, 40, 300):
        t = np.cumsum(rng.uniform(0.2, 2.0, n))
        x = [None if rng.random() < 0.35 else v for v in rng.normal(0, 3, n)]
        many.append((t, x))
    many += [([0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1.0, None, 3.0, 2.0, None, None, 5.0]), ([0.0, 1.0], [None, None]), ([0.0, 1.0, 1.0, 2.0, 3.0], [0.0, 1.0, 9.0, None, 3.0])]
    own = frame(spark, many)
    out = series.cubic_filled(own, "x", F.col("t"), ends)
    assert out.columns == [*own.columns, "filled"] and out.count() == own.count()
    got = {(r.seg_id, r.pos): r.filled for r in out.collect()}
    for s, (t, x) in enumerate(many):
        t = np.asarray(t, float)
        known = np.array([v is not None for v in x])
        known[1:] &= ~((np.diff(t) == 0) & known[:-1])
        if not known.any():
            assert all(got[s, i] is None for i in range(len(t)))
            continue
        want = dense_spline(t[known], np.array([v for v, k in zip(x, known, strict=True) if k], float), ends, t)
        for i, v in enumerate(x):
            assert got[s, i] == pytest.approx(want[i] if v is None else v, rel=1e-7, abs=1e-7)


def test_cubic_fill_of_odd_rows(spark):
    own = frame(spark, [([0.0, None, 2.0], [1.0, None, 3.0])])
    assert [r.filled for r in series.cubic_filled(own, "x", F.col("t")).orderBy("pos").collect()] == [1.0, None, 3.0]
    assert series.cubic_filled(own.limit(0), "x").count() == 0
    with pytest.raises(ValueError):
        series.cubic_filled(own, "x", ends="clamped")


def plain(b, a, x, s=None):
    """The recursion, one sample after another."""
    step, into = series.state_space(np.asarray(b), np.asarray(a))
    s = np.zeros(len(into)) if s is None else s
    out = []
    for v in x:
        out.append(s[0] + b[0] * v)
        s = step @ s + into * v
    return np.array(out)


def test_state_space_is_the_difference_equation():
    rng = np.random.default_rng(0)
    b, a = series.butterworth_highpass(0.2, 10.0)
    x, y = rng.normal(size=50), np.zeros(50)
    for i in range(50):
        y[i] = sum(b[j] * x[i - j] for j in range(3) if i >= j) - sum(a[j] * y[i - j] for j in (1, 2) if i >= j)
    assert np.allclose(plain(b, a, x), y)
    assert abs(b.sum()) < 1e-12 and abs((b * [1, -1, 1]).sum() / (a * [1, -1, 1]).sum() - 1) < 1e-9  # nothing of a constant, all of the fastest
    gain = np.polyval(b, np.exp(2j * np.pi * 0.02)) / np.polyval(a, np.exp(2j * np.pi * 0.02))
    assert abs(abs(gain) - np.sqrt(0.5)) < 1e-9  # half the power at the cut
    for n in (0, 1, 63, 64, 65, 200):
        assert np.allclose(series.filtered_from_zero(x.repeat(4)[:n], b[0], *series.state_space(b, a))[0], plain(b, a, x.repeat(4)[:n]))


@pytest.mark.parametrize("part", [1, 7, 64, 4096])
def test_filter_is_a_plain_loop_for_any_parts(spark, part):
    rng = np.random.default_rng(part)
    b, a = series.butterworth_highpass(0.2, 10.0)
    many = [(range(n), rng.normal(50, 5, n)) for n in ((300, 1, 20) if part > 1 else (40, 1))]
    own = frame(spark, many).withColumn("x", F.when((F.col("seg_id") != 0) | (F.col("pos") != 5), F.col("x")))
    forth = {(r.seg_id, r.pos): r.filtered for r in series.recursive_filter(own, "x", b, a, ["src", "seg_id"], "pos", part).collect()}
    back = {(r.seg_id, r.pos): r.filtered for r in series.recursive_filter(own, "x", b, a, ["src", "seg_id"], "pos", part, reverse=True).collect()}
    for s, (_, x) in enumerate(many):
        x = np.array(x)
        if s == 0:
            x[5] = 0
        for got, want in ((forth, plain(b, a, x)), (back, plain(b, a, x[::-1])[::-1])):
            assert all(got[s, i] is None if (s, i) == (0, 5) else got[s, i] == pytest.approx(want[i], abs=1e-9) for i in range(len(x)))


def test_zero_phase(spark):
    rng = np.random.default_rng(9)
    b, a = series.butterworth_highpass(0.5, 10.0)
    step, into = series.state_space(b, a)
    rest = np.linalg.solve(np.eye(2) - step, into)
    many = [(range(n), 20 + rng.normal(0, 5, n)) for n in (60, 10, 9)]
    own = frame(spark, many)
    got = {(r.seg_id, r.pos): r.filtered for r in series.zero_phase_filter(own, "x", b, a, part=16).collect()}
    for s, (_, x) in enumerate(many[:2]):
        longer = np.concatenate([2 * x[0] - x[9:0:-1], x, 2 * x[-1] - x[-2:-11:-1]])
        y = plain(b, a, longer, rest * longer[0])[::-1]
        want = plain(b, a, y, rest * y[0])[::-1][9:-9]
        assert all(got[s, i] == pytest.approx(want[i], abs=1e-9) for i in range(len(x)))
    assert all(got[2, i] is None for i in range(9))
