"""Sine fits against planted sines and plain numpy, two-level cuts against all cuts, seeded splits."""

import math

import numpy as np
from pyspark.sql import functions as F

from gapwise.operators import periodic

SCHEMA = "src long, seg_id long, pos long, t double, x double, extra string"


def frame(spark, series):
    rows = [(1, s, i, float(t), None if v is None else float(v), "e") for s, (ts, xs) in enumerate(series) for i, (t, v) in enumerate(zip(ts, xs))]
    return spark.createDataFrame(rows, SCHEMA)


def plain(t, x, freqs):
    """Least squares left by any of the frequencies, one lstsq each."""
    left = []
    for f in freqs:
        d = np.column_stack([np.sin(2 * np.pi * f * t), np.cos(2 * np.pi * f * t), np.ones_like(t)])
        left.append(((x - d @ np.linalg.lstsq(d, x, rcond=None)[0]) ** 2).sum())
    return np.array(left)


def test_planted_sines_are_found(spark):
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 30, 200))
    planted = [(0.6, 2.0, 0.4, 100.0), (1.37, 0.5, -2.0, -3.0)]
    series = [(t - t[0], a * np.sin(2 * np.pi * f * (t - t[0]) + p) + c) for f, a, p, c in planted]
    got = {r.seg_id: r for r in periodic.sine_fit(frame(spark, series), "x", F.col("t")).collect()}
    for s, (f, a, p, c) in enumerate(planted):
        assert abs(got[s].freq - f) < 1e-3 and abs(got[s].amp - a) < 0.02 and abs(got[s].offset - c) < 0.02
        assert abs(math.remainder(got[s].phase - p, 2 * math.pi)) < 0.1 and got[s].r2 > 0.99


def test_fit_is_the_best_of_the_grid_and_residuals_follow(spark):
    rng = np.random.default_rng(1)
    series = []
    for n in (5, 12, 60, 5000):
        t = np.cumsum(rng.exponential(0.3, n))
        series.append((t, rng.normal(50, 10, n)))
    own = frame(spark, series)
    fits = periodic.sine_fit(own, "x", F.col("t"))
    got = {r.seg_id: r for r in fits.collect()}
    for s, (t, x) in enumerate(series[:3]):
        best = plain(t - t[0], x, np.geomspace(0.01, 5.0, 500)).min()
        assert got[s].resid_rms ** 2 * len(x) <= best * (1 + 1e-6) + 1e-9
        assert abs(got[s].resid_rms ** 2 * len(x) - plain(t - t[0], x, [got[s].freq])[0]) < 1e-6
    left = periodic.sine_residuals(own, fits, "x", F.col("t"))
    assert left.columns == own.columns + ["residual"] and left.count() == own.count()
    rms = {r.seg_id: r.rms for r in left.groupBy("seg_id").agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("rms")).collect()}
    assert all(abs(rms[s] - got[s].resid_rms) < 1e-6 for s in got)
    off = periodic.sine_features(fits, 0.6).filter("seg_id = 2").first()
    assert abs(off.freq_off - abs(got[2].freq - 0.6)) < 1e-12


def test_short_flat_null_and_empty_segments(spark):
    series = [([0, 1, 2], [1, 2, 3]), (range(9), [4.0] * 9), (range(9), [None] * 9), (range(9), [None, 1, 5, 2, None, 7, 3, 8, 1])]
    own = frame(spark, series)
    fits = periodic.sine_fit(own, "x", F.col("t"))
    got = {r.seg_id: r for r in fits.collect()}
    assert [got[s].n for s in range(4)] == [3, 9, 0, 7]
    assert all(got[s].freq is None and got[s].r2 is None for s in range(3)) and got[3].freq is not None
    left = periodic.sine_residuals(own, fits, "x", F.col("t"))
    assert left.filter("seg_id < 3 AND residual IS NOT NULL").count() == 0 and left.filter("seg_id = 3 AND residual IS NOT NULL").count() == 7
    rms = left.filter("seg_id = 3").agg(F.sqrt(F.avg(F.col("residual") ** 2))).first()[0]
    assert abs(rms - got[3].resid_rms) < 1e-6
    assert periodic.sine_fit(own.filter("false"), "x", F.col("t")).count() == 0


def test_two_levels_against_all_cuts(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(0, 1, 60).round(2).tolist() + rng.normal(9, 2, 25).round(2).tolist() + [None], "b": [5.0, 5.0, 5.0], "c": [0.0, 1.0, 2.0], "d": [None]}
    own = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r.g: r for r in periodic.two_levels(own, "v", ("g",)).collect()}
    assert got.keys() == {"a", "c"} and (got["c"].n_low, got["c"].boundary) == (1, 0.75)
    x = np.sort([v for v in values["a"] if v is not None])
    cuts = [i for i in range(1, len(x)) if x[i] > x[i - 1]]
    best = min(cuts, key=lambda i: x[:i].var() * i + x[i:].var() * (len(x) - i))
    assert got["a"].n_low == best and abs(got["a"].boundary - (x[:best].mean() + x[best:].mean()) / 2) < 1e-9


def test_random_split_is_exact_and_repeats(spark):
    keys = spark.range(1001).select((F.col("id") % 7).alias("src"), "id")
    runs = [sorted((r.src, r.id) for r in periodic.random_split(k, 0.3, 7).filter("is_first").collect()) for k in (keys, keys.repartition(9))]
    assert runs[0] == runs[1] and len(runs[0]) == 300
    other = {(r.src, r.id) for r in periodic.random_split(keys, 0.3, 8).filter("is_first").collect()}
    assert other != set(runs[0]) and periodic.random_split(keys.filter("false"), 0.3, 7).count() == 0
