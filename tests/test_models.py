"""Windows as vectors, rebuilt segments, validated joins, pair counts, drift and normality, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gapwise.operators import drift, features, joins, order, pairs, periodic, rebuild, stats, warning, window_models
from gapwise.operators.segments import gap_segments

SCHEMA = "src long, seg_id long, pos long, n long, t double, a double, b double"


def frame(spark, many):
    rows = [(1, s, i, len(t), float(t[i]), None if a[i] is None else float(a[i]), float(b[i])) for s, (t, a, b) in enumerate(many) for i in range(len(t))]
    return spark.createDataFrame(rows, SCHEMA)


def test_window_pca_is_that_of_the_stacked_windows(spark):
    rng = np.random.default_rng(0)
    many = []
    for n in (30, 12, 5, 40, 33):
        t = np.arange(n)
        many.append((t, np.sin(t / 3) * 5 + rng.normal(size=n), 100 + np.cos(t / 3) * 50 + rng.normal(size=n) * 9))
    own = frame(spark, many)
    fit = window_models.fit_windows(own, ["a", "b"], 6, 2, 3, F.col("seg_id") != 4)
    windows = {(s, p): np.stack([np.asarray(c[p : p + 6], float) for c in (a, b)]) for s, (t, a, b) in enumerate(many) for p in range(0, len(t) - 5, 2)}
    train = np.array([x for (s, _), x in windows.items() if s != 4])
    sd = train.transpose(1, 0, 2).reshape(2, -1).std(axis=1) + 1e-9
    scaled = (train / sd[:, None]).reshape(len(train), -1)
    mean = scaled.mean(axis=0)
    _, values, v = np.linalg.svd(scaled - mean, full_matrices=False)
    left = lambda x: (x - mean) - (x - mean) @ v[:3].T @ v[:3]
    sigma = left(scaled).reshape(-1, 2, 6).transpose(1, 0, 2).reshape(2, -1).std(axis=1) + 1e-6
    assert np.allclose(fit.sigma, sigma) and np.allclose(fit.explained[:3], (values**2 / (values**2).sum())[:3])
    rows = window_models.window_errors(own, fit, 2).collect()
    assert {(r.seg_id, r.pos) for r in rows} == set(windows)
    for r in rows:
        e = ((left((windows[r.seg_id, r.pos] / sd[:, None]).ravel()).reshape(2, 6) / sigma[:, None]) ** 2).mean(axis=1)
        assert (r.e_a, r.e_b, r.score) == pytest.approx((e[0], e[1], e.mean()), rel=1e-6)


def test_window_pca_of_odd_rows(spark):
    t = np.arange(12)
    own = frame(spark, [(t, [None if i == 3 else i for i in t], t * 1.0)])
    fit = window_models.fit_windows(own, ["a", "b"], 6, 1, 2, F.lit(True))
    rows = {r.pos: r.score for r in window_models.window_errors(own, fit, 1).collect()}
    assert set(rows) == set(range(7)) and all((rows[p] is None) == (p <= 3) for p in rows)
    none = window_models.fit_windows(own.limit(0), ["a"], 3, 1, 1, F.lit(True))
    assert np.isnan(none.components).all() and all(r.score is None for r in window_models.window_errors(own, none, 1).collect())


def test_held_out_segments(spark):
    rng = np.random.default_rng(3)
    many, start = [], 0.0
    for n in (20, 15, 4, 18, 20, 25):
        t = start + np.arange(n) * 0.5
        many.append((t, 2 * np.sin(2 * math.pi * 0.21 * t + 0.3) + len(many) + rng.normal(size=n) * 0.01, t))
        start = t[-1] + 3
    own = frame(spark, many)
    got = {(r.seg_id, r.method): r for r in rebuild.held_out(own, "a", F.col("t"), ["zero", "linear", "sine"]).collect()}
    assert {s for s, _ in got} == {4}  # the third is too short, as a middle and as a neighbour
    (ta, a, _), (tb, b, _), (tc, c, _) = many[3], many[4], many[5]
    y = b - b.mean()
    line = a[-1] + (c[0] - a[-1]) * (tb - ta[-1]) / (tc[0] - ta[-1])
    for method, guess in (("zero", 0 * tb), ("linear", line)):
        r = got[4, method]
        assert (r.span, r.gap, r.n, r.sse, r.sst) == pytest.approx((tc[0] - ta[-1], tb[0] - ta[-1], 20, ((y - guess + guess.mean()) ** 2).sum(), (y * y).sum()))
    assert 1 - got[4, "sine"].sse / got[4, "sine"].sst > 0.95
    table = {r.method: r for r in rebuild.by_span(rebuild.held_out(own, "a", F.col("t"), ["zero", "sine"]), (0, 5, 100)).collect()}
    assert table["zero"].r2 == pytest.approx(0) and table["sine"].span_from == 5.0 and table["sine"].n_segments == 1
    assert rebuild.held_out(own.limit(0), "a", F.col("t")).count() == 0
    with pytest.raises(ValueError):
        rebuild.held_out(own, "a", F.col("t"), ["cubic"])


def test_joint_sine_is_least_squares():
    rng = np.random.default_rng(5)
    t, part = np.sort(rng.uniform(0, 30, 60)), np.repeat([0, 1], 30)
    x = np.sin(2 * math.pi * 0.4 * t + 1) * 3 + np.where(part == 0, 10, -20) + rng.normal(size=60) * 0.1
    f, a, b = rebuild.joint_sine(t, x, part, 0.01, 5.0)
    d = np.column_stack([np.sin(2 * math.pi * f * t), np.cos(2 * math.pi * f * t), part == 0, part == 1])
    coef = np.linalg.lstsq(d, x, rcond=None)[0]
    assert abs(f - 0.4) < 2e-3 and np.allclose([a, b], coef[:2], atol=1e-6)


def test_phase_goes_on_or_not(spark):
    t1, t2 = np.arange(0, 20, 0.2), np.arange(23, 43, 0.2)
    many = [(t1, 2 * np.sin(2 * math.pi * 0.3 * t1 + 0.5), t1), (t2, 2 * np.sin(2 * math.pi * 0.3 * t2 + 0.5 + 0.7) + 9, t2)]
    own = frame(spark, many)
    r = rebuild.phase_steps(own, periodic.sine_fit(own, "a", F.col("t")), "a", F.col("t")).collect()
    assert len(r) == 1 and r[0].gap == pytest.approx(23 - t1[-1]) and r[0].phase_error == pytest.approx(0.7, abs=0.1)
    assert 0.3 < r[0].r2_forward < 0.6  # 1 - 2 (1 - cos 0.7), about


def test_masked_runs_of_all_methods(spark):
    t = np.arange(40) * 0.25
    own = frame(spark, [(t, np.sin(2 * math.pi * 0.5 * t) * 4 + 1, t), (t[:12], np.cos(t[:12]), t[:12])])
    got = {r.method: r for r in rebuild.masked_runs(own, ["a"], [6, 50], rebuild.METHODS, F.col("t")).collect()}
    assert set(got) == set(rebuild.METHODS) and {(r.n, r.n_segments, r.k) for r in got.values()} == {(6, 1, 6)}
    assert got["sine"].r2 > 0.9 and got["zero"].r2 < 0.3 and got["linear"].r2 < got["sine"].r2 and got["sine"].nrmse == pytest.approx(math.sqrt(1 - got["sine"].r2))


def test_validated_joins_fail_on_double_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, x string")
    right = spark.createDataFrame([(1, 10), (2, 20), (None, 5), (None, 6)], "k long, y long")
    twice = right.union(spark.createDataFrame([(2, 21)], "k long, y long"))
    assert {(r.k, r.x, r.y) for r in joins.joined(left, right, ["k"]).collect()} == {(1, "a", 10), (1, "b", 10), (2, "c", 20), (None, "d", None)}
    assert joins.joined(left, right, ["k"], "inner").count() == 3
    assert joins.joined(right, left, ["k"], "left", "one_to_many").count() == 5
    for args, told in (((left, twice, ["k"]), "right"), ((left, right, ["k"], "left", "one_to_one"), "left"), ((twice, left, ["k"], "inner", "one_to_many"), "left")):
        with pytest.raises(PySparkException, match=f"{told}: repeated key"):
            joins.joined(*args).collect()
    with pytest.raises(ValueError):
        joins.joined(left, right.withColumn("X", F.lit(1)), ["k"])
    with pytest.raises(ValueError):
        joins.joined(left, right, ["k"], validate="many_to_many")


def points(rng, n, ties):
    t = rng.integers(0, n // 2 + 1, n).astype(float) if ties else rng.permutation(n) * 0.5
    return t, rng.integers(0, 5, n).astype(float) if ties else rng.normal(size=n) + t * 0.3


@pytest.mark.parametrize("cell", [4, 16, 1 << 17])
def test_signed_pairs_are_those_of_all_pairs(spark, cell):
    rng = np.random.default_rng(cell)
    rows, want = [], {}
    for s, (n, ties) in enumerate([(1, False), (2, True), (37, False), (50, True), (33, True)]):
        t, x = points(rng, n, ties)
        rows += [(s, float(a), float(b)) for a, b in zip(t, x, strict=True)]
        later = t[:, None] < t[None]
        want[s] = (n, int(later.sum()), int(np.sign(x[None] - x[:, None])[later].sum()))
    rows += [(0, None, 1.0), (0, 1.0, None)]
    own = spark.createDataFrame(rows, "src long, t double, x double").repartition(3)
    assert {r.src: (r.n, r.n_pairs, r.s) for r in pairs.signed_pairs(own, ["src"], cell).collect()} == want


@pytest.mark.parametrize("cell", [16, 1 << 17])
def test_median_slopes(spark, cell):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for s, (n, ties) in enumerate([(1, False), (7, False), (24, True)]):
        t, x = points(rng, n, ties)
        rows += [(s, float(a), float(b)) for a, b in zip(t, x, strict=True)]
        slopes = [(x[j] - x[i]) / (t[j] - t[i]) for i in range(n) for j in range(n) if t[i] < t[j]]
        want[s] = np.median(slopes) if slopes else None
    own = spark.createDataFrame(rows, "src long, t double, x double")
    got = {r.src: r.slope for r in pairs.theil_sen(own, "src", "t", "x", cell, guesses=511).collect()}
    assert set(got) == set(want) and all(got[s] is None if want[s] is None else got[s] == pytest.approx(want[s], abs=1e-9) for s in want)


def test_a_long_stream_ends(spark):
    """No pairs: 120,000 points have 7 billion of them."""
    own = spark.range(120_000).select(F.lit(1).alias("src"), F.col("id").alias("t"), (F.col("id") * 0.001 + F.pmod(F.xxhash64("id"), F.lit(1000))).alias("v"))
    r = pairs.mann_kendall(own, "src", "t", "v", 1 << 14).first()
    assert r.n == 120_000 and 0 < r.s < 120_000**2 / 2 and r.z > 3


def test_one_stream_spans_tasks(spark):
    rng = np.random.default_rng(8)
    at = np.cumsum(rng.choice([1.0, 2.0, 50.0], 3000, p=[0.6, 0.38, 0.02]))
    own = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(at)], "src long, event_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    for part in (None, 10.0, 100.0, 2000.0, 1e7):
        rows = gap_segments(own, 5.0, part).orderBy("event_id").collect()
        new = np.concatenate([[False], np.diff(at) > 5])
        seg = np.cumsum(new)
        sizes = np.bincount(seg)
        assert [r.seg_id for r in rows] == seg.tolist() and [r.n for r in rows] == sizes[seg].tolist()
        assert [r.pos for r in rows] == (np.arange(3000) - (np.cumsum(sizes) - sizes)[seg]).tolist()
        assert rows[0].dt is None and np.allclose([r.dt for r in rows[1:]], np.diff(at))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows would fit one task
    try:
        assert gap_segments(own, 5.0, 100.0).withColumn("_p", F.spark_partition_id()).select("_p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_gather_a_bounded_share(spark):
    """With six in ten values equal, what is gathered stays small, and quantiles are exact."""
    own = spark.range(200_000).select(F.when(F.col("id") % 10 < 6, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 7.0 + 1).alias("x"), (F.col("id") % 3).alias("g"))
    probe = own.select(F.col("x").alias("_x")).crossJoin(own.agg(F.percentile_approx("x", [0.3, 0.3, 0.99, 0.99], order.BRACKET).alias("_e")))
    sizes = probe.agg(order._around(0).alias("a"), order._around(1).alias("b")).select(F.size("a.inside"), F.size("b.inside")).first()
    assert max(sizes) < 200
    kept = own.collect()
    values, groups = np.array([r.x for r in kept]), np.array([r.g for r in kept])
    qs = [0.0, 0.1, 0.59, 0.6, 0.61, 0.95, 0.99, 1.0]
    got = order.quantiles(own, "x", qs).first()
    assert np.allclose(list(got), np.quantile(values, qs), rtol=1e-12)
    by = {r.g: r for r in order.quantiles(own, "x", [0.5, 0.9], ["g"], ["m", "h"]).collect()}
    assert all(np.allclose([by[k].m, by[k].h], np.quantile(values[groups == k], [0.5, 0.9])) for k in range(3))


def test_running_min_and_benjamini_hochberg(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(300) ** 3, 3)
    own = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(999, None)], "i long, p double").repartition(5)
    got = {r.i: r.q for r in stats.benjamini_hochberg(own).collect()}
    at = np.argsort(p)
    q = np.minimum.accumulate((p[at] * 300 / np.arange(1, 301))[::-1])[::-1]
    want = dict(zip(at.tolist(), np.minimum(q, 1), strict=True))
    assert got.pop(999) is None and all(got[i] == pytest.approx(want[i]) for i in want) and stats.benjamini_hochberg(own).columns == ["i", "p", "q"]


def test_block_drift(spark):
    rng = np.random.default_rng(6)
    block = rng.integers(0, 4, 600)
    v = np.round(rng.normal(size=600) * (1 + block) + block * 0.2, 1)
    own = spark.createDataFrame([(int(b), float(x)) for b, x in zip(block, v, strict=True)] + [(1, None), (9, 5.0)], "block int, v double").repartition(4)
    for r in drift.drift_p_values(drift.block_drift(own, "v", "block", [0, 1, 2, 3])).collect():
        a, b = v[block < r.block], v[block == r.block]
        every = np.unique(v)
        ks = np.abs(np.searchsorted(np.sort(a), every, "right") / len(a) - np.searchsorted(np.sort(b), every, "right") / len(b)).max()
        za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
        mean = np.concatenate([za, zb]).mean()
        w = (len(a) + len(b) - 2) * (len(a) * (za.mean() - mean) ** 2 + len(b) * (zb.mean() - mean) ** 2) / (((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum())
        assert (r.n_ref, r.n_blk, r.median_ref, r.median_blk) == (len(a), len(b), np.median(a), np.median(b))
        assert r.ks == pytest.approx(ks) and r.levene == pytest.approx(w) and 0 < r.ks_p <= 1 and 0 <= r.levene_p <= 1
    flat = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0), (2, 3.0)], "block int, v double")
    rows = {r.block: r for r in drift.drift_p_values(drift.block_drift(flat, "v", "block", [0, 1, 2])).collect()}
    assert rows[1].ks == 0 and rows[1].levene is None and rows[1].ks_p == 1 and rows[2].ks is None and rows[2].ks_p is None
    assert abs(drift.f_tail(4.0, 1, 30) - 0.0546250) < 1e-6 and abs(drift.kolmogorov_tail(1.0) - 0.26999967) < 1e-7


#: Examples with W and p from the literature: Shapiro and Wilk's weights of men (1965), and Royston's algorithm on evenly spaced normal scores.
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def test_shapiro_wilk(spark):
    rng = np.random.default_rng(4)
    groups = {"men": WEIGHTS, "flat": [2.0] * 9, "two": [1.0, 2.0], "three": [1.0, 2.0, 4.0], "five": [1.0, 2.0, 2.0, 3.0, 9.0], "skew": rng.exponential(size=400).tolist(), "normal": rng.normal(size=6000).tolist()}
    own = spark.createDataFrame([(g, i, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)] + [("men", 99, None)], "g string, i long, x double")
    got = {r.g: r for r in drift.shapiro_wilk(own, "x", ["i"], ["g"]).collect()}
    assert got["men"].w == pytest.approx(0.79, abs=5e-3) and got["men"].p == pytest.approx(0.0067, abs=5e-4)
    assert got["flat"].w is None and got["two"].w is None and got["two"].p is None
    assert got["three"].w == pytest.approx(0.9642857, abs=1e-6) and got["three"].p == pytest.approx(0.6368831, abs=1e-4)
    assert got["skew"].p < 1e-10 and got["normal"].n == 5000 and got["normal"].w > 0.998 and got["normal"].p > 0.01
    again = {r.g: r.w for r in drift.shapiro_wilk(own.repartition(7), "x", ["i"], ["g"]).collect()}
    assert again["normal"] == pytest.approx(got["normal"].w, abs=1e-12)
    with pytest.raises(ValueError):
        drift.shapiro_wilk(own, "x", ["i"], most=6000)


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.025, 0.2, 0.5, 0.9, 0.975]
    got = [r.z for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").select("i", drift.normal_quantile(F.col("p")).alias("z")).orderBy("i").collect()]
    assert got[4] == 0 and got[2] == pytest.approx(-1.959963984540054) and got[6] == pytest.approx(1.959963984540054)
    assert all(math.erfc(-z / math.sqrt(2)) / 2 == pytest.approx(p, rel=1e-9) for z, p in zip(got, ps, strict=True))


def test_loadings_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 3)) @ np.array([[1, 0.9, 0.1], [0, 0.3, 0], [0, 0, 1]]) * [1, 40, 0.2] + 5
    own = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    rows, needed = stats.loadings_ranking(own, ["a", "b", "c"])
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    share = values[::-1] / values.sum()
    for k, explained, cumulative, feature, loading, rank in rows:
        v = vectors[:, ::-1][:, k - 1]
        i = "abc".index(feature)
        assert explained == pytest.approx(share[k - 1]) and cumulative == pytest.approx(share[:k].sum()) and abs(loading) == pytest.approx(abs(v[i]), abs=1e-9)
        assert rank == 1 + sum(abs(v[j]) > abs(v[i]) + 1e-12 for j in range(3))
    assert needed[0.95] == int(np.searchsorted(np.cumsum(share), 0.95) + 1)


def test_transform_effect_where_logs_are_undefined(spark):
    own = spark.createDataFrame([(float(i), -2.0 if i == 3 else float(i), 1.0) for i in range(8)] + [(None, None, None)], "a double, b double, c double")
    got = {(r.feature, r.transform): r for r in stats.transform_effect(own, ["a", "b", "c"]).collect()}
    assert len(got) == 6 and got["a", "none"].skew == pytest.approx(0) and got["a", "none"].kurt == pytest.approx(-1.2)
    assert got["b", "log1p"].mean is None and got["b", "none"].mean is not None and got["c", "none"].skew is None and got["c", "log1p"].mean == pytest.approx(math.log(2))


def test_trend_and_gain(spark):
    own = spark.createDataFrame([(s, i, float(i if s else 0)) for s in (0, 1) for i in range(30)], "src long, seg_id long, x double")
    for lam in (0.2, 0.001):
        got = {(r.src, r.seg_id): r for r in warning.trend_alerts(own, "x", F.col("src") == 0, lam).collect()}
        s = 0.0
        for i in range(30):
            s = lam * i + (1 - lam) * s
            assert got[1, i].trend == pytest.approx(s, abs=1e-12) and got[1, i].alert == (s > 0) and not got[0, i].alert
    leads = spark.createDataFrame([(1, "a", 5.0), (1, "b", 8.0), (2, "a", 4.0), (2, "b", 4.0), (3, "a", 1.0), (3, "b", None), (4, "b", 2.0)], "src long, rule string, lead double")
    r = warning.paired_gain(leads, ["src"], "rule", "a", "b").first()
    assert (r.n_both, r.n_only_first, r.n_only_second, r.mean_gain, r.median_gain, r.share_gain) == (2, 1, 1, 1.5, 1.5, 0.5)


def test_duplicate_columns_and_resolution(spark):
    own = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (1, 0.5, 0.5, None), (1, 2.0, 2.0 + 1e-12, 3.0), (2, 7.0, 7.0, 7.0)], "src long, a double, b double, c double")
    got = {(r.a, r.b): (r.most, r.same) for r in stats.duplicate_columns(own, ["a", "b", "c"]).collect()}
    assert got["a", "b"][1] and not got["a", "c"][1] and got["a", "c"][0] == 1.0 and len(got) == 3
    bits = {r.src: (r.range, r.step, r.bits) for r in features.resolution(own, "a").collect()}
    assert bits == {1: (2.0, 0.5, 3), 2: (0.0, None, None)}
    assert stats.duplicate_columns(own.limit(0), ["a", "b"]).first().same is None
