"""Steps that grew faster than their input, or held a whole group in a task, and results that hung on the last bit."""

import datetime as dt
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gapwise import plans
from gapwise.operators import features, models, pairs, periodic, reports
from gapwise.operators.order import quantiles
from gapwise.operators.segments import gap_segments

T0 = dt.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def stream(spark, seconds):
    rows = [(1, i, T0 + dt.timedelta(seconds=t), float(t)) for i, t in enumerate(seconds)]
    return spark.createDataFrame(rows, "src long, event_id long, ts timestamp, ch0 double")


#: A frame from near a row to the end of its group, which Spark reads anew for every row.
TO_THE_END = re.compile(r"RowFrame, (?!unboundedpreceding)[^)]*\)?, unboundedfollowing", re.I)


def test_no_frame_is_read_anew_for_each_row(spark):
    own = gap_segments(stream(spark, [0, 1, 2, 50, 51, 200, 201, 202]), 5.0, 100.0)
    assert not TO_THE_END.search(plan(own))
    assert [(r.seg_id, r.pos, r.n) for r in own.orderBy("event_id").collect()] == [(0, 0, 3), (0, 1, 3), (0, 2, 3), (1, 0, 2), (1, 1, 2), (2, 0, 3), (2, 1, 3), (2, 2, 3)]
    holes = own.withColumn("x", F.when(F.col("event_id") % 3 != 1, F.col("ch0")))
    filled = features.filled(holes, "x")
    assert not TO_THE_END.search(plan(filled))
    assert [r.filled for r in filled.orderBy("event_id").collect()] == [0, 1, 2, 50, 50, 200, 201, 201]


def test_transforms_of_zero_and_of_halves_are_those_of_the_sql(spark, tmp_path):
    times = [0, 0.5, 2_227_037.63665, 2_220_869.41925, 1_390_162.00445, 7.00005]
    rows = [(i, T0 + dt.timedelta(microseconds=round(t * 1e6)), 1, "error", v, f'{{"k": {k}}}') for i, (t, v, k) in enumerate(zip(times, [0.0, 1.0, 250.5, 0.0, 99.0, 3.0], [3, -1, 0, 95, 7, 1]))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = plans.QUERIES["scalar_transforms"](spark, str(tmp_path)).orderBy("event_id").select("event_id", "norm", "ln0", "log1p1", "load", "since").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT event_id, norm, ln0, log1p1, load, since FROM ({plans.SQL['scalar_transforms']}) ORDER BY event_id").fetchall()
    assert [tuple(r) for r in got] == want and want[0][2] == float("-inf")


def test_short_streams_are_solved_side_by_side(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(t), float(x)) for s in range(40) for t, x in zip(rng.integers(0, 9, s % 7 + 1), rng.normal(0, 1, s % 7 + 1).round(2))]
    own = spark.createDataFrame(rows, "src long, t long, x double")
    made = pairs.theil_sen(own, "src", "t", "x")
    assert "FlatMapGroupsInPandas" not in plan(made)
    got = {r.src: r.slope for r in made.collect()}
    for s in range(40):
        slopes = [(b - a) / (u - t) for _, t, a in filter(lambda r: r[0] == s, rows) for _, u, b in filter(lambda r: r[0] == s, rows) if u > t]
        assert got[s] is None if not slopes else abs(got[s] - np.median(slopes)) < 1e-12
    t, x = np.sort(rng.normal(0, 1, 800)), rng.normal(0, 1, 800)  # more pairs than are made at once
    assert abs(pairs.median_slopes(t, x, np.array([0]))[0] - np.median([(x[j] - x[i]) / (t[j] - t[i]) for i in range(800) for j in range(i + 1, 800)])) < 1e-9


def test_cells_of_many_streams_are_counted_in_a_batch(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(t), float(x)) for s in range(25) for t, x in zip(rng.integers(0, 12, s + 1), rng.integers(0, 6, s + 1))]
    made = pairs.signed_pairs(spark.createDataFrame(rows, "src long, t long, x double"), ["src"], 4)
    assert "FlatMapGroupsInPandas" not in plan(made)
    got = {r.src: (r.n, r.n_pairs, r.s) for r in made.collect()}
    for s in range(25):
        own = [r[1:] for r in rows if r[0] == s]
        signs = [np.sign(b - a) for t, a in own for u, b in own if u > t]
        assert got[s] == (len(own), len(signs), sum(signs))


def test_sines_of_many_segments_are_fitted_side_by_side_in_as_many_tasks_as_are_set(spark):
    rng = np.random.default_rng(3)
    rows = [(s, 0, i, float(t), float(x)) for s in range(30) for i, (t, x) in enumerate(zip(np.sort(rng.uniform(0, rng.uniform(0.1, 8), s % 6 + 4)), rng.gamma(2, 30, s % 6 + 4)))]
    fits = periodic.sine_fit(spark.createDataFrame(rows, "src long, seg_id long, pos long, t double, x double"), "x", F.col("t"))
    assert "FlatMapGroupsInPandas" not in plan(fits)
    assert fits.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = np.geomspace(0.01, 5, 500)
    for r in fits.collect():
        own = np.array([q[3:] for q in rows if q[0] == r.src])
        assert r.n == len(own) and (r.freq is None) == (len(own) < 5)
        if r.freq is not None:
            t, x = own[:, 0] - own[0, 0], own[:, 1] - own[:, 1].mean()
            design = [np.column_stack([np.sin(2 * np.pi * f * t), np.cos(2 * np.pi * f * t), np.ones_like(t)]) for f in grid]
            left = [((x - d @ (np.linalg.pinv(d.T @ d, rcond=1e-9, hermitian=True) @ (d.T @ x))) ** 2).sum() for d in design]
            assert r.resid_rms <= 1.01 * np.sqrt(min(left) / len(t)) + 1e-6  # the finer steps may just miss the best coarse one


def test_quantiles_of_a_few_large_groups_take_no_group_to_one_task(spark):
    own = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 1009).cast("double").alias("v"))
    made = quantiles(own.unionByName(spark.createDataFrame([(None, 5.0)], "g long, v double")), "v", [0.1, 0.99], ["g"])
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString() and "rightHint=(strategy=broadcast)" in plan(made)
    got = {r.g: (r.q0, r.q1) for r in made.collect()}
    for g in range(3):
        x = [float(i * 37 % 1009) for i in range(4000) if i % 3 == g]
        assert np.allclose(got[g], np.quantile(x, [0.1, 0.99]), atol=1e-9)
    assert len(got) == 3


def test_points_of_streams_are_kept_twice_only_and_cells_need_no_place_in_the_stream(spark, monkeypatch):
    made, kept = type(spark.range(1)).checkpoint, []
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a, **k: kept.append(1) or made(self, *a, **k))
    rng = np.random.default_rng(4)
    rows = [(s, int(t), float(x)) for s in range(6) for t, x in zip(rng.integers(0, 40, 30 * s + 1), rng.integers(-5, 5, 30 * s + 1))] + [(9, 1, 2.0)] * 50
    got = {r.src: (r.n, r.n_pairs, r.s) for r in pairs.signed_pairs(spark.createDataFrame(rows, "src long, t long, x double"), ["src"], 8).collect()}
    assert len(kept) <= 2  # places in the whole stream took four
    for s in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == s]
        signs = [np.sign(b - a) for t, a in own for u, b in own if u > t]
        assert got[s] == (len(own), len(signs), sum(signs))


def test_windows_of_all_lengths_are_made_in_one_pass_and_samples_are_not_broadcast(spark):
    own = gap_segments(stream(spark, [*range(14), *range(100, 107), *range(200, 225)]).withColumn("ch1", F.col("ch0") * 2), 5.0, 100.0)
    made = features.window_features(own, (4, 8, 20), 2)
    physical = made._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan(made) and "BroadcastHashJoin" not in physical and "SortMergeJoin" in physical
    want = {(s, p, w) for s, n in ((0, 14), (1, 7), (2, 25)) for w in (4, 8, 20) for p in range(0, n, 2) if p + w <= n}
    rows = made.collect()
    assert {(r.seg_id, r.pos, r.win) for r in rows} == want and len(rows) == len(want)
    assert all(abs(r.p2p0 - (r.win - 1)) < 1e-9 and abs(r.corr_win - 1) < 1e-9 and abs(r.rms_ratio - 0.5) < 1e-9 for r in rows)


def test_rows_are_not_repeated_for_each_resample(spark):
    rng = np.random.default_rng(5)
    rows = [(s, g, int((s + g) % 3 == 0), float(x), float(rng.normal())) for s in range(12) for g in range(3) for x in rng.integers(0, 4, 9)]
    frame = spark.createDataFrame([*rows, (None, 1, 1, 0.0, 0.0), (1, 0, 0, None, 0.5)], "src long, seg_id long, label int, score double, score2 double")
    made = reports.resampled_auc(frame.repartition(3), ["score", "score2"], 20, 7)
    assert "Join" not in plan(made) and "Generate explode" not in plan(reports.bootstrap_auc(frame, 20, 7))
    times = {(r.rep, r.src, r.seg_id): r.times for r in reports.poisson_draws(frame.select("src", "seg_id").distinct(), 20, 7).collect()}
    got = {r.rep: (r.score, r.score2) for r in made.collect()}
    for rep in range(20):
        w, y, x = (np.array(z, float) for z in zip(*((times.get((rep, s, g), 0), label, (a, b)) for s, g, label, a, b in rows)))
        for i in range(2):
            pos, neg = x[y == 1, i][:, None], x[y == 0, i][None, :]
            weight = w[y == 1][:, None] * w[y == 0][None, :]
            if i == 1:  # the row without a score has one of the other kind
                extra = times.get((rep, 1, 0), 0)
                neg, weight = np.append(neg, [[0.5]], axis=1), np.append(weight, w[y == 1][:, None] * extra, axis=1)
            assert abs(got[rep][i] - (weight * ((pos > neg) + 0.5 * (pos == neg))).sum() / weight.sum()) < 1e-12


def test_paths_of_rows_alike_but_for_one_column_are_looked_up(spark, monkeypatch):
    rng = np.random.default_rng(6)
    nodes: list = [[], [], [], [], []]
    for _ in range(40):  # full trees of depth 4
        first = len(nodes[0])
        nodes[4].append(first)
        for i in range(31):
            leaf = i >= 15
            for k, v in enumerate((0 if leaf else rng.integers(3), np.inf if leaf else rng.uniform(0, 6), first + i if leaf else first + 2 * i + 1, rng.uniform(1, 5) if leaf else 0.0)):
                nodes[k].append(v)
    table = [np.array(z, k) for z, k in zip(nodes, (np.int32, float, np.int32, float, np.int32))]
    x = np.stack([rng.integers(0, 3, 5000).astype(float), rng.uniform(-1, 7, 5000), rng.integers(0, 4, 5000).astype(float)])
    x[1, ::50], x[2, ::70] = np.nan, np.nan
    want, asked = models.path_lengths(x, *table, 4), []
    walk = models.path_lengths
    monkeypatch.setattr(models, "path_lengths", lambda y, *a: asked.append(y.shape[1]) or walk(y, *a))
    for often, most in ((64, 1 << 21), (64, 400), (1 << 30, 1 << 21)):
        paths, asked[:] = models.PathSteps(*table, 4, often, most), []
        assert np.allclose(np.concatenate([paths(x[:, i : i + 500]) for i in range(0, 5000, 500)]), want, atol=1e-9)
        assert (sum(asked) < 2500) == (most > 400 and often < 5000)
    assert np.allclose(models.PathSteps(*table, 4)(rng.normal(0, 3, (3, 300)))[:0], [])
