"""Hand-made cases of segments, alarms, conformal levels, statistics, models, sources and streams."""

import datetime as dt
import math
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from gapwise import plans
from gapwise.operators import clean, conformal, evaluate, models, segments, stats, warning
from gapwise.sources import io
from gapwise.streaming import scorer

T0 = dt.datetime(2024, 1, 1)


def stream(spark, times, values, src=1):
    rows = [(src, i, T0 + dt.timedelta(seconds=t), float(v)) for i, (t, v) in enumerate(zip(times, values))]
    return spark.createDataFrame(rows, "src long, event_id long, ts timestamp, ch0 double")


def scored(spark, rows):
    return spark.createDataFrame(rows, "src long, seg_id long, t long, score double, label int, thr double")


def test_gap_is_strict(spark):
    out = segments.gap_segments(stream(spark, [0, 0.5, 1.0, 1.6, 1.7], range(5)), 0.5).orderBy("event_id").collect()
    assert [r.seg_id for r in out] == [0, 0, 0, 1, 1]
    assert [r.pos for r in out] == [0, 1, 2, 0, 1] and out[0].dt is None


def test_windows_have_no_tail_and_flat_ones_no_shape(spark):
    seg = segments.gap_segments(stream(spark, [i / 10 for i in range(12)], [0.0] * 12), 0.5)
    out = segments.hop_windows(seg, 10, 5).collect()
    assert [r.pos for r in out] == [0]
    assert out[0].ch0_kurt is None and out[0].ch0_skew is None and out[0].ch0_crest is None and out[0].ch0_rms == 0
    assert segments.hop_windows(segments.gap_segments(stream(spark, [0, 0.1], [1, 2]), 0.5), 10, 5).count() == 0


def test_correlation_is_null_without_spread_or_below_four(spark):
    seg = segments.gap_segments(stream(spark, [i / 10 for i in range(6)], [1.0] * 6), 0.5).withColumn("ch1", F.col("pos").cast("double"))
    assert [r["corr"] for r in segments.relation_windows(seg, 6, 6).collect()] == [None]
    short = seg.filter("pos < 3").withColumn("n", F.lit(3)).withColumn("ch0", F.col("pos") * 2.0)
    assert [r["corr"] for r in segments.relation_windows(short, 3, 3).collect()] == [None]


def test_spectrum_has_all_segments_and_bins(spark, tmp_path):
    rng = np.random.default_rng(0)
    long, short = rng.normal(50, 10, 41).round(2).tolist(), rng.normal(50, 10, 12).round(2).tolist()
    rows = [(1, i, T0 + dt.timedelta(seconds=t), v, "{}", "a") for i, (t, v) in enumerate(zip([*range(41), *range(200_000, 200_012)], long + short))]
    rows.append((1, 99, T0 + dt.timedelta(seconds=500_000), 1.0, "{}", "a"))
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, value double, props string, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.seg_id, r.k): r.amplitude for r in plans.QUERIES["spectrum_full"](spark, str(tmp_path)).collect()}
    want = {}
    for s, x in enumerate([long, short]):
        for k in range(1, len(x) // 2 + 1):
            want[s, k] = 2 / len(x) * abs(sum((v - sum(x) / len(x)) * complex(math.cos(2 * math.pi * k * i / len(x)), math.sin(2 * math.pi * k * i / len(x))) for i, v in enumerate(x)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_offset_methods(spark):
    seg = segments.gap_segments(stream(spark, [i / 10 for i in range(5)], [3, 5, 7, 9, 11]), 0.5)
    for method, want in {"mean": [-4, -2, 0, 2, 4], "expanding": [0, 1, 2, 3, 4], "detrend": [0] * 5}.items():
        got = [r.clean for r in clean.remove_offset(seg, "ch0", method).orderBy("pos").collect()]
        assert np.allclose(got, want, atol=1e-9), method


def test_alarms(spark):
    flags = scored(spark, [(1, 0, i, s, 1, 1.0) for i, s in enumerate([2.0, 0.0, 2.0])] + [(1, 1, 0, 1.0, 0, 1.0)])
    got = {r.seg_id: r for r in evaluate.segment_alarms(flags, "kofn", 2, 3).collect()}
    assert got[0].alarm and got[0].first_t == 2 and abs(got[0].delay - 2.9) < 1e-9
    assert not got[1].alarm  # a score at the threshold
    skipped = {r.seg_id: r for r in evaluate.segment_alarms(flags, skip_first=3).collect()}
    assert skipped[0].n_used == 0 and not skipped[0].alarm and len(skipped) == 2


def test_worked_confusion(spark):
    rows = [(1, True)] * 14 + [(0, True)] * 21 + [(1, False)] * 3 + [(0, False)] * 509
    out = evaluate.confusion(spark.createDataFrame(rows, "label int, alarm boolean")).first()
    assert (out.tp, out.fp, out.fn, out.tn) == (14, 21, 3, 509) and round(out.f1, 4) == 0.5385


def test_auc_of_one_class_is_null(spark):
    assert evaluate.auc(scored(spark, [(1, 0, 0, 1.0, 0, 1.0)])).first().auc is None


def test_operating_point_keeps_the_target(spark):
    rng = np.random.default_rng(1)
    rows = [(1, s, i, float(x), 0, 0.0) for s in range(40) for i, x in enumerate(rng.random(6).round(2))]
    for k, n in ((1, 1), (2, 3)):
        for r in evaluate.operating_point(scored(spark, rows), [0.05, 0.2], k, n).collect():
            own = evaluate.segment_alarms(scored(spark, [(*x[:5], r.thr) for x in rows]), "kofn", k, n)
            assert own.filter("alarm").count() <= r.target * 40
            lower = evaluate.segment_alarms(scored(spark, [(*x[:5], r.thr - 0.011) for x in rows]), "kofn", k, n)
            assert lower.filter("alarm").count() > r.target * 40 or r.thr <= 0.02


def test_conformal_ties_and_attainability(spark):
    cal = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (0, 3.0)], "g int, score double")
    test = spark.createDataFrame([(0, 2.0), (0, 3.5), (0, 0.0)], "g int, score double")
    assert sorted(r.p for r in conformal.p_values(test, cal, "g").collect()) == [0.2, 0.8, 1.0]
    assert conformal.thresholds(cal, "g", 0.1).first().thr == math.inf
    r = conformal.thresholds(cal, "g", 0.4).first()
    assert r.attainable and r.thr == 2.0
    assert [x.score > r.thr for x in test.orderBy("score").collect()] == [x.p <= 0.4 + 1e-12 for x in conformal.p_values(test, cal, "g").orderBy("score").collect()]


def test_episode_rearm(spark):
    rows = [(1, i, float(x)) for i, x in enumerate([1, 0, 0, 1, 0, 0, 0, 1])]
    out = warning.episode_starts(spark.createDataFrame(rows, "src long, i long, z double"), "src", "i", F.col("z") > 0.5)
    assert [r.i for r in out.filter("start").orderBy("i").collect()] == [0, 7]


def test_ewma(spark):
    out = warning.ewma(spark.createDataFrame([(1, i, float(i)) for i in range(300)], "src long, i long, z double"), "src", "i", "z", 0.5, 10.0).orderBy("i").collect()
    s = 10.0
    for r in out:
        s = 0.5 * r.z + 0.5 * s
        assert abs(r.ewma - s) < 1e-9


def test_benjamini_hochberg_keeps_null(spark):
    out = stats.benjamini_hochberg(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")).collect()
    assert {r.p: r.q for r in out} == {0.01: 0.03, 0.03: 0.04, 0.04: 0.04, None: None}


def test_helpers_of_distributions():
    assert abs(stats.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-9
    lo, hi = stats.clopper_pearson(1, 10)
    assert abs(lo - 0.002528579) < 1e-6 and abs(hi - 0.4450161) < 1e-6
    assert abs(stats.fisher_exact(8, 2, 1, 5) - 0.03496503) < 1e-6
    assert abs(stats.normal_tail(1.959964) - 0.05) < 1e-6


def test_correlation_clusters():
    corr = np.array([[1, 0.95, 0.1], [0.95, 1, 0.2], [0.1, 0.2, 1]])
    assert stats.correlation_clusters(corr, ["a", "b", "c"], 0.1) == [("a", ["a", "b"]), ("c", ["c"])] or stats.correlation_clusters(corr, ["a", "b", "c"], 0.1)[0][1] == ["a", "b"]


def test_mcd_is_robust_and_falls(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (360, 2)), rng.normal(12, 0.3, (40, 2))])
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    fit, out = models.robust_mcd(frame, F.lit(True), ["a", "b"])
    assert np.abs(fit["center"]).max() < 0.3 and all(b < a for a, b in zip(fit["log_det"], fit["log_det"][1:]))
    assert out.filter("a > 8").agg(F.min("score")).first()[0] > 50


def test_isolation_forest_finds_a_far_point(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, r)) for r in rng.normal(0, 1, (300, 2))] + [(9.0, 9.0)]
    out = models.isolation_forest(spark.createDataFrame(rows, "a double, b double"), F.lit(True), ["a", "b"]).orderBy(F.desc("score")).first()
    assert out.a == 9.0


def test_isolation_forest_samples_rows_not_values(spark):
    rows = [(i, 5.0 if i % 3 == 0 else i / 100, float(i % 3 == 0)) for i in range(6000)]
    frame = spark.createDataFrame(rows, "id long, a double, b double")
    for keys in (["id"], None):
        own = frame if keys else frame.drop("id").withColumn("_copy", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.lit(0))))
        drawn = models.tree_samples(own, ["a", "b"], keys or ["_copy"], 60, 256, 0).toPandas()
        sizes, share = drawn.groupby("tree").size(), drawn.groupby("tree")["b"].mean()
        assert len(sizes) == 60 and (sizes == 256).all()
        assert abs(share.mean() - 1 / 3) < 0.02 and (share > 0.15).all() and (share < 0.55).all() and share.nunique() > 5
        scores = models.isolation_forest(frame, F.lit(True), ["a", "b"], trees=60, keys=keys).agg(F.countDistinct("score"), F.min("score"), F.max("score")).first()
        assert scores[0] > 50 and scores[2] - scores[1] > 0.1


def test_pca_takes_all_dimensions(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 1, (400, 8)) @ rng.normal(0, 1, (8, 64)) + rng.normal(0, 0.1, (400, 64))).astype("float32")
    label = [i % 5 for i in range(400)]
    x[0, 40] += 9  # not a training row
    spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.spe, r.t2) for r in plans.QUERIES["pca_spe_t2"](spark, str(tmp_path)).collect()}
    train = x[np.array(label) != 0].astype(float)
    z = (x - train.mean(axis=0)) / train.std(axis=0, ddof=1)
    values, v = np.linalg.eigh(np.corrcoef(train.T))
    t = z @ v[:, -4:]
    want = np.column_stack([((z - t @ v[:, -4:].T) ** 2).sum(axis=1), (t * t / values[-4:]).sum(axis=1)])
    assert np.allclose([got[i] for i in range(400)], want, atol=1e-4)


def test_pca_error_of_a_plane_is_zero(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1, (100, 2))
    rows = [(float(a), float(b), float(a + b)) for a, b in z]
    out = models.pca_error(spark.createDataFrame(rows, "a double, b double, c double"), F.lit(True), ["a", "b", "c"], 2)
    assert out.agg(F.max("spe")).first()[0] < 1e-9


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(0, 100).map(lambda x: round(x, 3)), min_size=1, max_size=30))
def test_p_value_counts(spark, values):
    cal = spark.createDataFrame([(0, v) for v in values], "g int, score double")
    test = spark.createDataFrame([(0, 50.0)], "g int, score double")
    assert conformal.p_values(test, cal, "g").first().p == (1 + sum(v >= 50 for v in values)) / (len(values) + 1)


def test_sources_and_sinks(spark, tmp_path):
    text = "row,ts,ch0,ch1,ch2,state\n1,2024-01-01 00:00:00,1.5,2,3,1\n2,2024-01-01 00:00:01,,2,3,0\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("﻿" + text, encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text(text)
    (tmp_path / "in" / "c.csv").write_bytes("이름,값\n".encode("cp949"))
    assert {r.file: r.encoding for r in io.inventory(spark, str(tmp_path / "in")).collect()} == {"a.csv": "utf-8-sig", "b.csv": "utf-8", "c.csv": "cp949"}
    out = io.read_samples(spark, {"x": str(tmp_path / "in" / "b.csv"), "y": str(tmp_path / "in" / "b.csv")})
    assert out.count() == 4 and out.filter("ch0 is null").count() == 2
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.csv", "a\nb\n")
    assert [(r.member, r.line_no, r.line) for r in io.zip_lines(spark, str(tmp_path / "z.zip")).collect()] == [("m.csv", 1, "a"), ("m.csv", 2, "b")]
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as z:
        z.writestr(zipfile.ZipInfo("이름.csv".encode("cp949").decode("cp437")), "a\n")
    data = (tmp_path / "old.zip").read_bytes()
    assert io._archive(data).namelist()[0].endswith(".csv")
    io.write_csv(out.select("src", "ch1"), str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).count() == 4
    io.save_parameters(spark, str(tmp_path / "p"), [("w", [1.0, 2.5])])
    assert io.load_parameters(spark, str(tmp_path / "p")) == {"w": [1.0, 2.5]}
    io.write_features(spark.createDataFrame([(10, 1.0), (20, 2.0)], "win int, x double"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).filter("win = 10").count() == 1
    io.append_log(spark, str(tmp_path / "log"), {"step": "a", "s": 1.0})
    io.append_log(spark, str(tmp_path / "log"), {"step": "b", "s": 2.0})
    assert io.read_with_file(spark, str(tmp_path / "log"), "s double, step string").select("file").distinct().count() == 2
    assert "<td>1.0</td>" in io.html_report({"t": spark.createDataFrame([(1.0,)], "x double")})
    with pytest.raises(ValueError, match="lacks q"):
        io.require_columns(out, ["src", "q"])


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for src in (1, 2):
        t = T0
        for i in range(60):
            t += dt.timedelta(seconds=10 if i in (20, 41) else 0.1)
            rows.append((src, src * 1000 + i, t, float(rng.normal()), float(rng.normal())))
    schema = "src long, event_id long, ts timestamp, ch0 double, ch1 double"
    frame = spark.createDataFrame(rows, schema)
    cut = segments.gap_segments(frame, 0.5)
    params, batch = models.ridge_var(cut, ["ch0", "ch1"], 3, F.lit(True), F.col("src") == 2)
    twin = {r.event_id: r.score for r in scorer.ridge_scores(cut, ["ch0", "ch1"], 3, params["fits"], params["sd"]).collect()}
    assert {r.event_id: r.score for r in batch.collect()} == pytest.approx(twin)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = scorer.stream_scores(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["ch0", "ch1"], 3, params["fits"], params["sd"], 0.5)
    q = live.writeStream.format("memory").queryName("live_scores").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.score for r in spark.table("live_scores").collect()}
    assert set(got) == set(twin)
    for k, v in twin.items():
        assert (v is None) == (got[k] is None) and (v is None or abs(v - got[k]) <= 1e-9 * max(1, abs(v)))
    bursts = scorer.burst_summaries(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "0.5 seconds", "2 seconds", "ch0")
    q = bursts.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("bursts").count() >= 4


def test_small_helpers(spark):
    from gapwise.functions.columns import robust_scale
    from gapwise.operators import splits

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    x = np.column_stack([x, x[:, 0] + 0.5 * rng.normal(size=400)])
    factors, condition = stats.vif(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"])
    inverse = np.linalg.inv(np.corrcoef(x.T))
    assert [factors[c] for c in "abc"] == pytest.approx(np.diag(inverse).tolist()) and condition == pytest.approx(math.sqrt(np.linalg.cond(np.corrcoef(x.T))))
    own = spark.createDataFrame([(s, g, int(g % 3 == 0)) for s in range(5) for g in range(7)], "src long, seg_id long, label int")
    folds = splits.fold_assignment(own, 3, 7).collect()
    for label in (0, 1):
        sizes = np.bincount([r.fold for r in folds if r.label == label])
        assert sizes.max() - sizes.min() <= 1
    assert {tuple(r) for r in folds} == {tuple(r) for r in splits.fold_assignment(own.repartition(5), 3, 7).collect()} != {tuple(r) for r in splits.fold_assignment(own, 3, 8).collect()}
    rows = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 0, 4.0), (1, 0, 1, 9.0), (1, 1, 0, 1.0)], "src long, seg_id long, label int, x double").withColumn("pos", F.col("x").cast("long"))
    assert {r.seg_id: r.label for r in splits.segment_label(rows, F.col("label")).collect()} == {0: 1, 1: 0}
    assert {r.seg_id: [z.x for z in r.samples] for r in segments.segment_arrays(rows, ("x",)).collect()} == {0: [2.0, 4.0, 9.0], 1: [1.0]}
    assert rows.agg(robust_scale(F.col("x"))).first()[0] == pytest.approx((np.quantile([2, 4, 9, 1], 0.75) - np.quantile([2, 4, 9, 1], 0.25)) / 1.349)
    assert spark.range(1).select(evaluate.hourly(F.lit(0.5), F.lit(20), F.lit(4.0))).first()[0] == 2.5


def test_tables_that_are_made_when_missing(spark, tmp_path):
    made, path = [], str(tmp_path / "t")
    make = lambda: made.append(1) or spark.range(3)
    assert not io.is_there(spark, path) and io.materialised(spark, path, make).count() == 3 and io.materialised(spark, path, make).count() == 3 and made == [1]
    (tmp_path / "t" / "_SUCCESS").unlink()  # as if the writer had been lost
    assert io.materialised(spark, path, make).count() == 3 and made == [1, 1]
    assert io.probe(spark, path, "parquet") == {"id": "bigint"}
    io.write_csv(spark.range(2).withColumn("x", F.lit("a")), str(tmp_path / "c"))
    assert io.probe(spark, str(tmp_path / "c")) == {"id": "string", "x": "string"}
    names = {io.job_folder("/b/", *x) for x in (("a", 1), ("a", "1/2"), ("a/1", 2), ("a", "1", "2"), ("a", ""), ("a",))}
    assert len(names) == 6 and io.job_folder("/b", "fit", 3, "é") == "/b/fit/3/%e9%"
