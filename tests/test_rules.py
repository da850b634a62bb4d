"""Rule scores, variants, replays and conformal levels on hand-made rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gapwise.operators import rules


def test_rule_scores_by_hand(spark):
    rng = np.random.default_rng(0)
    n = 120
    current = np.where(np.arange(n) % 2, 10.0, 1.0) + rng.normal(size=n) * 0.1
    level, corr, cum, share = rng.uniform(1, 2, n), rng.uniform(-1, 1, n), rng.uniform(-1, 1, n), rng.uniform(0.5, 3, n)
    corr[7] = share[8] = cum[9] = np.nan
    rows = [(1, i, 0, int(i >= 100), *(None if np.isnan(x) else float(x) for x in (level[i], current[i], corr[i], cum[i], share[i]))) for i in range(n)]
    own = spark.createDataFrame(rows, "src long, seg_id long, pos long, label int, rms0 double, rms1 double, corr_win double, corr_cum double, rms_ratio double")
    got = {r.seg_id: r for r in rules.rule_scores(own, F.col("label") == 0).collect()}
    train = np.arange(n) < 100
    state = (current > 5).astype(int)
    assert [got[i].state for i in range(n)] == state.tolist()
    thr = [np.quantile(level[train & (state == s)], 0.99) for s in (0, 1)]
    rel = level / np.array(thr)[state]

    def z(x):
        out = np.zeros(n)
        for s in (0, 1):
            v = x[train & (state == s)]
            v = v[~np.isnan(v)]
            q1, q3 = np.percentile(v, [25, 75])
            out[state == s] = (np.where(np.isnan(x), np.median(v), x)[state == s] - np.median(v)) / ((q3 - q1) / 1.349)
        return out

    want = {
        "rms": level, "rms_state": rel, "rms_state_dir": rel * (1 - np.nan_to_num(corr)), "rms_state_ratio": rel * np.where(np.isnan(share), np.nanmedian(share[train]), share),
        "rms_state_dirz": rel * (1 + np.maximum(0, -z(corr))), "rms_state_ratioz": rel * (1 + np.maximum(0, z(share))), "rms_state_dirz_cum": rel * (1 + np.maximum(0, -z(cum))),
    }
    for name, x in want.items():
        assert np.allclose([got[i][name] for i in range(n)], x), name
    table = {r.rule: r for r in rules.rule_table(rules.rule_scores(own, F.col("label") == 0), F.col("label") == 0, F.lit(True), 0.9).collect()}
    assert set(table) == set(rules.RULES) and all(r.n_out_seg == 20 and r.fpr_sample == pytest.approx(0.1, abs=0.011) for r in table.values())


def test_variants(spark):
    own = spark.createDataFrame([(1, s, i, 20, float(10 * s + i)) for s in (0, 1, 2) for i in range(20)], "src long, seg_id long, pos long, n long, a double")
    for name, want in (("offline_mean", 5 - 9.5), ("fixed_baseline", 10 + 5 - 14.5), ("first_difference", 1.0)):
        made = rules.variant(own, name, ["a"], F.col("seg_id") < 2)
        assert made.columns == own.columns and made.filter("seg_id = 1 and pos = 5").first().a == pytest.approx(want)
    assert rules.variant(own, "first_difference", ["a"]).filter("pos = 0 and a != 0").count() == 0
    for args in (("fixed_baseline", ["a"]), ("other", ["a"])):
        with pytest.raises(ValueError):
            rules.variant(own, *args)


def test_replay_needs_known_starts(spark):
    scores = spark.createDataFrame([(1, 0, 5, 0, 0, 0.5, 2.0, 1), (1, 1, 0, 1, 4, 1.5, 2.0, None), (1, 1, 0, 1, 3, 1.5, 2.0, None), (1, 0, 0, 0, 2, 1.2, 0.3, 0)], "src long, seg_id long, t long, label int, fold int, z1 double, z2 double, state int")
    starts = spark.createDataFrame([(1, 0, 100.0, 1), (1, 1, 200.0, 0)], "src long, seg_id long, s double, state int").withColumn("start", F.timestamp_seconds("s"))
    rows = {(r.view, r.seg_id, r.t): r for r in rules.replay(scores, starts, "z1", "z2", 4, 10.0).collect()}
    assert set(rows) == {("normal", 0, 5), ("normal", 0, 0), ("outlier", 1, 0)}
    assert rows["normal", 0, 5].relative_sec == 50 and rows["outlier", 1, 0].stage == "alarm" and rows["normal", 0, 0].stage == "caution" and rows["outlier", 1, 0].state == 0
    for broken in (starts.filter("seg_id = 0"), starts.union(starts)):
        with pytest.raises(PySparkException):
            rules.replay(scores, broken, "z1", "z2", 4, 10.0).collect()


def test_conformal_tables(spark):
    rng = np.random.default_rng(1)
    cal = spark.createDataFrame([("a", float(x)) for x in rng.normal(size=30)] + [("b", float(x)) for x in rng.normal(size=5)], "g string, score double")
    test = spark.createDataFrame([(g, float(x), int(i % 4 == 0)) for g in "ab" for i, x in enumerate(rng.normal(size=40) + 1)], "g string, score double, label int")
    got = {round(r.alpha, 3): r for r in rules.operating_levels(test, cal, "g", (0.1, 0.2)).collect()}
    scores = {g: np.sort([r.score for r in cal.collect() if r.g == g]) for g in "ab"}
    for a, r in got.items():
        n_false = n_normal = n_out = n_hit = n_cal = 0
        for g, c in scores.items():
            k = int(np.floor((len(c) + 1) * a + 1e-9))
            if not k:
                continue
            n_cal += len(c)
            for x in test.collect():
                if x.g == g:
                    hit = (1 + (c >= x.score).sum()) / (len(c) + 1) <= a + 1e-12
                    n_false, n_normal, n_out, n_hit = n_false + (hit and not x.label), n_normal + (not x.label), n_out + x.label, n_hit + (hit and x.label)
        assert (r.n_false, r.n_normal, r.n_out, r.n_detected, r.n_cal) == (n_false, n_normal, n_out, n_hit, n_cal) and r.n_attainable == (1 if a == 0.1 else 2)


def test_calibration_study_keeps_its_level(spark):
    """Exchangeable scores: the mean rate of random draws is near each level; drifting ones: that of the latest is not."""
    rng = np.random.default_rng(2)
    rows = [(g, g, i, float(x)) for g in range(2) for i, x in enumerate(rng.normal(size=400))]
    own = spark.createDataFrame(rows, "g int, src long, seg_id long, score double")
    table = {(r.alpha, r.rule): r for r in rules.calibration_study(own, "g", 0.25, (0.1,), range(8)).collect()}
    assert table[0.1, "random"].n_reps == 8 and table[0.1, "random"].rate_mean == pytest.approx(0.1, abs=0.03) and table[0.1, "latest"].n_reps == 1
    again = {(r.alpha, r.rule): r for r in rules.calibration_study(own.repartition(5), "g", 0.25, (0.1,), range(8)).collect()}
    assert again == table
    drift = own.withColumn("score", F.col("score") + F.col("seg_id") * 0.05)
    moved = {r.rule: r for r in rules.calibration_study(drift, "g", 0.25, (0.1,), range(4)).collect()}
    assert moved["latest"].rate_max < 0.02 < moved["random"].rate_min


def test_rolled_up(spark):
    own = spark.createDataFrame([("m", 0, "x", 1.0), ("m", 0, "y", 3.0), ("m", 1, "x", 8.0), ("k", None, "x", 5.0)], "model string, split int, fold string, v double")
    got = {(r.model, r.split, r.fold): (r.n, r.v) for r in rules.rolled_up(own, ["model", "split", "fold"], ["v"]).collect()}
    assert got["m", "0", "all"] == (2, 2.0) and got["m", "all", "all"] == (3, 4.0) and got["m", "0", "y"] == (1, 3.0) and got["k", None, "x"] == (1, 5.0) and got["k", None, "all"] == (1, 5.0) and len(got) == 9
