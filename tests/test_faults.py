"""Faults, comparisons by segment and checks of scores on hand-made rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gapwise.operators import faults


@pytest.fixture(scope="module")
def segments(spark):
    rng = np.random.default_rng(0)
    rows = [(1, s, i, 30, float(a), float(b)) for s in range(12) for i, (a, b) in enumerate(rng.normal(size=(30, 2)) * [5, 20] + [3, -8])]
    return spark.createDataFrame(rows, "src long, seg_id long, pos long, n long, a double, b double")


def test_faults_by_hand(segments):
    x = {(r.seg_id, r.pos): (r.a, r.b) for r in segments.collect()}
    made = faults.faulty(segments, list(faults.EXPECTED), (0.5,), "a", "b")
    assert made.count() == 5 * len(x)
    again = {(r.kind, r.seg_id, r.pos): (r.a, r.b) for r in faults.faulty(segments.repartition(3), list(faults.EXPECTED), (0.5,), "a", "b").collect()}
    a0, b0 = np.array([x[3, i][0] for i in range(30)]), np.array([x[3, i][1] for i in range(30)])
    want = {
        "amplitude": (a0 * 1.5, b0), "antiphase": (a0 * 0.5 - b0 * 0.5, b0), "spike": (a0 + 50.0 * (np.arange(30) % 10 == 5), b0), "current": (a0, b0 * 1.5),
    }
    for kind, (a, b) in want.items():
        got = np.array([again[kind, 3, i] for i in range(30)])
        assert np.allclose(got[:, 0], a - a.mean()) and np.allclose(got[:, 1], b - b.mean()), kind
    noise = np.array([again["noise", 3, i][0] for i in range(30)]) - (a0 - a0.mean())
    assert 20 < noise.std() < 90 and abs(noise.mean()) < 1e-9
    with pytest.raises(ValueError):
        faults.faulty(segments, ["other"], (1.0,), "a", "b")


def test_fault_table_blames_the_channel(segments):
    keys = ["kind", "strength"]
    clean = faults.amplitude_windows(faults.centred(segments, ["a", "b"]), ["a", "b"], 10, 5)
    versions = faults.amplitude_windows(faults.faulty(segments, ["spike", "current"], (0.0, 3.0), "a", "b"), ["a", "b"], 10, 5, keys)
    train, test, bad = F.col("seg_id") < 6, F.col("seg_id").between(6, 9), F.col("seg_id") > 9
    got = {(r.kind, r.strength): r for r in faults.fault_table(clean, versions, train, test, bad, ["a", "b"], 0.9).collect()}
    assert set(got) == {("spike", 0.0), ("spike", 3.0), ("current", 0.0), ("current", 3.0), ("real", None)}
    assert got["spike", 3.0].n == 4 * 5 and got["spike", 3.0].hit_rate == 1 and got["spike", 3.0].median_z1 > 3 > got["spike", 0.0].median_z1
    assert got["current", 3.0].hit_rate == 1 and got["current", 3.0].median_z2 > 2 and got["current", 3.0].n_caution == 20
    assert got["real", None].hit_rate is None and got["real", None].n == 2 * 5 and got["spike", 0.0].median_z1 == pytest.approx(got["current", 0.0].median_z1)


ALARMS = [(1, 0, 0, True, True, None), (1, 1, 0, True, False, True), (1, 2, 0, False, False, False), (1, 3, 1, None, None, None), (1, 4, 1, False, False, False), (1, 5, 1, True, False, None), (1, 6, 1, True, True, True)]


def test_comparisons_with_rules_that_do_not_judge(spark):
    own = spark.createDataFrame(ALARMS, "src long, seg_id long, label int, a boolean, b boolean, c boolean")
    assert {r.category: r.n for r in faults.missed(own, ["a", "b", "c"]).collect()} == {"undetermined": 1, "missed_by_all": 1, "missed_by_some": 1, "found_by_all": 1}
    hours = spark.createDataFrame([(1, 4.0), (2, 6.0)], "src long, hours double")
    r = faults.system_comparison(own, hours, "a", "c").first()
    assert (r.n_common, r.both, r.only_first, r.only_second, r.neither) == (4, 2, 0, 0, 2)
    assert (r.native_first, r.native_second, r.common_first, r.common_second) == (0.4, 0.2, 0.2, 0.2)
    listed = spark.createDataFrame([(1, 1), (1, 1), (9, 9)], "src long, seg_id long")
    got = {x.seg_id: (x.n_votes, x.share, x.suspect) for x in faults.majority_false_positives(own.filter("label = 0"), ["a", "b", "c"], listed).collect()}
    assert got == {0: (2, 1.0, False), 1: (3, pytest.approx(2 / 3), True)}
    assert faults.missed(own.limit(0), ["a"]).count() == 0


def test_offsets_and_attribution(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, 20 if i % 5 else 5, float(rng.normal() * 1e-6 if i < 60 else rng.normal() + 3), 4.0, int(i >= 60)) for i in range(80)]
    own = spark.createDataFrame(rows, "src long, seg_id long, n long, dc double, rms double, label int")
    got = {r.measure: r for r in faults.offset_diagnostics(own).collect()}
    assert all(r.symmetric > 0.95 and r.leak for r in got.values()) and len(got) == 3
    alarms = {r.seg_id: r.alarm for r in faults.offset_alarms(own).collect()}
    assert alarms[0] is None and alarms[61] is True and sum(bool(alarms[i]) for i in range(60)) <= 1
    windows = spark.createDataFrame([(1, 0, 1.0, 5.0), (1, 0, 9.0, 6.0), (1, 0, 2.0, 7.0), (1, 1, 0.1, 0.2), (1, 2, 4.0, 4.0)], "src long, seg_id long, x double, y double")
    r = {x.seg_id: x for x in faults.channel_attribution(windows, ["x", "y"], F.col("y") > 1).collect()}
    assert set(r) == {0, 2} and (r[0].x, r[0].y, r[0].dominant, r[0].n_windows) == (2.0, 6.0, "y", 3) and r[2].dominant == "x"


def test_scores_that_are_not_finite_fail_the_job(spark):
    good = spark.createDataFrame([(1.0,), (-2.5,)], "score double")
    assert faults.finite_scores(good, "score").count() == 2
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(PySparkException, match="isn't finite"):
            faults.finite_scores(good.union(spark.createDataFrame([(bad,)], "score double")), "score").collect()
