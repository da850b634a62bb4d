"""Order statistics, running sums and one-pass fits against numpy on tables with ties and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.operators import models, order


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), None if rng.random() < 0.05 else float(np.round(rng.normal() * 10 ** int(g), 1)), int(rng.random() < 0.4)) for g in rng.integers(0, 4, 3000)]
    rows += [(9, 5.0, 1), (8, None, 0), (7, 1.0, 1), (7, 2.0, 0)]
    return spark.createDataFrame(rows, "g int, x double, y int"), rows


def test_quantiles(table):
    frame, rows = table
    qs = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    got = {r.g: tuple(r)[1:] for r in order.quantiles(frame, "x", qs, ["g"]).collect()}
    want = {g: np.quantile([r[1] for r in rows if r[0] == g and r[1] is not None], qs) for g in {r[0] for r in rows if r[1] is not None}}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g].tolist()) for g in want)
    assert tuple(order.quantiles(frame, "x", [0.3], names=["t"]).first()) == pytest.approx((np.quantile([r[1] for r in rows if r[1] is not None], 0.3),))
    assert [tuple(r) for r in order.quantiles(frame.filter("false"), "x", [0.5], ["g"]).collect()] == []


def test_cumulative_and_counts(table):
    frame, rows = table
    for by in ([], ["g"]):
        got = order.ranked_counts(frame, "x", by, descending=True, more={"pos": F.sum("y")}).collect()
        for r in got[:: max(1, len(got) // 60)]:
            own = [z for z in rows if z[1] is not None and (not by or z[0] == r.g)]
            assert (r.before, r.n, r.total) == (sum(z[1] > r.x for z in own), sum(z[1] == r.x for z in own), len(own))
            assert (r.before_pos, r.pos) == (sum(z[2] for z in own if z[1] > r.x), sum(z[2] for z in own if z[1] == r.x))


@pytest.fixture(scope="module")
def segments(spark):
    rng = np.random.default_rng(1)
    rows = []
    for src in range(6):
        for seg in range(5):
            x, y = 0.0, 0.0
            for pos in range(int(rng.integers(1, 40))):
                x, y = 0.8 * x + 0.3 * y + rng.normal(), 0.5 * y - 0.2 * x + rng.normal() + 1
                rows.append((src, seg, pos, float(x), float(y)))
    return spark.createDataFrame(rows, "src long, seg_id long, pos long, a double, b double").repartition(5), rows


def lagged(rows, p, keep):
    at = {(r[0], r[1], r[2]): r[3:] for r in rows}
    own = [r for r in rows if r[2] >= p and keep(r)]
    x = np.array([[v for i in range(1, p + 1) for v in at[r[0], r[1], r[2] - i]] for r in own])
    return x, np.array([r[3:] for r in own])


def test_ridge_from_moments(segments):
    frame, rows = segments
    info, out = models.ridge_var(frame, ["a", "b"], 3, F.col("src") != 5, F.col("src") == 4)

    def fit(x, y, alpha):
        m, n = x.mean(axis=0), y.mean(axis=0)
        w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - n))
        return w, n - m @ w

    one, two, both = (lagged(rows, 3, k) for k in (lambda r: r[0] < 4, lambda r: r[0] == 4, lambda r: r[0] < 5))
    loss = {}
    for alpha in models.ALPHAS:
        w, c = fit(*one, alpha)
        loss[alpha] = ((two[1] - two[0] @ w - c) ** 2).mean(axis=0).sum()
    assert info["loss"] == pytest.approx(loss) and info["alpha"] == min(loss, key=loss.get)
    w, c = fit(*both, info["alpha"])
    sd = np.sqrt(((both[1] - both[0] @ w - c) ** 2).mean(axis=0))
    x, y = lagged(rows, 3, lambda r: True)
    want = (((y - x @ w - c) / sd) ** 2).mean(axis=1)
    got = {(r.src, r.seg_id, r.pos): r.score for r in out.collect()}
    assert len(got) == len(rows) and all(v is None for k, v in got.items() if k[2] < 3)
    assert [got[r[:3]] for r in rows if r[2] >= 3] == pytest.approx(want.tolist())


def test_kalman_filter(segments):
    frame, rows = segments
    fit = models.kalman_fit(frame, ["a", "b"], F.col("src") != 5)
    x, y = lagged(rows, 1, lambda r: r[0] != 5)
    full = np.column_stack([x, np.ones(len(x))])
    w = np.linalg.lstsq(full, y, rcond=None)[0]
    e = y - full @ w
    assert fit["a"] == pytest.approx(w[:2].T, abs=1e-6) and fit["q"] == pytest.approx(e.T @ e / len(e), rel=1e-4) and fit["r"] == pytest.approx(0.1 * np.diag(np.diag(fit["q"])))
    got = {(r.src, r.seg_id, r.pos): r.score for r in models.kalman_scores(frame, ["a", "b"], fit).collect()}
    assert len(got) == len(rows)
    state = cov = None
    for r in rows:
        z = np.array(r[3:])
        if r[2] == 0:
            state, cov = z, fit["r"]
            assert got[r[:3]] is None
            continue
        state, cov = fit["a"] @ state + fit["c"], fit["a"] @ cov @ fit["a"].T + fit["q"]
        s = cov + fit["r"]
        e = z - state
        assert got[r[:3]] == pytest.approx(e @ np.linalg.solve(s, e) / 2)
        gain = cov @ np.linalg.inv(s)
        state, cov = state + gain @ e, cov - gain @ cov


def test_mcd_stays_with_the_bulk(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3)) @ np.diag([1, 5, 20])
    x[:200] += 500
    frame = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    fit, out = models.robust_mcd(frame, F.lit(True), ["a", "b", "c"])
    assert np.abs(fit["center"] / [1, 5, 20]).max() < 0.2 and fit["log_det"] == sorted(fit["log_det"], reverse=True)
    assert out.filter("a > 100").agg(F.min("score")).first()[0] > out.filter("a < 100").agg(F.max("score")).first()[0]


def test_forest_isolates_what_is_far(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(1500, 2)))] + [(9000, 9.0, 9.0), (9001, -8.0, 9.0)]
    out = models.isolation_forest(spark.createDataFrame(rows, "i long, a double, b double"), F.col("i") < 9000, ["a", "b"], trees=60, keys=["i"]).orderBy(F.desc("score")).limit(2)
    assert {r.i for r in out.collect()} == {9000, 9001}


def test_injected_noise_is_normal_and_agrees_with_itself(spark):
    frame = spark.range(20_000).select(F.lit(1).alias("src"), F.lit(0).alias("seg_id"), F.col("id").alias("pos"), F.lit(0.0).alias("a"), F.lit(2.0).alias("b"))
    one = {r.pos: r.a_injected for r in models.injected(frame, "noise", 3.0, "a", "b").collect()}
    assert one == {r.pos: r.a_injected for r in models.injected(frame.repartition(7), "noise", 3.0, "a", "b").collect()}
    x = np.array(list(one.values()))
    assert abs(x.mean()) < 0.1 and abs(x.std() - 3) < 0.1
    spikes = models.injected(frame, "spike", 5.0, "a", "b").agg(F.avg(F.col("a_injected") / 5)).first()[0]
    assert abs(spikes - 0.05) < 0.01 and models.injected(frame, "current", 0.5, "a", "b").filter("a_injected = 1").count() == 20_000


def test_bootstrap_against_numpy(spark):
    """The same draws, worked out row by row."""
    from gapwise.operators import reports

    rng = np.random.default_rng(2)
    rows = [(s, g, t, int(s % 3 == 0), float(np.round(rng.normal() + (s % 3 == 0), 1)), float(np.round(rng.normal(), 1))) for s in range(12) for g in range(3) for t in range(int(rng.integers(1, 6)))]
    frame = spark.createDataFrame(rows, "src long, seg_id long, t long, label int, score double, score2 double")
    times = {(r.rep, r.src, r.seg_id): r.times for r in reports.poisson_draws(frame.select("src", "seg_id").distinct(), 60, 5).collect()}
    assert abs(sum(times.values()) / (60 * 36) - 1) < 0.1

    def area(rep, k):
        own = [(r[k], r[3]) for r in rows for _ in range(times.get((rep, r[0], r[1]), 0))]
        p, m = [x for x, y in own if y], [x for x, y in own if not y]
        return np.mean([(x > y) + (x == y) / 2 for x in p for y in m]) if p and m else None

    one = [a for i in range(60) if (a := area(i, 4)) is not None]
    both = [a - b for i in range(60) if (a := area(i, 4)) is not None and (b := area(i, 5)) is not None]
    for got, want in ((reports.bootstrap_auc(frame, 60, 5).first(), one), (reports.bootstrap_auc(frame, 60, 5, "score", "score2").first(), both)):
        assert (got["mean"], got.lo, got.hi) == pytest.approx((np.mean(want), np.quantile(want, 0.025), np.quantile(want, 0.975)))
        assert got.p == pytest.approx(min(1.0, 2 * min(np.mean(np.array(want) <= 0), np.mean(np.array(want) >= 0))))


def test_bootstrap_of_a_rate(spark):
    from gapwise.operators import reports, stats

    rows = [(s, g, float(s + g)) for s in range(10) for g in range(4)]
    frame = spark.createDataFrame(rows, "src long, seg_id long, x double")
    got = {r.rep: r["mean"] for r in stats.bootstrap(frame, F.col("x"), 40, 7).collect()}
    sums = {}
    for r in reports.poisson_draws(frame, 40, 7).collect():
        k, v = sums.get(r.rep, (0, 0.0))
        sums[r.rep] = (k + r.times, v + r.times * r.x)
    assert got == pytest.approx({i: v / k for i, (k, v) in sums.items()}) and len(got) == 40
