"""Out-of-fold logistic regression and states by silhouette, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.operators import classify


def plain_logistic(x, y, c=1.0):
    """Newton's method with step halving on all rows at once; balanced classes."""
    z = np.column_stack([x, np.ones(len(x))])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty, w = np.append(np.ones(x.shape[1]), 0.0), np.zeros(z.shape[1])

    def loss(w):
        t = z @ w
        return c * (s * (np.logaddexp(0, t) - y * t)).sum() + (penalty * w * w).sum() / 2

    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        g = c * z.T @ (s * (p - y)) + penalty * w
        step = np.linalg.solve(c * z.T @ (z * (s * p * (1 - p))[:, None]) + np.diag(penalty), g)
        while loss(w - step) > loss(w) + 1e-12:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-11:
            break
    return w


def area(y, p):
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b))


@pytest.mark.parametrize("apart", [0.7, 30.0])
def test_out_of_fold_logistic(spark, apart):
    rng = np.random.default_rng(1)
    n = 400
    y = (rng.random(n) < 0.2).astype(int)
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 7, 3] + np.outer(y, [apart, 10 * apart, 0.0])
    fold = rng.integers(0, 4, n)
    missing = rng.random(n) < 0.1
    rows = [(i, int(y[i]), int(fold[i]), float(x[i, 0]), float(x[i, 1]), None if missing[i] else float(x[i, 2]), 5.0, "e") for i in range(n)]
    rows += [(-1, None, 1, 0.0, 0.0, 0.0, 5.0, "e"), (-2, 1, None, 0.0, 0.0, 0.0, 5.0, "e")]
    own = spark.createDataFrame(rows, "id long, label int, fold int, a double, b double, c double, flat double, extra string").repartition(5)
    x[missing, 2] = 0
    fit, scored = classify.out_of_fold(own, ["a", "b", "c", "flat"])
    assert fit.features == ["a", "b", "c"] and fit.settled.all() and scored.columns == [*own.columns, "p"]
    got = {r.id: r.p for r in scored.collect()}
    want = np.empty(n)
    for i, k in enumerate(fit.folds):
        use = fold != k
        mean, sd = x[use].mean(axis=0), x[use].std(axis=0)
        w = plain_logistic((x[use] - mean) / sd, y[use])
        assert np.allclose(fit.weights[i], w, atol=1e-6)
        want[~use] = 1 / (1 + np.exp(-(np.column_stack([(x[~use] - mean) / sd, np.ones((~use).sum())]) @ w)))
    assert set(got) == set(range(n)) and all(got[i] == pytest.approx(want[i], abs=1e-8) for i in range(n))
    table = {r.fold: r for r in classify.logistic_auc(own, ["a", "b", "c", "flat"]).collect()}
    assert table[None].auc == pytest.approx(area(y, want), abs=1e-9) and table[None].n_features == 3 and table[None].settled
    assert all(table[k].auc == pytest.approx(area(y[fold == k], want[fold == k]), abs=1e-9) for k in fit.folds)


def test_logistic_without_features_or_classes(spark):
    own = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0)], "label int, fold int, a double")
    assert {r.auc for r in classify.logistic_auc(own, ["a"]).collect()} == {0.5}
    one = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 1, 3.0)], "label int, fold int, a double")
    fit, scored = classify.out_of_fold(one, ["a"])
    assert not fit.settled.any() and scored.filter("p is not null").count() == 0
    fit, scored = classify.out_of_fold(one.limit(0), ["a"])
    assert fit.folds == [] and scored.count() == 0


def plain_silhouette(x, at):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        own = (at == at[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, at == k].mean() for k in set(at.tolist()) - {at[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_states_by_silhouette(spark):
    rng = np.random.default_rng(2)
    centers = np.array([[0, 0], [8, 100], [0, 220]])
    x = np.concatenate([c + rng.normal(size=(n, 2)) * [1, 10] for c, n in zip(centers, (120, 60, 40), strict=True)])
    rows = [(i, float(a), float(b), 1.0) for i, (a, b) in enumerate(x)] + [(999, None, 1.0, 1.0)]
    own = spark.createDataFrame(rows, "id long, a double, b double, flat double").repartition(4)
    found = classify.operating_states(own, ["a", "b", "flat"], F.col("id"))
    again = classify.operating_states(own.repartition(3), ["a", "b", "flat"], F.col("id"))
    assert found.k == 3 and np.allclose(found.centers, again.centers)
    got = {r.id: r.state for r in own.withColumn("state", found.state()).collect()}
    assert got.pop(999) is None
    at = np.array([got[i] for i in range(len(x))])
    assert len({(a, b) for a, b in zip(np.repeat([0, 1, 2], [120, 60, 40]).tolist(), at.tolist(), strict=True)}) == 3
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    score = {k: s for k, _, s in found.table}
    assert score[3] == pytest.approx(plain_silhouette(z, at), abs=1e-9) and max(score.values()) == score[3]
    cost = sum(((z[at == k] - z[at == k].mean(axis=0)) ** 2).sum() for k in range(3))
    assert {k: c for k, c, _ in found.table}[3] == pytest.approx(cost, abs=1e-6)
    table = {r.k: r.chosen for r in classify.state_table(found, own).collect()}
    assert table == {2: False, 3: True, 4: False}


def test_states_of_few_rows(spark):
    same = spark.createDataFrame([(i, 1.0) for i in range(10)], "id long, a double")
    with pytest.raises(ValueError):
        classify.operating_states(same, ["a"], F.col("id"))
    with pytest.raises(ValueError):
        classify.operating_states(same.limit(0), ["a"], F.col("id"))
    four = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "id long, a double")
    found = classify.operating_states(four, ["a"], F.col("id"))
    assert found.k == 4 and found.table[-1][1] == pytest.approx(0) and found.table[-1][2] == pytest.approx(1)
