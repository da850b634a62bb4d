"""Logistic regression over folds and k-means states, fitted by sums that every partition makes and one aggregate adds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.storage import written
from gapwise.operators.evaluate import auc


def _matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)


def summed(rows: DataFrame, size: int, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all batches of an array of ``size`` numbers: a row a number and partition is added up, and ``size`` numbers reach the driver."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += add(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "x"])

    got = rows.mapInArrow(one, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["i"]] = r["x"]
    return out


class Logistic:
    """Fits of all folds: mean, scale and coefficients (folds x features) with the intercept last; rounds taken, whether each has settled."""

    def __init__(self, folds: list[int], features: list[str], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, rounds: int, settled: np.ndarray):
        self.folds, self.features, self.mean, self.scale, self.weights, self.rounds, self.settled = folds, features, mean, scale, weights, rounds, settled


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([(x - mean) / scale, np.ones(len(x))])


def logistic_folds(rows: DataFrame, features: Sequence[str], label: str, fold: str, c: float = 1.0, tolerance: float = 1e-9, most_rounds: int = 100) -> tuple[Logistic, DataFrame]:
    """Logistic regressions that leave out one fold each, all fitted in the same passes; and the rows that they were fitted on.

    Features that don't vary over all rows are dropped, nulls count as 0, and each fold's training rows are
    standardised by their own mean and population deviation. Classes weigh alike (rows / (2 * rows of the class)).
    The loss is half the squared coefficients, intercept aside, plus ``c`` times the weighted log losses. A pass adds
    up loss, gradient and Hessian of every fold; where a Newton step makes a loss larger it is halved. A fold has
    settled when no coefficient moves by over ``tolerance``, or a step can't lower its loss. Rows without label or
    fold are left out; a fold whose training rows are of one class has no fit (nan). Folds and features fit the
    driver: folds * features ** 2 numbers reach it in a pass.
    """
    own = rows.filter(F.col(label).isNotNull() & F.col(fold).isNotNull())
    spread = own.agg(*(F.max(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in features), *(F.min(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in features)).first()
    kept = [f for f, hi, lo in zip(features, spread[: len(features)], spread[len(features) :], strict=True) if hi is not None and hi > lo]
    names = [f"_x{i}" for i in range(len(kept))]
    own = own.withColumns({n: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for n, f in zip(names, kept, strict=True)})
    own = written(own.withColumn("_y", F.col(label).cast("double")).withColumn("_fold", F.col(fold).cast("long")))
    k = len(kept)
    sums = own.groupBy("_fold").agg(F.count("*"), F.sum("_y"), *(F.avg(n) for n in names), *(F.var_pop(n) for n in names)).collect()
    folds = sorted(r[0] for r in sums)
    by_fold = {r[0]: r for r in sums}
    mean, scale, balance = np.zeros((len(folds), k)), np.ones((len(folds), k)), np.zeros((len(folds), 2))
    for i, left_out in enumerate(folds):
        parts = [by_fold[f] for f in folds if f != left_out]
        n = np.array([r[1] for r in parts], float)
        if not len(n):
            continue
        m, v = (np.array([r[at : at + k] for r in parts], float).reshape(len(parts), k) for at in (3, 3 + k))
        mean[i] = n @ m / n.sum()
        var = n @ (v + (m - mean[i]) ** 2) / n.sum()
        scale[i] = np.where(var > 0, np.sqrt(var), 1.0)
        positive = sum(r[2] for r in parts)
        if 0 < positive < n.sum():
            balance[i] = n.sum() / (2 * (n.sum() - positive)), n.sum() / (2 * positive)
    able = balance[:, 0] > 0
    size, ids = 1 + (k + 1) + (k + 1) ** 2, np.array(folds)
    fit_rows = own.select("_fold", "_y", *names)

    def sums_at(weights: np.ndarray, open_folds: np.ndarray) -> np.ndarray:
        def add(batch: pa.RecordBatch) -> np.ndarray:
            x, y, f = _matrix(batch, names) if k else np.empty((batch.num_rows, 0)), batch.column("_y").to_numpy(), batch.column("_fold").to_numpy()
            out = np.zeros((len(ids), size))
            for i in np.flatnonzero(open_folds):
                use = f != ids[i]
                z, yi = _design(x[use], mean[i], scale[i]), y[use]
                t = z @ weights[i]
                p, s = 1 / (1 + np.exp(-np.clip(t, -700, 700))), balance[i][yi.astype(int)]
                out[i, 0] = (s * (np.logaddexp(0, t) - yi * t)).sum()
                out[i, 1 : k + 2] = z.T @ (s * (p - yi))
                out[i, k + 2 :] = (z.T @ (z * (s * p * (1 - p))[:, None])).ravel()
            return out.ravel()

        return summed(fit_rows, len(ids) * size, add).reshape(len(ids), size)

    penalty = np.append(np.ones(k), 0.0)
    weights, step = np.zeros((len(folds), k + 1)), np.zeros((len(folds), k + 1))
    best, settled, rounds = np.full(len(folds), np.inf), ~able, 0
    while not settled.all() and rounds < most_rounds:
        rounds += 1
        got = sums_at(weights, ~settled)
        for i in np.flatnonzero(~settled):
            w = weights[i]
            loss = c * got[i, 0] + (penalty * w * w).sum() / 2
            if loss > best[i] + 1e-12 * abs(best[i]):
                step[i] /= 2
                weights[i] = w - step[i]  # back half of the way
                settled[i] = np.abs(step[i]).max() <= tolerance
                continue
            best[i] = loss
            gradient = c * got[i, 1 : k + 2] + penalty * w
            hessian = c * got[i, k + 2 :].reshape(k + 1, k + 1) + np.diag(penalty)
            step[i] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            weights[i] = w + step[i]
            settled[i] = np.abs(step[i]).max() <= tolerance
    weights[~able] = np.nan
    return Logistic(folds, kept, mean, scale, weights, rounds, settled & able), own


def out_of_fold(rows: DataFrame, features: Sequence[str], label: str = "label", fold: str = "fold", **options) -> tuple[Logistic, DataFrame]:
    """The fits, and rows with p: what the fit that left out a row's fold gives for it; null where there is none."""
    fit, own = logistic_folds(rows, features, label, fold, **options)
    names, ids = [f"_x{i}" for i in range(len(fit.features))], F.col("_fold")
    p = F.lit(None).cast("double")
    for i, f in enumerate(fit.folds):
        if np.isfinite(fit.weights[i]).all():
            t = F.lit(float(fit.weights[i, -1]))
            for j, name in enumerate(names):
                t = t + (F.col(name) - float(fit.mean[i, j])) / float(fit.scale[i, j]) * float(fit.weights[i, j])
            p = F.when(ids == f, 1 / (1 + F.exp(-t))).otherwise(p)
    return fit, own.select(*rows.columns, p.alias("p"))


def logistic_auc(rows: DataFrame, features: Sequence[str], label: str = "label", fold: str = "fold", **options) -> DataFrame:
    """fold, auc, n_pos, n_neg, n_features, rounds, settled of out-of-fold predictions; fold null is of all rows together.

    Without a feature that varies all predictions are alike, and each area is 0.5.
    """
    fit, scored = out_of_fold(rows, features, label, fold, **options)
    own = scored.filter("p is not null").select(F.col(fold).cast("long").alias("fold"), F.col(label).alias("label"), F.col("p").alias("score"))
    every = auc(own.withColumn("fold", F.lit(None).cast("long")))
    by_fold = auc(own, ["fold"])
    state = own.sparkSession.createDataFrame([(f, bool(s)) for f, s in zip(fit.folds, fit.settled, strict=True)], "fold long, settled boolean")  # a row a fold
    out = by_fold.join(F.broadcast(state), "fold", "left").select("fold", "auc", "n_pos", "n_neg", "settled")
    out = out.unionByName(every.select(F.lit(None).cast("long").alias("fold"), "auc", "n_pos", "n_neg", F.lit(bool(fit.settled.all())).alias("settled")))
    return out.withColumns({"n_features": F.lit(len(fit.features)), "rounds": F.lit(fit.rounds)})


# Operating states


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of the nearest center."""
    d = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _seeds(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of weighted points, each drawn by weight times squared distance to those drawn before."""
    out = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(out) < k:
        cost = weights * _nearest(points, np.array(out))[1]
        out.append(points[rng.choice(len(points), p=cost / cost.sum() if cost.sum() > 0 else weights / weights.sum())])
    return np.array(out)


def _candidates(rows: DataFrame, names: list[str], key: Column, most: int, passes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Points that lie well apart and how many rows are nearest to each (k-means||): in each pass a row is taken with a chance of ``most`` times its share of the cost."""
    head = rows.orderBy(F.xxhash64(key, F.lit(seed)), *names).select(*names).first()
    found = np.array([head], float)
    k = len(names)
    for i in range(passes):
        cost = summed(rows.select(*names), 1, lambda b, c=found: np.array([_nearest(_matrix(b, names), c)[1].sum()]))[0]
        if cost <= 0:
            break
        u = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(i)), 11) / float(1 << 53)

        def draw(batches: Iterator[pa.RecordBatch], centers=found, cost=cost) -> Iterator[pa.RecordBatch]:
            for b in batches:
                taken = b.column("_u").to_numpy() < most * _nearest(_matrix(b, names), centers)[1] / cost
                yield b.select(names).filter(pa.array(taken))

        got = rows.withColumn("_u", u).select(*names, "_u").mapInArrow(draw, ", ".join(f"{n} double" for n in names)).distinct().collect()  # about ``most`` rows
        if got:
            found = np.unique(np.concatenate([found, np.array(got, float).reshape(len(got), k)]), axis=0)
    weights = summed(rows.select(*names), len(found), lambda b: np.bincount(_nearest(_matrix(b, names), found)[0], minlength=len(found)).astype(float))
    return found, weights


class States:
    """Centers (in standardised columns) of the chosen number of states, ordered by their first column; mean and scale; a table by number."""

    def __init__(self, columns: list[str], mean: np.ndarray, scale: np.ndarray, centers: np.ndarray, table: list[tuple[int, float, float]]):
        self.columns, self.mean, self.scale, self.centers, self.table = columns, mean, scale, centers, table
        self.k = len(centers)

    def state(self) -> Column:
        """The nearest center of a row, null where a column is."""
        x = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)]
        best = F.least(*(F.struct(sum(((a - float(v)) * (a - float(v)) for a, v in zip(x, center, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, center in enumerate(self.centers)))
        known = F.lit(True)
        for c in self.columns:
            known = known & F.col(c).isNotNull()
        return F.when(known, best["i"] if self.k > 1 else F.lit(0))


def operating_states(rows: DataFrame, columns: Sequence[str], key: Column, ks: Sequence[int] = (2, 3, 4), starts: int = 10, seed: int = 0, tolerance: float = 1e-9, most_rounds: int = 300) -> States:
    """k-means of standardised columns for each of ``ks``; the number of the highest silhouette is chosen (of equal ones the lowest).

    Starting centers are drawn from points that a few passes find far apart, ``starts`` sets of each number, and all
    sets take their Lloyd steps in the same passes; the set of least cost stays. The silhouette is that of squared
    distances: a row's mean squared distance to a state's rows follows from the state's number, sum and sum of
    squares, so that no pairs are made. Rows with a null column are left out; a column without spread adds nothing.
    Reruns agree, as draws come from ``key`` and seed. There must be a row, and at least max(ks) distinct ones.
    """
    columns = list(columns)
    own = rows.select(key.alias("_key"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna(subset=columns)
    got = own.agg(F.count("*"), *(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    m = len(columns)
    if not got[0]:
        raise ValueError("no rows to find states in")
    mean, scale = np.array(got[1 : 1 + m], float), np.array(got[1 + m :], float)
    scale[scale == 0] = 1.0
    names = [f"_x{i}" for i in range(m)]
    own = written(own.select("_key", *(((F.col(c) - float(a)) / float(s)).alias(n) for c, n, a, s in zip(columns, names, mean, scale, strict=True))))
    points, weights = _candidates(own, names, F.col("_key"), 4 * max(ks), 5, seed)
    if len(points) < max(ks):
        points = np.array(own.select(*names).distinct().limit(4 * max(ks)).collect(), float)
        weights = np.ones(len(points))
        if len(points) < max(ks):
            raise ValueError("fewer distinct rows than states")
    rng = np.random.default_rng(seed)
    sets = [_seeds(points, weights, k, rng) for k in ks for _ in range(starts)]
    ends = np.cumsum([0] + [len(s) for s in sets])
    cost, moving, rounds = np.full(len(sets), np.inf), np.ones(len(sets), bool), 0
    just = own.select(*names)
    while moving.any() and rounds < most_rounds:
        rounds += 1

        def add(batch: pa.RecordBatch, sets=tuple(sets), moving=moving.copy()) -> np.ndarray:
            x = _matrix(batch, names)
            out = np.zeros((ends[-1], m + 2))
            for i in np.flatnonzero(moving):
                at, d = _nearest(x, sets[i])
                part = out[ends[i] : ends[i + 1]]
                part[:, 0] = np.bincount(at, minlength=len(sets[i]))
                part[:, 1] = np.bincount(at, d, minlength=len(sets[i]))
                np.add.at(part[:, 2:], at, x)
            return out.ravel()

        sums = summed(just, int(ends[-1]) * (m + 2), add).reshape(-1, m + 2)
        for i in np.flatnonzero(moving):
            part = sums[ends[i] : ends[i + 1]]
            cost[i] = part[:, 1].sum()
            after = np.where(part[:, :1] > 0, part[:, 2:] / np.maximum(part[:, :1], 1), sets[i])
            moving[i] = np.abs(after - sets[i]).max() > tolerance
            sets[i] = after
    best = {k: min((i for i in range(len(sets)) if len(sets[i]) == k), key=lambda i: (cost[i], i)) for k in ks}
    chosen = [sets[best[k]][np.lexsort(sets[best[k]].T[::-1])] for k in ks]

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch, names)
        out = []
        for centers in chosen:
            at, _ = _nearest(x, centers)
            part = np.zeros((len(centers), m + 2))
            part[:, 0], part[:, 1] = np.bincount(at, minlength=len(centers)), np.bincount(at, (x * x).sum(axis=1), minlength=len(centers))
            np.add.at(part[:, 2:], at, x)
            out.append(part.ravel())
        return np.concatenate(out)

    sizes = [len(c) * (m + 2) for c in chosen]
    parts = [p.reshape(-1, m + 2) for p in np.split(summed(just, sum(sizes), spread), np.cumsum(sizes)[:-1])]

    def silhouettes(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch, names)
        square, out = (x * x).sum(axis=1), []
        for centers, part in zip(chosen, parts, strict=True):
            at, _ = _nearest(x, centers)
            n, r = part[:, 0], np.arange(len(x))
            total = np.maximum(n * square[:, None] - 2 * x @ part[:, 2:].T + part[:, 1], 0.0)  # of squared distances to each state's rows
            inner = total[r, at] / np.maximum(n[at] - 1, 1)
            other = np.where(n > 0, total / np.maximum(n, 1), np.inf)
            other[r, at] = np.inf
            outer = other.min(axis=1)
            most = np.maximum(inner, outer)
            s = np.where((n[at] > 1) & np.isfinite(outer) & (most > 0), (outer - inner) / np.where(most > 0, most, 1), 0.0)
            out.append(s.sum())
        return np.array(out)

    mean_silhouette = summed(just, len(ks), silhouettes) / got[0]
    table = [(k, float(cost[best[k]]), float(s)) for k, s in zip(ks, mean_silhouette, strict=True)]
    pick = max(range(len(ks)), key=lambda i: (round(table[i][2], 12), -ks[i]))
    return States(columns, mean, scale, chosen[pick], table)


def state_table(found: States, like: DataFrame) -> DataFrame:
    """k, cost, silhouette, chosen: a row for each number of states that was tried."""
    return like.sparkSession.createDataFrame([(k, c, s, k == found.k) for k, c, s in found.table], "k int, cost double, silhouette double, chosen boolean")

