"""One-class detectors. A fit is a small parameter set from sums over all training rows; a score is an expression."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions.storage import written
from gapwise.operators.order import quantiles, ranked_counts
from gapwise.operators.segments import in_segment
from gapwise.operators.stats import gram, pca


def lag_pairs(segments: DataFrame, channels: list[str], p: int) -> DataFrame:
    """The p samples before each sample of a segment, as columns; samples with fewer before them are left out."""
    w = in_segment()
    lags = {f"{c}_l{i}": F.lag(c, i).over(w) for i in range(1, p + 1) for c in channels}
    return segments.withColumns(lags).filter(F.col("pos") >= p)


def naive_scores(segments: DataFrame, train: Column, channel: str) -> DataFrame:
    """Squared step of a channel over the training steps' population standard deviation; null for a segment's first sample."""
    own = segments.withColumn("step", F.col(channel) - F.lag(channel).over(in_segment()))
    scale = own.filter(train).agg(F.greatest(F.stddev_pop("step"), F.lit(1e-6)).alias("_sd"))
    return own.crossJoin(F.broadcast(scale)).withColumn("score", F.pow(F.col("step") / F.col("_sd"), 2)).drop("_sd")


class Moments:
    """Rows, means and products about the means of columns; sums of two sets are exact."""

    def __init__(self, n: int, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, away = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + away * other.n / n, self.products + other.products + np.outer(away, away) * self.n * other.n / n)

    def ridge(self, k: int, target: int, alpha: float) -> tuple[np.ndarray, float]:
        """Coefficients of the first k columns and intercept of a ridge regression of a column (the intercept isn't penalised)."""
        coef = np.linalg.solve(self.products[:k, :k] + alpha * np.eye(k), self.products[:k, target])
        return coef, float(self.mean[target] - self.mean[:k] @ coef)

    def error(self, k: int, target: int, fit: tuple[np.ndarray, float]) -> float:
        """Mean squared error of such a fit on these rows."""
        coef, intercept = fit
        away = self.mean[target] - self.mean[:k] @ coef - intercept
        spread = self.products[target, target] - 2 * coef @ self.products[:k, target] + coef @ self.products[:k, :k] @ coef
        return max(0.0, spread / self.n + away * away) if self.n else math.nan


def moments(rows: DataFrame, columns: list[str], flag: Column) -> dict[bool, Moments]:
    """Moments of the rows without null, for each value of a flag, by one aggregate."""
    own = rows.select(flag.alias("_f"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = own.groupBy("_f").agg(F.count("*"), *(F.avg(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) for i, j in pairs)).collect()
    out = dict.fromkeys((False, True), Moments(0, np.zeros(k), np.zeros((k, k))))
    for row in got:
        products = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[2 + k :], strict=True):
            products[i, j] = products[j, i] = x * row[1]
        out[row[0]] = Moments(row[1], np.array(row[2 : 2 + k]), products)
    return out


def ridge_fit(train: DataFrame, inputs: list[str], target: str, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a ridge regression (the intercept isn't penalised)."""
    return moments(train, [*inputs, target], F.lit(True))[True].ridge(len(inputs), len(inputs), alpha)


ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def ridge_var(segments: DataFrame, channels: list[str], p: int, train: Column, validation: Column, alphas: tuple[float, ...] = ALPHAS) -> tuple[dict, DataFrame]:
    """Vector autoregression of order p by ridge; alpha is chosen on the validation rows and the fit repeated on both.

    All fits and losses follow from the moments of inputs and targets in the training and the validation rows, which
    one pass gives. Returns parameters and the frame with score: the mean over channels of the squared error in units
    of the training residuals' standard deviation; null for a segment's first p samples.
    """
    lagged = lag_pairs(segments, channels, p)
    inputs = [f"{c}_l{i}" for i in range(1, p + 1) for c in channels]
    k = len(inputs)
    found = moments(lagged.filter(train), [*inputs, *channels], validation)
    both, targets = found[False] + found[True], range(k, k + len(channels))
    loss = {a: sum(found[True].error(k, t, found[False].ridge(k, t, a)) for t in targets) if found[False].n and found[True].n else 0.0 for a in alphas}
    alpha = min(alphas, key=lambda a: (loss[a], a))
    fits = {c: both.ridge(k, t, alpha) for c, t in zip(channels, targets, strict=True)}
    sd = [max(math.sqrt(both.error(k, t, fits[c])), 1e-6) for c, t in zip(channels, targets, strict=True)]
    score = F.lit(0.0)
    for c, s in zip(channels, sd, strict=True):
        guess = sum((F.col(x) * float(w) for x, w in zip(inputs, fits[c][0], strict=True)), F.lit(fits[c][1]))
        score = score + F.pow((F.col(c) - guess) / s, 2) / len(channels)
    w = in_segment()
    early = F.col("pos") < p
    lags = {f"{c}_l{i}": F.lag(c, i).over(w) for i in range(1, p + 1) for c in channels}
    made = segments.withColumns(lags).select(*segments.columns, F.when(~early, score).alias("score"))
    return {"alpha": alpha, "fits": fits, "sd": sd, "loss": loss}, made


def hbos(frame: DataFrame, train: Column, columns: list[str], bins: int = 10) -> DataFrame:
    """Histogram score: the sum over columns of -ln of the training share of the value's bin (0.1 rows where it is empty or outside)."""
    stats = frame.filter(train).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("_n"))
    own = frame.crossJoin(F.broadcast(stats))
    for c in columns:
        width = (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / bins
        at = F.floor((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(width, F.lit(0.0)))
        own = own.withColumn(f"_b_{c}", F.when(F.col(c) == F.col(f"_hi_{c}"), bins - 1).otherwise(at).cast("int"))
    score = F.lit(0.0)
    for c in columns:
        counts = own.filter(train).groupBy(f"_b_{c}").agg(F.count("*").alias(f"_k_{c}"))  # bins rows
        own = own.join(F.broadcast(counts), f"_b_{c}", "left")
        score = score - F.log(F.coalesce(F.col(f"_k_{c}"), F.lit(0.1)) / F.col("_n"))
    return own.select(*frame.columns, score.alias("score"))


def copod(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Copula score: over columns, the larger of the tail probabilities' -ln sums (left, right, and the side that skewness tells)."""
    own = frame
    for c in columns:
        n = ranked_counts(frame, c)
        tails = {f"_l_{c}": (F.col("before") + F.col("n")) / F.col("total"), f"_r_{c}": (F.col("total") - F.col("before")) / F.col("total")}
        own = own.join(n.select(c, *((-F.log(x)).alias(k) for k, x in tails.items())), c)
    skew = own.agg(*(F.skewness(c).alias(f"_s_{c}") for c in columns))
    own = own.crossJoin(F.broadcast(skew))
    left = sum((F.col(f"_l_{c}") for c in columns), F.lit(0.0))
    right = sum((F.col(f"_r_{c}") for c in columns), F.lit(0.0))
    side = sum((F.when(F.col(f"_s_{c}") < 0, F.col(f"_l_{c}")).otherwise(F.col(f"_r_{c}")) for c in columns), F.lit(0.0))
    return own.select(*frame.columns, F.greatest(left, right, side).alias("score"))


def quadratic_form(columns: list[str], center: np.ndarray, precision: np.ndarray) -> Column:
    """(x - center)' precision (x - center)."""
    x = [F.col(c) - float(m) for c, m in zip(columns, center, strict=True)]
    return sum((x[i] * x[j] * float(precision[i, j] * (1 if i == j else 2)) for i in range(len(x)) for j in range(i, len(x))), F.lit(0.0))


def mahalanobis(frame: DataFrame, train: Column, columns: list[str], ridge: float = 1e-6) -> DataFrame:
    """Squared Mahalanobis distance to the training rows."""
    _, mean, cov = gram(frame.filter(train), columns)
    cov = cov + ridge * np.trace(cov) / len(columns) * np.eye(len(columns))
    return frame.withColumn("score", quadratic_form(columns, mean, np.linalg.inv(cov)))


def concentrated(x: np.ndarray, support: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Center and precision of rows after concentration steps from their medians and robust scales."""
    low, center, high = np.percentile(x, [25, 50, 75], axis=0)
    precision, last, k = np.diag(1 / np.maximum((high - low) / 1.349, 1e-6) ** 2), math.inf, x.shape[1]
    for _ in range(steps):
        away = x - center
        d = np.einsum("ni,ij,nj->n", away, precision, away)
        kept = x[d <= np.quantile(d, support)]
        if len(kept) <= k:
            break
        cov = np.cov(kept.T).reshape(k, k)
        cov += 1e-9 * np.trace(cov) / k * np.eye(k)
        det = float(np.linalg.slogdet(cov)[1])
        if not det < last - 1e-6:
            break
        center, precision, last = kept.mean(axis=0), np.linalg.inv(cov), det
    return center, precision


def robust_mcd(frame: DataFrame, train: Column, columns: list[str], support: float = 0.75, steps: int = 20, sample: int = 20_000, seed: int = 0) -> tuple[dict, DataFrame]:
    """Minimum covariance determinant by concentration steps over the whole training set, then squared distances.

    A step fits location and covariance of the support share of rows nearest to the last fit, by a cut to 1 / 100,000
    of the ranks and one aggregate, so no row leaves the executors; the training columns are written once. Steps start
    from the fit of ``sample`` rows, drawn by a hash of their place, which itself starts from medians and robust
    scales, and end when the determinant over all rows falls by less than a millionth. There are no random starts.
    """
    rows = written(frame.filter(train).select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna())
    k = len(columns)
    few = rows.withColumn("_h", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))).orderBy("_h").limit(sample).drop("_h").collect()
    center, precision = concentrated(np.array(few, float).reshape(len(few), k), support, steps) if few else (np.full(k, np.nan), np.full((k, k), np.nan))
    last, dets = math.inf, []
    for _ in range(steps if few else 0):
        d = rows.withColumn("_d", quadratic_form(columns, center, precision))
        cut = d.agg(F.percentile_approx("_d", support, 100_000)).first()[0]
        _, mean, cov = gram(d.filter(F.col("_d") <= cut), columns)
        cov = cov + 1e-9 * np.trace(cov) / k * np.eye(k)
        det = float(np.linalg.slogdet(cov)[1])
        if not det < last - 1e-6:
            break
        center, precision, last = mean, np.linalg.inv(cov), det
        dets.append(det)
    return {"center": center, "precision": precision, "log_det": dets}, frame.withColumn("score", quadratic_form(columns, center, precision))


def pca_error(frame: DataFrame, train: Column, columns: list[str], components: int) -> DataFrame:
    """Adds spe (squared error of the reconstruction from the first components) and t2 (their squared scores over variances)."""
    fit = pca(frame.filter(train), columns)
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, fit["mean"], fit["scale"], strict=True)]
    v = fit["loadings"][:, :components]
    values = fit["values"][:components]

    def errors(z: pd.Series) -> pd.DataFrame:
        x = np.stack(z.to_list()) if len(z) else np.empty((0, len(v)))
        t = x @ v
        return pd.DataFrame({"spe": ((x - t @ v.T) ** 2).sum(axis=1), "t2": (t * t / values).sum(axis=1)})

    # an expression of this many terms is more than Catalyst plans; rows with nulls get none
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    own = frame.select("*", F.pandas_udf(errors, "spe double, t2 double")(F.array(*(F.coalesce(x, F.lit(0.0)) for x in z))).alias("_e"), known.alias("_known"))
    return own.select(*frame.columns, *(F.when(F.col("_known"), F.col(f"_e.{c}")).alias(c) for c in ("spe", "t2")))


def kalman_fit(segments: DataFrame, channels: list[str], train: Column, noise: float = 0.1) -> dict[str, np.ndarray]:
    """A VAR(1) of the channels: transition a, intercept c, covariance q of its errors, and that of the observation r, ``noise`` times the diagonal of q."""
    lagged = lag_pairs(segments, channels, 1)
    inputs, k = [f"{c}_l1" for c in channels], len(channels)
    m = moments(lagged.filter(train), [*inputs, *channels], F.lit(True))[True]
    fits = [m.ridge(k, k + i, 1e-6) for i in range(k)]
    a, c = np.array([f[0] for f in fits]), np.array([f[1] for f in fits])
    xx, xy, yy = m.products[:k, :k], m.products[:k, k:], m.products[k:, k:]
    q = (yy - a @ xy - (a @ xy).T + a @ xx @ a.T) / max(m.n, 1)
    q = (q + q.T) / 2 + 1e-9 * max(np.trace(q) / k, 1e-12) * np.eye(k)
    return {"a": a, "c": c, "q": q, "r": noise * np.diag(np.diag(q))}


def innovations(x: np.ndarray, a: np.ndarray, c: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Mean squared normalised innovation of each sample of series (n, length, k), side by side; NaN for the first samples and after a series' end."""
    n, length, k = x.shape
    state, cov, out = x[:, 0].copy(), np.broadcast_to(r, (n, k, k)).copy(), np.full((n, length), np.nan)
    for t in range(1, length):
        state, cov = state @ a.T + c, a @ cov @ a.T + q
        s = cov + r
        e = x[:, t] - state
        inverse = np.linalg.inv(s)
        out[:, t] = np.einsum("ni,nij,nj->n", e, inverse, e) / k
        gain = cov @ inverse
        state, cov = state + np.einsum("nij,nj->ni", gain, e), cov - gain @ cov
    return out


def kalman_scores(segments: DataFrame, channels: list[str], fit: dict[str, np.ndarray]) -> DataFrame:
    """src, seg_id, pos, score: the squared normalised innovation of a Kalman filter along each segment, null for its first sample.

    Segments of a partition are filtered side by side, as many at a time as an Arrow batch holds; a segment must fit a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            rows = pd.concat([x for x in (rest, batch) if x is not None], ignore_index=True) if batch is not None or rest is not None else None
            if rows is None or not len(rows):
                continue
            key = rows[["src", "seg_id"]].to_numpy()
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            starts = np.flatnonzero(new)
            end = len(rows) if batch is None else int(starts[-1])  # the last segment may go on
            rest = rows.iloc[end:] if batch is not None else None
            starts = starts[starts < end]
            if not len(starts):
                continue
            sizes = np.diff(np.append(starts, end))
            x = np.zeros((len(starts), sizes.max(), len(channels)))
            owner, at = np.repeat(np.arange(len(starts)), sizes), np.arange(end) - np.repeat(starts, sizes)
            x[owner, at] = rows[channels].to_numpy(float)[:end]
            yield rows.iloc[:end][["src", "seg_id", "pos"]].assign(score=innovations(x, **fit)[owner, at])

    own = segments.select("src", "seg_id", "pos", *(F.col(c).cast("double").alias(c) for c in channels))
    own = own.repartition("src", "seg_id").sortWithinPartitions("src", "seg_id", "pos")
    made = own.mapInPandas(run, "src long, seg_id long, pos long, score double")
    return made.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def tree_samples(rows: DataFrame, columns: list[str], keys: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    """tree and columns: for each tree ``sample`` rows without replacement (all, if there are fewer), drawn for each row and tree by hashes of the row's key.

    A row first draws in how many trees it is (binomial, with a share at which no tree comes out short: 10 standard
    deviations over ``sample``), then in which; each tree keeps its rows of lowest hash.
    """
    n = rows.count()
    share = min(1.0, (sample + 10 * math.sqrt(sample)) / max(n, 1))
    h = F.xxhash64(*keys, *columns, F.lit(seed))
    if share < 1:
        part, below, limits = (1 - share) ** trees, 0.0, []
        for k in range(trees):
            below += part
            limits.append(below)
            part *= (trees - k) / (k + 1) * share / (1 - share)
        u = F.shiftrightunsigned(F.col("_h"), 11) / float(1 << 53)
        # u is below 1, so limits beyond its largest value count nothing
        times = sum((F.when(u >= x, 1).otherwise(0) for x in limits if x <= 1 - 2.0**-53), F.lit(0))
        own = rows.withColumn("_h", h).filter(u >= limits[0]).withColumn("_k", times)  # most rows are in no tree, which one comparison tells
    else:
        own = rows.withColumn("_h", h).withColumn("_k", F.lit(trees))
    k = F.col("_k")
    # a few trees are the first different ones of a row of draws, many those of lowest draws among all
    few = F.slice(F.array_distinct(F.transform(F.sequence(F.lit(0), 3 * k + 19), lambda i: F.pmod(F.xxhash64("_h", i), F.lit(trees)).cast("int"))), F.lit(1), k)
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.struct(F.xxhash64("_h", i).alias("draw"), i.alias("tree")))
    many = F.transform(F.slice(F.sort_array(draws), F.lit(1), k), lambda x: x["tree"])
    chosen = F.explode(F.when(k <= trees // 4, few).otherwise(many))
    own = own.select(*columns, *(c for c in keys if c not in columns), "_h", chosen.alias("_t"))
    order = Window.partitionBy("_t").orderBy(F.xxhash64("_h", "_t", F.lit(1)), *keys, *columns)
    return own.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= sample).select(F.col("_t").alias("tree"), *columns)


def path_lengths(x: np.ndarray, column: np.ndarray, cut: np.ndarray, child: np.ndarray, length: np.ndarray, roots: np.ndarray, depth: int, block: int = 128) -> np.ndarray:
    """Sum over all trees of the path of each row of x (columns, rows); a block of rows goes down all trees side by side."""
    total = np.zeros(x.shape[1])
    for start in range(0, x.shape[1], block):
        part = np.ascontiguousarray(x[:, start : start + block])
        n = part.shape[1]
        flat, row = part.ravel(), np.arange(n, dtype=np.int32)
        at = np.repeat(roots[:, None], n, axis=1)
        for _ in range(depth):
            place = column.take(at)
            place *= np.int32(n)
            place += row
            right = flat.take(place) >= cut.take(at)
            at = child.take(at)
            at += right
        total[start : start + n] = length.take(at).sum(axis=0)
    return total


class PathSteps:
    """path_lengths() of the rows of a task. Rows that lie alike to the cuts of all columns but one share a function of that one, which steps at some of its cuts.

    Such a function is made once ``often`` rows of its kind have come, and kept while all have up to ``most`` steps; other rows go down the trees.
    """

    def __init__(self, column: np.ndarray, cut: np.ndarray, child: np.ndarray, length: np.ndarray, roots: np.ndarray, depth: int, often: int = 64, most: int = 1 << 21):
        self.nodes, self.depth, self.often, self.most = (column, cut, child, length, roots), depth, often, most if len(roots) else 0
        self.seen: dict[int, int] = {}
        self.number: dict[int, int] = {}
        self.at, self.total = [np.zeros(0, np.int64)], [np.zeros(0)]
        self.along = None
        self.n_steps = 0

    def begin(self, x: np.ndarray) -> None:
        column, cut = self.nodes[:2]
        self.cuts = [np.unique(cut[(column == c) & (cut < math.inf)]) for c in range(len(x))]
        self.along = int(np.argmax([len(np.unique(self.bins(c, v))) for c, v in enumerate(x)]))
        self.width = len(self.cuts[self.along]) + 1
        self.others = [c for c in range(len(x)) if c != self.along]
        if math.prod(len(self.cuts[c]) + 1 for c in self.others) > 1 << 62:
            self.most = 0  # kinds have no number

    def bins(self, c: int, values: np.ndarray) -> np.ndarray:
        """How many cuts of a column a value reaches; none, if it is missing."""
        return np.where(np.isnan(values), 0, np.searchsorted(self.cuts[c], values, side="right"))

    def make(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins of the column along which the path lengths of rows like x change, and their sums from there on."""
        column, cut, child, length, roots = self.nodes
        node, lo, hi = roots.astype(np.int64), np.full(len(roots), -math.inf), np.full(len(roots), math.inf)
        for _ in range(self.depth):
            both = (column[node] == self.along) & (cut[node] < math.inf)
            at, one = cut[node], ~both
            with np.errstate(invalid="ignore"):
                right = x[column[node]] >= at
            left_on, right_on = both & (lo < at), both & (hi > at)
            node, lo, hi = (
                np.concatenate([child[node[one]] + right[one], child[node[left_on]], child[node[right_on]] + 1]),
                np.concatenate([lo[one], lo[left_on], np.maximum(lo, at)[right_on]]),
                np.concatenate([hi[one], np.minimum(hi, at)[left_on], hi[right_on]]),
            )
        ends = hi < math.inf
        where = np.concatenate([np.where(lo > -math.inf, np.searchsorted(self.cuts[self.along], lo) + 1, 0), np.searchsorted(self.cuts[self.along], hi[ends]) + 1])
        at, which = np.unique(where, return_inverse=True)
        return at, np.cumsum(np.bincount(which, np.concatenate([length[node], -length[node[ends]]])))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Sums of x (columns, rows)."""
        if not x.shape[1]:
            return np.zeros(0)
        if self.along is None:
            self.begin(x)
        if not self.most:
            return path_lengths(x, *self.nodes, self.depth)
        kind = np.zeros(x.shape[1], np.int64)
        for c in self.others:
            kind = kind * (len(self.cuts[c]) + 1) + self.bins(c, x[c])
        kinds, first, which, counts = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
        made = len(self.number)
        for k, i, n in zip(kinds.tolist(), first.tolist(), counts.tolist(), strict=True):
            if k in self.number or (k not in self.seen and len(self.seen) >= self.most >> 4):
                continue
            self.seen[k] = self.seen.get(k, 0) + n
            if self.seen[k] >= self.often and self.n_steps < self.most:
                at, total = self.make(x[:, i])
                self.at.append(at + len(self.number) * self.width)
                self.total.append(total)
                self.n_steps += len(at)
                self.number[k] = len(self.number)
        if len(self.number) > made:
            self.at, self.total = [np.concatenate(self.at)], [np.concatenate(self.total)]
        number = np.array([self.number.get(k, -1) for k in kinds.tolist()])[which]
        out, known = np.empty(x.shape[1]), number >= 0
        out[known] = self.total[0][np.searchsorted(self.at[0], number[known] * self.width + self.bins(self.along, x[self.along][known]), side="right") - 1] if known.any() else 0.0
        if not known.all():
            out[~known] = path_lengths(x[:, ~known], *self.nodes, self.depth)
        return out


def isolation_forest(frame: DataFrame, train: Column, columns: list[str], trees: int = 300, sample: int = 256, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Isolation forest: each tree is fitted on its own sample of training rows, as the method says; all rows are scored.

    keys: columns that name a row, so that rows of equal values have draws of their own and reruns agree. Without
    them equal rows are numbered, which takes those of one value to one task.
    """
    rows = frame.filter(train).dropna(subset=columns)
    if keys is None:
        rows = rows.select(*columns).withColumn("_copy", F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0))))
    drawn = tree_samples(rows, columns, keys or ["_copy"], trees, sample, seed).toPandas()
    samples = [x.sort_values(columns)[columns].to_numpy(float) for _, x in drawn.groupby("tree")]
    rng = np.random.default_rng(seed)
    forest: list = []

    def harmonic(n: int) -> float:
        return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(x: np.ndarray, depth: int):
        spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
        if depth == 0 or not len(spread):
            return harmonic(len(x))
        c = int(rng.choice(spread))
        cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
        return c, cut, grow(x[x[:, c] < cut], depth - 1), grow(x[x[:, c] >= cut], depth - 1)

    size = max(map(len, samples), default=0)
    for x in samples:
        forest.append(grow(x, max(1, math.ceil(math.log2(max(size, 2))))))

    # all trees in one table of nodes; a leaf is its own child, and no value reaches its cut
    column, cut, child, length, roots = [], [], [], [], []
    for tree in forest:
        first = len(column)
        roots.append(first)
        todo = [(tree, 0)]
        while todo:  # level by level, so that children follow in the order of their parents
            after = []
            for node, depth in todo:
                if isinstance(node, tuple):
                    child.append(-1)
                    column.append(node[0])
                    cut.append(node[1])
                    length.append(0.0)
                    after += [(node[2], depth + 1), (node[3], depth + 1)]
                else:
                    child.append(len(child))
                    column.append(0)
                    cut.append(math.inf)
                    length.append(depth + node)
            todo = after
        following = first + 1
        for k in range(first, len(child)):
            if child[k] < 0:
                child[k] = following
                following += 2
    nodes = [np.array(z, k) for z, k in ((column, np.int32), (cut, float), (child, np.int32), (length, float), (roots, np.int32))]
    deepest, scale = max(1, math.ceil(math.log2(max(size, 2)))), max(len(forest), 1) * max(harmonic(size), 1e-9)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        paths = PathSteps(*nodes, deepest)
        for rows in batches:
            yield pd.Series(2 ** (-paths(np.stack([rows[c].to_numpy(float) for c in columns])) / scale))

    return frame.withColumn("score", F.pandas_udf(score, "double")(F.struct(*columns)))


def injected(segments: DataFrame, kind: str, strength: float, a: str, b: str, seed: int = 0) -> DataFrame:
    """Samples with a synthetic fault: amplitude scales a, antiphase mixes a and -b, spike adds peaks at some samples, noise adds a normal deviate, current scales b's share of a.

    What is random comes from a hash of the sample's key, so that it doesn't hang on how rows are dealt.
    """
    x, y = F.col(a), F.col(b)
    u = [(F.shiftrightunsigned(F.xxhash64("src", "seg_id", "pos", F.lit(seed + 1 + i)), 11) + 1) / float(1 << 53) for i in range(2)]
    new = {
        "amplitude": x * (1 + strength),
        "antiphase": (1 - strength) * x - strength * y,
        "spike": x + F.when(F.pmod(F.xxhash64("src", "seg_id", "pos", F.lit(seed)), F.lit(20)) == 0, strength).otherwise(0.0),
        "noise": x + F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1]) * strength,
        "current": x + y * strength,
    }[kind]
    return segments.withColumn(f"{a}_injected", new)
