"""Statistical tests and multivariate summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions import average_rank, ratio
from gapwise.functions.storage import checkpoint
from gapwise.operators.order import ranked_counts, running_min


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds q: p adjusted for the false discovery rate; null p stay null.

    Distinct p are ranked over ranges, and the least of those from each p up is carried from range to range.
    """
    counts = ranked_counts(tests, p)
    own = counts.withColumn("_q", F.col(p) * F.col("total") / (F.col("before") + F.col("n")))
    least = running_min(own.select(p, "_q"), [F.desc(p)], "_q")
    return tests.join(least.withColumn("_q", F.least(F.lit(1.0), F.col("_q"))), p, "left").select(*tests.columns, F.col("_q").alias("q"))


def ranked(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds rank, with ties shared, within groups; null values are left out."""
    counts = ranked_counts(frame, value, by).select(*by, value, average_rank(F.col("before") + 1, F.col("n")).alias("rank"))
    return frame.join(counts, [*by, value])


def two_sample(frame: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """Welch t, Mann-Whitney U, Cohen d (pooled) and Cliff delta of group 1 against group 0; null below 3 values of either."""
    own = ranked(frame.filter(F.col(value).isNotNull()), value, *by)
    a, b = F.col(group) == 0, F.col(group) == 1
    x = F.col(value)
    agg = own.groupBy(*by).agg(
        F.count_if(a).cast("double").alias("na"), F.count_if(b).cast("double").alias("nb"), F.avg(F.when(a, x)).alias("ma"), F.avg(F.when(b, x)).alias("mb"),
        F.var_samp(F.when(a, x)).alias("va"), F.var_samp(F.when(b, x)).alias("vb"), F.sum(F.when(a, F.col("rank"))).alias("ra"), F.median(F.when(b, x)).alias("median_b"),
    )
    na, nb, va, vb = (F.col(c) for c in ("na", "nb", "va", "vb"))
    ok = (na >= 3) & (nb >= 3)
    u = F.col("ra") - na * (na + 1) / 2
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    diff = F.col("mb") - F.col("ma")
    return agg.select(
        *by, F.when(ok, ratio(diff, F.sqrt(va / na + vb / nb))).alias("t"), F.when(ok, u).alias("u"), F.when(ok, ratio(diff, pooled)).alias("cohen_d"),
        F.when(ok, 1 - 2 * u / (na * nb)).alias("cliff"), F.when(ok, F.col("median_b")).alias("median_b"),
    )


def correlation_pairs(frame: DataFrame, columns: list[str], method: str = "pearson", *by: str) -> DataFrame:
    """a, b, rho of each unordered pair of columns, in one pass over (ranks of) the rows."""
    if method == "spearman":
        frame = frame.withColumns({c: F.col(c).cast("double") for c in columns})
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in columns)))
        counts = ranked_counts(frame.select(*by, each.alias("_z")).select(*by, "_z.*"), "_v", [*by, "_c"])
        ranks = checkpoint(counts.select(*by, "_c", "_v", average_rank(F.col("before") + 1, F.col("n")).alias("_r")))  # of all columns at once
        for c in columns:
            own = ranks.filter(F.col("_c") == c).select(*by, F.col("_v").alias(c), "_r")
            frame = frame.join(own, [*by, c]).drop(c).withColumnRenamed("_r", c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    made = frame.groupBy(*by).agg(*(_rho(a, b).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs))
    return made.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")


def _rho(a: str, b: str) -> Column:
    return F.when((F.max(a) > F.min(a)) & (F.max(b) > F.min(b)), ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def ks_statistic(frame: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """Largest distance of the distribution functions of groups 0 and 1, over counts by distinct value."""
    counts = ranked_counts(frame, value, by, more={"a": F.count_if(F.col(group) == 0), "b": F.count_if(F.col(group) == 1)})
    gap = F.abs(ratio(F.col("before_a") + F.col("a"), F.col("total_a")) - ratio(F.col("before_b") + F.col("b"), F.col("total_b")))
    return counts.groupBy(*by).agg(F.max(gap).alias("ks"))


#: Columns up to which gram is one aggregate of expressions.
MOST_EXPRESSIONS = 24


def gram_in_batches(rows: DataFrame, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """gram of k columns without null: each partition makes a count, sums and products about the first row's values; the k * (k + 1) sums are added in a groupBy."""
    head = rows.first()
    if head is None:
        return 0, np.full(k, np.nan), np.full((k, k), np.nan)
    about = np.array(head, float)  # against cancellation

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((k + 1, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - about
            n += len(x)
            total[0] += x.sum(axis=0)
            total[1:] += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, total.size), pa.int64()), "x": pa.array([float(n), *total.ravel()], pa.float64())})

    made = rows.mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    got = np.array([r["x"] for r in sorted(made, key=lambda r: r["i"])])
    n, total = int(got[0]), got[1:].reshape(k + 1, k)
    cov = (total[1:] - np.outer(total[0], total[0]) / n) / (n - 1) if n > 1 else np.full((k, k), np.nan)
    return n, about + total[0] / n, cov


def gram(frame: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without null, mean and covariance matrix (n - 1) of columns, by one aggregate of k * (k + 3) / 2 sums; of many columns by batches."""
    own = frame.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    if len(columns) > MOST_EXPRESSIONS:
        return gram_in_batches(own, len(columns))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = own.agg(F.count("*"), *(F.avg(c) for c in columns), *(F.covar_samp(columns[i], columns[j]) for i, j in pairs)).first()
    n, k = row[0], len(columns)
    cov = np.zeros((k, k))
    for (i, j), x in zip(pairs, row[1 + k :], strict=True):
        cov[i, j] = cov[j, i] = np.nan if x is None else x
    return n, np.array(row[1 : 1 + k], float), cov


def vif(frame: DataFrame, columns: list[str]) -> tuple[dict[str, float], float]:
    """Variance inflation factors (diagonal of the inverse correlation matrix) and condition number."""
    _, _, cov = gram(frame, columns)
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    values = np.linalg.eigvalsh(corr)
    return dict(zip(columns, np.diag(np.linalg.pinv(corr)).tolist(), strict=True)), float(math.sqrt(values[-1] / max(values[0], 1e-300)))


def correlation_clusters(corr: np.ndarray, columns: list[str], most: float) -> list[tuple[str, list[str]]]:
    """Complete linkage of 1 - |rho| up to ``most``: (representative by mean |rho|, members). For a matrix of columns, not of rows."""
    away = 1 - np.abs(corr)
    groups = [[i] for i in range(len(columns))]
    while len(groups) > 1:
        d, i, j = min((max(away[a, b] for a in groups[i] for b in groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > most:
            break
        groups[i] += groups.pop(j)
    return [(columns[max(g, key=lambda a: (np.abs(corr[a, g]).mean(), -a))], [columns[i] for i in sorted(g)]) for g in groups]


def pca(frame: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """Mean, scale, loadings (columns x components) and explained shares of standardised columns, from their covariance."""
    _, mean, cov = gram(frame, columns)
    sd = np.where(np.diag(cov) > 0, np.sqrt(np.diag(cov)), 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(-values)
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order] + 1e-300)
    return {"mean": mean, "scale": sd, "loadings": vectors, "values": values[order], "explained": values[order] / values.sum()}


def normal_tail(z: float) -> float:
    """Two-sided p-value of a normal deviate."""
    return math.erfc(abs(z) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a share, by bisection."""
    def quantile(a: float, b: float, p: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < p else (lo, mid)
        return (lo + hi) / 2

    tail = (1 - level) / 2
    return (quantile(k, n - k + 1, tail) if k else 0.0), (quantile(k + 1, n - k, 1 - tail) if k < n else 1.0)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2 x 2 table."""
    def log_p(x: int) -> float:
        n = a + b + c + d
        f = math.lgamma
        return f(a + b + 1) + f(c + d + 1) + f(a + c + 1) + f(b + d + 1) - f(n + 1) - f(x + 1) - f(a + b - x + 1) - f(a + c - x + 1) - f(d - a + x + 1)

    own = log_p(a)
    return min(1.0, sum(math.exp(log_p(x)) for x in range(max(0, a - d), min(a + b, a + c) + 1) if log_p(x) <= own + 1e-7))


def bootstrap(segments: DataFrame, value: Column, reps: int, seed: int) -> DataFrame:
    """rep, mean of ``value`` over a resample of segments.

    Each segment is drawn a Poisson(1) number of times in every rep, by a hash of its key, so that a pass over the
    segments with combined sums does all reps and reruns agree.
    """
    cut = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    own = segments.select("src", "seg_id", value.alias("v"), rep.alias("rep"))
    u = (F.xxhash64("src", "seg_id", "rep", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    times = sum((F.when(u > c, 1).otherwise(0) for c in cut), F.lit(0))
    return own.withColumn("k", times).groupBy("rep").agg(ratio(F.sum(F.col("k") * F.col("v")), F.sum("k")).alias("mean"))


def duplicate_columns(frame: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """a, b, most, same of every unordered pair of columns: their largest distance, over the rows where both are known, and whether it is below the tolerance; all pairs in one aggregate."""
    own = frame.select(*(F.col(c).cast("double").alias(c) for c in columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    made = own.agg(*(F.max(F.abs(F.col(a) - F.col(b))).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("most")) for a, b in pairs))
    return made.select(F.explode(rows).alias("x")).select("x.*").withColumn("same", F.col("most") < tolerance)


def transform_effect(frame: DataFrame, columns: list[str]) -> DataFrame:
    """feature, transform, n, mean, sd, skew, kurt of each column as it is and as log1p: deviation, skewness and excess kurtosis corrected for bias.

    Null where a column holds a value that log1p is not defined for, skew and kurt up to 3 values or without spread.
    All columns and transforms go through one pass, as rows.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(tr).alias("transform"), F.col(c).cast("double").alias("x")) for c in columns for tr in ("none", "log1p"))))
    own = frame.select(each.alias("z")).select("z.*").filter("x is not null")
    x = F.when(F.col("transform") == "none", F.col("x")).when(F.col("x") > -1, F.log1p("x"))
    made = own.withColumn("_y", x).groupBy("feature", "transform").agg(
        F.count("*").alias("n"), F.count("_y").alias("_k"), F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("sd"), F.skewness("_y").alias("_g1"), F.kurtosis("_y").alias("_g2"), (F.max("_y") > F.min("_y")).alias("_spread")
    )
    n = F.col("n").cast("double")
    ok = F.col("_k") == F.col("n")
    shaped = ok & (F.col("n") > 3) & F.col("_spread")
    return made.select(
        "feature", "transform", "n", F.when(ok, F.col("mean")).alias("mean"), F.when(ok, F.col("sd")).alias("sd"), F.when(shaped, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(shaped, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).alias("kurt"),
    )


def loadings_ranking(frame: DataFrame, columns: list[str], targets: tuple[float, ...] = (0.8, 0.9, 0.95)) -> tuple[list[tuple], dict[float, int]]:
    """(component, explained, cumulative, feature, loading, rank) of every component and column of a PCA of standardised columns, by falling size of the loading; and how many components reach each target share. A table of columns."""
    fit = pca(frame, columns)
    cumulative = np.cumsum(fit["explained"])
    rows = []
    for k in range(len(columns)):
        order = np.argsort(-np.abs(fit["loadings"][:, k]), kind="stable")
        rows += [(k + 1, float(fit["explained"][k]), float(cumulative[k]), columns[i], float(fit["loadings"][i, k]), r + 1) for r, i in enumerate(order)]
    return rows, {x: int(np.searchsorted(cumulative, x - 1e-12) + 1) for x in targets}
