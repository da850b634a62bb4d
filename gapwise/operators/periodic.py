"""Sine fits of segments and what is read from them, two-level states of a column, splits by a seeded draw."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.operators.order import cumulative, ranked_counts
from gapwise.operators.series import CELLS, whole_groups

#: Samples that a fit holds for all frequencies at once.
CHUNK = 4096
#: Least eigenvalue over the largest, down to which two unknowns are solved for directly.
APART = 1e-8


def _residuals(t: np.ndarray, x: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Sums of squares (segments, frequencies) that a sine with offset leaves of x; t and x are (segments, samples). From sums over chunks of samples.

    Where sine, cosine and offset are told apart well, the offset is taken out and two unknowns are solved for; else
    by the pseudoinverse, which drops a direction that is nearly the others' sum.
    """
    n = t.shape[1]
    sums = np.zeros((8, *freqs.shape))
    for i in range(0, n, CHUNK):
        angle = 2 * math.pi * (freqs[:, :, None] * t[:, None, i : i + CHUNK])
        a, b, y = np.sin(angle), np.cos(angle), x[:, i : i + CHUNK]
        sums[0] += a.sum(axis=2)
        sums[1] += b.sum(axis=2)
        for k, (u, v) in enumerate(((a, a), (a, b), (b, b)), 2):
            sums[k] += np.einsum("gfn,gfn->gf", u, v)
        sums[5] += (a @ y[:, :, None])[..., 0]
        sums[6] += (b @ y[:, :, None])[..., 0]
        sums[7] += y.sum(axis=1, keepdims=True)
    s, c, ss, sc, cc, sx, cx, xs = sums
    vs, vsc, vc, vsx, vcx = ss - s * s / n, sc - s * c / n, cc - c * c / n, sx - s * xs / n, cx - c * xs / n
    det = vs * vc - vsc * vsc
    with np.errstate(all="ignore"):
        found = xs * xs / n + (vc * vsx * vsx - 2 * vsc * vsx * vcx + vs * vcx * vcx) / det
    near = ~(det > 2 * APART * n * n)  # the least eigenvalue over the largest is det / (2 n n) or more
    if near.any():
        i, f = np.nonzero(near)
        gram, right = np.zeros((len(i), 3, 3)), np.zeros((len(i), 3))
        for j in range(0, n, CHUNK):
            angle = 2 * math.pi * (freqs[i, f, None] * t[i, j : j + CHUNK])
            design = np.stack([np.sin(angle), np.cos(angle), np.ones_like(angle)], axis=1)
            gram += design @ design.swapaxes(1, 2)
            right += (design @ x[i, j : j + CHUNK, None])[..., 0]
        coef = np.einsum("kij,kj->ki", np.linalg.pinv(gram, rcond=1e-9, hermitian=True), right)
        found[near] = np.einsum("ki,ki->k", coef, right)
    return (x * x).sum(axis=1, keepdims=True) - found


def _fits(t: np.ndarray, x: np.ndarray, grid: np.ndarray, fine: int) -> np.ndarray:
    """freq, amp, phase, offset, resid_rms, r2 (segments, 6) of segments of one length with spread."""
    t, mean = t - t[:, :1], x.mean(axis=1)
    y, out = x - mean[:, None], np.empty((len(t), 6))
    best = np.argmin(_residuals(t, y, np.broadcast_to(grid, (len(t), len(grid)))), axis=1)
    near = np.linspace(grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, len(grid) - 1)], fine, axis=1)
    freqs = near[np.arange(len(t)), np.argmin(_residuals(t, y, near), axis=1)]
    for k, freq in enumerate(freqs.tolist()):
        angle = 2 * math.pi * freq * t[k]
        design = np.column_stack([np.sin(angle), np.cos(angle), np.ones_like(angle)])
        a, b, c = np.linalg.lstsq(design, y[k], rcond=None)[0]
        left = y[k] - design @ (a, b, c)
        out[k] = freq, math.hypot(a, b), math.atan2(b, a), c + mean[k], math.sqrt(left @ left / len(left)), 1 - left @ left / (y[k] @ y[k])
    return out


def sine_fit(segments: DataFrame, channel: str, seconds: Column, low: float = 0.01, high: float = 5.0, coarse: int = 500, fine: int = 101, least: int = 5) -> DataFrame:
    """src, seg_id, n, freq, amp, phase, offset, resid_rms, r2: the sine with offset that leaves least of each segment's channel.

    x = amp * sin(2 pi freq t + phase) + offset, with t in seconds since the segment's first sample. ``coarse``
    frequencies in geometric steps from ``low`` to ``high`` are tried, then ``fine`` even ones between the neighbours
    of the best; of equally good ones the lowest is taken. Samples with a null channel or time are left out; n counts
    the others. A segment of fewer than ``least`` of them, or without spread, has null results, and an empty table
    no row. A segment must fit a task, as its best frequency needs all of its samples; many are fitted side by side.
    """
    grid = np.geomspace(low, high, coarse)

    names = ("freq", "amp", "phase", "offset", "resid_rms", "r2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, ["src", "seg_id"]):
            t, x = rows["t"].to_numpy(float), rows["x"].to_numpy(float)
            known = ~(np.isnan(t) | np.isnan(x))
            sizes = np.add.reduceat(known.astype(np.int64), starts)
            t, x, first = t[known], x[known], np.cumsum(sizes) - sizes
            made = np.full((len(starts), len(names)), np.nan)
            for n in np.unique(sizes[sizes >= least]):
                same = np.flatnonzero(sizes == n)
                for some in np.array_split(same, -(-len(same) * int(n) * coarse // CELLS)):
                    at = first[some][:, None] + np.arange(n)
                    spread = x[at].max(axis=1) > x[at].min(axis=1)
                    if spread.any():
                        made[some[spread]] = _fits(t[at[spread]], x[at[spread]], grid, fine)
            yield rows.iloc[starts][["src", "seg_id"]].assign(n=sizes, **dict(zip(names, made.T, strict=True)))

    own = segments.select("src", "seg_id", "pos", seconds.cast("double").alias("t"), F.col(channel).cast("double").alias("x"))
    # few bytes and much work: as many tasks as a shuffle has, which adaptive execution leaves alone if they are named
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(parts, "src", "seg_id").sortWithinPartitions("src", "seg_id", "pos")
    made = own.mapInPandas(run, "src long, seg_id long, n long, " + ", ".join(f"{c} double" for c in names))
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def sine_features(fits: DataFrame, expected: float) -> DataFrame:
    """src, seg_id, resid_rms, r2 and how far the frequency is from the expected one."""
    return fits.select("src", "seg_id", "resid_rms", "r2", F.abs(F.col("freq") - expected).alias("freq_off"))


def sine_residuals(segments: DataFrame, fits: DataFrame, channel: str, seconds: Column, name: str = "residual") -> DataFrame:
    """Segments with what the fitted sine leaves of a channel; null where there is no fit, or no channel or time."""
    own = segments.withColumn("_t", seconds.cast("double"))
    first = F.min_by("_t", F.when(F.col("_t").isNotNull() & F.col(channel).isNotNull(), F.col("pos")))
    starts = own.groupBy("src", "seg_id").agg(first.alias("_t0")).join(fits.select("src", "seg_id", *(F.col(c).alias(f"_{c}") for c in ("freq", "amp", "phase", "offset"))), ["src", "seg_id"])
    fitted = F.col("_amp") * F.sin(2 * math.pi * F.col("_freq") * (F.col("_t") - F.col("_t0")) + F.col("_phase")) + F.col("_offset")
    return own.join(starts, ["src", "seg_id"], "left").select(*segments.columns, (F.col(channel) - fitted).alias(name))


def two_levels(frame: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, boundary, n_low, n_high, low, high: the cut of a column in two that leaves least squares within (2-means, exact).

    The boundary is midway between the means, low and high. Each cut between distinct values is judged by running
    sums. Nulls are left out; a group of fewer than two distinct values has no row; of equally good cuts the lowest
    is taken.
    """
    own = ranked_counts(frame, value, by, more={"sum": F.sum(value)}).filter("before > 0")
    n_low, n_high = F.col("before"), F.col("total") - F.col("before")
    low, high = F.col("before_sum") / n_low, (F.col("total_sum") - F.col("before_sum")) / n_high
    gain = n_low * n_high * (high - low) * (high - low) / F.col("total")
    cut = F.struct(((low + high) / 2).alias("boundary"), n_low.alias("n_low"), n_high.alias("n_high"), low.alias("low"), high.alias("high"))
    best = own.groupBy(*by).agg(F.max_by(cut, F.struct(gain, -F.col(value))).alias("_cut"))
    return best.filter(F.col("_cut").isNotNull()).select(*by, "_cut.*")


def random_split(keys: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Keys with is_first: the floor(fraction * rows + 0.5) rows of least seeded hash. Rows must differ; reruns agree."""
    order = [F.xxhash64(F.lit(seed), *keys.columns), *keys.columns]
    placed = cumulative(keys, [F.asc(c) if isinstance(c, str) else c.asc() for c in order], {"_before": F.lit(1)})
    rows = keys.agg(F.floor(fraction * F.count("*") + 0.5).alias("_most"))
    return placed.crossJoin(F.broadcast(rows)).select(*keys.columns, (F.col("_before") < F.col("_most")).alias("is_first"))
