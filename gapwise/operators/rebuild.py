"""Rebuilding what was taken out: runs within segments, and whole segments from their neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions import ratio
from gapwise.operators.features import filled
from gapwise.operators.periodic import sine_fit
from gapwise.operators.series import cubic_filled

METHODS = ("zero", "linear", "cubic", "sine")


def filled_by(segments: DataFrame, x: str, method: str, seconds: Column) -> DataFrame:
    """Segments with filled: null samples by 0, a line, a cubic spline, or the sine that fits the known ones best (null where there is no fit)."""
    if method in ("zero", "linear"):
        return filled(segments, x, method)
    if method == "cubic":
        return cubic_filled(segments, x, seconds)
    if method != "sine":
        raise ValueError(f"unknown method {method}")
    own = segments.withColumn("_t", seconds.cast("double"))
    fits = sine_fit(own, x, F.col("_t")).select("src", "seg_id", *(F.col(c).alias(f"_{c}") for c in ("freq", "amp", "phase", "offset")))
    first = own.filter(F.col(x).isNotNull() & F.col("_t").isNotNull()).groupBy("src", "seg_id").agg(F.min_by("_t", "pos").alias("_t0"))
    both = own.join(fits, ["src", "seg_id"], "left").join(first, ["src", "seg_id"], "left")
    wave = F.col("_amp") * F.sin(2 * math.pi * F.col("_freq") * (F.col("_t") - F.col("_t0")) + F.col("_phase")) + F.col("_offset")
    return both.select(*segments.columns, F.coalesce(F.col(x), wave).alias("filled"))


def masked_runs(segments: DataFrame, channels: Sequence[str], lengths: Sequence[int], methods: Sequence[str], seconds: Column, context: int = 5) -> DataFrame:
    """k, method, channel, n_segments, n, r2, nrmse: the middle k samples of each segment taken out and filled again.

    Segments with ``context`` samples or more on either side take part. Channels lose their segment's mean first, so
    that 0 is a fair guess. R2 and RMSE are of all samples taken out together, over their own deviation; samples that
    a method doesn't fill are left out. A length that no segment has has no row.
    """
    out = None
    means = segments.groupBy("src", "seg_id").agg(*(F.avg(c).alias(f"_m_{c}") for c in channels))
    own = segments.withColumn("_s", seconds.cast("double")).join(means, ["src", "seg_id"]).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in channels})
    for k in lengths:
        start = F.floor((F.col("n") - k) / 2)
        some = own.filter(F.col("n") >= k + 2 * context).withColumn("_gone", (F.col("pos") >= start) & (F.col("pos") < start + k))
        for c in channels:
            known = some.select("src", "seg_id", "pos", "n", "_s", "_gone", F.col(c).alias("_true"), F.when(~F.col("_gone"), F.col(c)).alias("_x"))
            for m in methods:
                made = filled_by(known, "_x", m, F.col("_s")).filter("_gone and filled is not null and _true is not null")
                sse, n = F.sum(F.pow(F.col("_true") - F.col("filled"), 2)), F.count("*")
                row = made.agg(F.countDistinct("src", "seg_id").alias("n_segments"), n.alias("n"), (1 - ratio(sse, F.var_pop("_true") * n)).alias("r2"), ratio(F.sqrt(sse / n), F.stddev_pop("_true")).alias("nrmse"))
                row = row.filter("n > 0").select(F.lit(k).alias("k"), F.lit(m).alias("method"), F.lit(c).alias("channel"), "*")
                out = row if out is None else out.unionByName(row)
    return out


def neighbours(segments: DataFrame, x: str, seconds: Column, least: int) -> DataFrame:
    """src, seg_id, n and, of the segments before and after, when and where they end and begin (before_t, before_x, after_t, after_x); all three have ``least`` samples or more."""
    own = segments.select("src", "seg_id", "pos", seconds.cast("double").alias("t"), F.col(x).cast("double").alias("x"))
    ends = own.groupBy("src", "seg_id").agg(
        F.count("*").alias("n"), F.min_by("t", "pos").alias("t0"), F.min_by("x", "pos").alias("x0"), F.max_by("t", "pos").alias("t1"), F.max_by("x", "pos").alias("x1")
    ).filter(F.col("n") >= least)
    before = ends.select("src", (F.col("seg_id") + 1).alias("seg_id"), F.col("t1").alias("before_t"), F.col("x1").alias("before_x"))
    after = ends.select("src", (F.col("seg_id") - 1).alias("seg_id"), F.col("t0").alias("after_t"), F.col("x0").alias("after_x"))
    return ends.select("src", "seg_id", "n", F.col("t0").alias("first_t")).join(before, ["src", "seg_id"]).join(after, ["src", "seg_id"])


def _errors(guessed: DataFrame, method: str) -> DataFrame:
    """src, seg_id, method, span, gap, n, sse, sst of samples (x, guess), both without their segment's mean."""
    means = guessed.groupBy("src", "seg_id").agg(F.avg("x").alias("_mx"), F.avg("guess").alias("_mg"))
    own = guessed.join(means, ["src", "seg_id"])
    y = F.col("x") - F.col("_mx")
    return own.groupBy("src", "seg_id").agg(
        F.lit(method).alias("method"), F.max("span").alias("span"), F.max("gap").alias("gap"), F.count("*").alias("n"),
        F.sum(F.pow(y - F.col("guess") + F.col("_mg"), 2)).alias("sse"), F.sum(y * y).alias("sst"),
    )


def held_out(segments: DataFrame, x: str, seconds: Column, methods: Sequence[str] = ("zero", "linear"), least: int = 10) -> DataFrame:
    """src, seg_id, method, span, gap, n, sse, sst: each segment between two others rebuilt from these alone.

    zero guesses no wave, linear a line from the last sample before to the first one after, sine a wave of one
    frequency through both neighbours, each with an offset of its own. What is compared are the samples without their
    segment's mean. span is from the end of the one before to the start of the one after, gap the silence before.
    Neighbours are those of the next lower and higher seg_id of the stream, found by joins on that key; all three must
    have ``least`` samples. Null samples are left out.
    """
    unknown = set(methods) - {"zero", "linear", "sine"}
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    around = neighbours(segments, x, seconds, least)
    own = segments.select("src", "seg_id", "pos", seconds.cast("double").alias("t"), F.col(x).cast("double").alias("x"))
    between = own.join(around, ["src", "seg_id"]).filter("x is not null").withColumns({"span": F.col("after_t") - F.col("before_t"), "gap": F.col("first_t") - F.col("before_t")})
    out = None
    for m in methods:
        if m == "sine":
            made = _errors(_waves(own, between), m)
        else:
            line = F.col("before_x") + (F.col("after_x") - F.col("before_x")) * ratio(F.col("t") - F.col("before_t"), F.col("span"))
            made = _errors(between.withColumn("guess", F.lit(0.0) if m == "zero" else line), m)
        out = made if out is None else out.unionByName(made)
    return out


def joint_sine(t: np.ndarray, x: np.ndarray, part: np.ndarray, low: float, high: float, coarse: int = 400, fine: int = 41) -> tuple[float, float, float]:
    """Frequency and sine and cosine weights of the wave that leaves least of two parts with an offset each."""

    def fit(freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = 2 * math.pi * np.outer(freqs, t)
        waves = np.stack([np.sin(angle), np.cos(angle)], axis=1)
        y = x.copy()
        for p in (0, 1):
            own = part == p
            waves[:, :, own] -= waves[:, :, own].mean(axis=2, keepdims=True)
            y[own] -= y[own].mean()
        gram, right = waves @ waves.transpose(0, 2, 1), waves @ y
        coef = np.einsum("fij,fj->fi", np.linalg.pinv(gram, rcond=1e-9, hermitian=True), right)
        return y @ y - np.einsum("fi,fi->f", coef, right), coef

    grid = np.geomspace(low, high, coarse)
    i = int(np.argmin(fit(grid)[0]))
    near = np.linspace(grid[max(i - 1, 0)], grid[min(i + 1, coarse - 1)], fine)
    left, coef = fit(near)
    j = int(np.argmin(left))
    return float(near[j]), float(coef[j, 0]), float(coef[j, 1])


def _waves(own: DataFrame, between: DataFrame, low: float = 0.01, high: float = 5.0) -> DataFrame:
    """``between`` with guess: the wave through the neighbours, whose samples are joined as arrays; segments fit a task."""
    known = own.filter("x is not null and t is not null")
    arrays = known.groupBy("src", "seg_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t", "x"))).alias("s"))
    before = arrays.select("src", (F.col("seg_id") + 1).alias("seg_id"), F.col("s").alias("a"))
    after = arrays.select("src", (F.col("seg_id") - 1).alias("seg_id"), F.col("s").alias("c"))
    keys = between.select("src", "seg_id").distinct()
    both = keys.join(before, ["src", "seg_id"]).join(after, ["src", "seg_id"]).select(
        "src", "seg_id", F.concat(F.transform("a", lambda z: z["t"]), F.transform("c", lambda z: z["t"])).alias("t"),
        F.concat(F.transform("a", lambda z: z["x"]), F.transform("c", lambda z: z["x"])).alias("x"), F.size("a").alias("k"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = []
            for t, x, k in zip(rows["t"], rows["x"], rows["k"], strict=True):
                t = np.asarray(t, float)
                got.append((t[0], *joint_sine(t - t[0], np.asarray(x, float), (np.arange(len(t)) >= k).astype(int), low, high)))
            yield rows[["src", "seg_id"]].assign(**{c: [g[i] for g in got] for i, c in enumerate(("_t0", "_f", "_a", "_b"))})

    fits = both.mapInPandas(run, "src long, seg_id long, _t0 double, _f double, _a double, _b double")
    angle = 2 * math.pi * F.col("_f") * (F.col("t") - F.col("_t0"))
    return between.join(fits, ["src", "seg_id"]).withColumn("guess", F.col("_a") * F.sin(angle) + F.col("_b") * F.cos(angle))


def by_span(errors: DataFrame, edges: Sequence[float]) -> DataFrame:
    """method, span_from, n_segments, n, r2, nrmse of held_out() by span: from an edge up to the next one; spans outside all edges are left out."""
    bin_ = F.lit(None).cast("double")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        bin_ = F.when((F.col("span") >= lo) & (F.col("span") < hi), float(lo)).otherwise(bin_)
    own = errors.withColumn("span_from", bin_).filter("span_from is not null")
    sse, sst, n = F.sum("sse"), F.sum("sst"), F.sum("n")
    return own.groupBy("method", "span_from").agg(F.count("*").alias("n_segments"), n.alias("n"), (1 - ratio(sse, sst)).alias("r2"), ratio(F.sqrt(sse / n), F.sqrt(sst / n)).alias("nrmse"))


def phase_steps(segments: DataFrame, fits: DataFrame, x: str, seconds: Column, least: int = 10) -> DataFrame:
    """src, seg_id, gap, phase_error, r2_forward of each segment after another: whether its wave goes on from the one before.

    The earlier segment's frequency and phase (from ``fits``) are carried over the silence. phase_error is the phase of
    the later segment's best wave of that frequency, less the one carried on, between -pi and pi; r2_forward is of the
    carried wave against the later segment, both without their means. Both segments must have ``least`` known samples.
    """
    own = segments.select("src", "seg_id", "pos", seconds.cast("double").alias("t"), F.col(x).cast("double").alias("x")).filter("x is not null and t is not null")
    ends = own.groupBy("src", "seg_id").agg(F.count("*").alias("n"), F.min_by("t", "pos").alias("t0"), F.max_by("t", "pos").alias("t1")).filter(F.col("n") >= least)
    earlier = ends.join(fits.filter("freq is not null").select("src", "seg_id", "freq", "amp", "phase"), ["src", "seg_id"])
    earlier = earlier.select("src", (F.col("seg_id") + 1).alias("seg_id"), F.col("t0").alias("a0"), F.col("t1").alias("a1"), "freq", "amp", "phase")
    both = own.join(earlier, ["src", "seg_id"]).join(ends.select("src", "seg_id", "t0"), ["src", "seg_id"])
    angle = 2 * math.pi * F.col("freq") * (F.col("t") - F.col("a0")) + F.col("phase")
    both = both.withColumns({"s": F.sin(angle), "c": F.cos(angle)})
    # least squares of x on sine, cosine and a constant, by sums; the carried wave is the sine alone
    sums = both.groupBy("src", "seg_id").agg(
        (F.max("t0") - F.max("a1")).alias("gap"), F.max("amp").alias("amp"), F.count("*").alias("n"), F.var_pop("s").alias("ss"), F.var_pop("c").alias("cc"), F.covar_pop("s", "c").alias("sc"),
        F.covar_pop("s", "x").alias("sx"), F.covar_pop("c", "x").alias("cx"), F.var_pop("x").alias("xx"),
    )
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    a, b = F.col("cc") * F.col("sx") - F.col("sc") * F.col("cx"), F.col("ss") * F.col("cx") - F.col("sc") * F.col("sx")
    left = F.col("xx") - 2 * F.col("amp") * F.col("sx") + F.col("amp") * F.col("amp") * F.col("ss")
    return sums.select("src", "seg_id", "gap", F.when(det > 1e-12, F.atan2(b, a)).alias("phase_error"), (1 - ratio(left, F.col("xx"))).alias("r2_forward"))
