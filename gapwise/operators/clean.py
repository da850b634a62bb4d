"""Cleaning of sample streams: formats, offsets, differences and scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.operators.order import quantiles
from gapwise.operators.segments import in_segment


def unify_format(samples: DataFrame, channel: str, quantised: str, digits: int, step: float) -> DataFrame:
    """One channel rounded half to even, another put on a grid of ``step``."""
    return samples.withColumn(channel, F.bround(channel, digits)).withColumn(quantised, F.rint(F.col(quantised) / step) * step)


def remove_offset(segments: DataFrame, channel: str, method: str, baseline: float | None = None) -> DataFrame:
    """Adds clean, and offset, which was taken away: mean, expanding (mean so far), detrend (line per segment; mean below 3 samples) or baseline (a constant)."""
    x, seg = F.col(channel), Window.partitionBy("src", "seg_id")
    if method == "mean":
        offset = F.avg(x).over(seg)
    elif method == "expanding":
        offset = F.avg(x).over(in_segment().rowsBetween(Window.unboundedPreceding, 0))
    elif method == "detrend":
        pos = F.col("pos").cast("double")
        mx, mp = F.avg(x).over(seg), F.avg(pos).over(seg)
        slope = (F.avg(x * pos).over(seg) - mx * mp) / F.nullif(F.avg(pos * pos).over(seg) - mp * mp, F.lit(0.0))
        offset = F.when(F.col("n") >= 3, mx + slope * (pos - mp)).otherwise(mx)
    elif method == "baseline":
        offset = F.lit(baseline)
    else:
        raise ValueError(method)
    return segments.withColumn("offset", offset).withColumn("clean", x - F.col("offset"))


def fit_baseline(segments: DataFrame, channel: str, least: int = 17) -> float | None:
    """Median of the means of segments of ``least`` samples or more."""
    means = segments.groupBy("src", "seg_id").agg(F.avg(channel).alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least)
    found = quantiles(means, "m", [0.5]).first()
    return None if found is None else found[0]


def first_difference(segments: DataFrame, *channels: str) -> DataFrame:
    """Difference to the sample before in the segment; 0 for the first."""
    w = in_segment()
    return segments.withColumns({f"{c}_diff": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in channels})


def standardised(frame: DataFrame, train: Column, *channels: str) -> DataFrame:
    """Channels less the training rows' mean over their population standard deviation (1e-6 at least)."""
    stats = frame.filter(train).agg(*(f(c).alias(f"_{n}_{c}") for c in channels for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    own = frame.crossJoin(F.broadcast(stats))  # one row
    return own.select(*frame.columns, *(((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(1e-6))).alias(f"{c}_z") for c in channels))


def min_max_scaled(frame: DataFrame, train: Column, channel: str) -> DataFrame:
    """Channel on the training rows' range, not clipped."""
    stats = frame.filter(train).agg(F.min(channel).alias("_lo"), F.max(channel).alias("_hi"))
    return frame.crossJoin(F.broadcast(stats)).withColumn(f"{channel}_scaled", (F.col(channel) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).drop("_lo", "_hi")


def imputed(frame: DataFrame, train: Column, *channels: str) -> DataFrame:
    """Nulls of channels filled by the training rows' median."""
    own = frame
    for c in channels:
        own = own.join(F.broadcast(quantiles(frame.filter(train), c, [0.5], names=[f"_f_{c}"])), how="left")  # one row, or none
    return own.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in channels}).drop(*(f"_f_{c}" for c in channels))


def window_z(segments: DataFrame, channel: str, win: int) -> DataFrame:
    """z-score of a sample within the ``win`` samples that begin with it; 0 without spread."""
    f = in_segment().rowsBetween(0, win - 1)
    z = (F.col(channel) - F.avg(channel).over(f)) / F.nullif(F.stddev_pop(channel).over(f), F.lit(0.0))
    return segments.withColumn("z", F.coalesce(z, F.lit(0.0)))


def decimal_places(x: Column) -> Column:
    """Digits after the point of a printed number."""
    text = F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)


def labelled_bins(x: Column, edges: list[float], labels: list[str], right_closed: bool = True) -> Column:
    """Label of the bin that x falls in, null outside."""
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (x > lo) & (x <= hi) if right_closed else (x >= lo) & (x < hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out
