"""Gap segments of sample streams, and what is computed within them.

A sample frame has src, ts, event_id (which breaks ties of time) and channels. All windows of a segment share one
partitioning: a stream is dealt by src, which also satisfies what needs (src, seg_id) together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gapwise.functions import guarded_corr, micros, ratio, rms, shape_stats
from gapwise.operators.order import cumulative, following, lagged

BY_TIME = ("ts", "event_id")


def stream() -> WindowSpec:
    return Window.partitionBy("src").orderBy(*BY_TIME)


def in_segment() -> WindowSpec:
    return Window.partitionBy("src", "seg_id").orderBy("pos")


def gap_segments(samples: DataFrame, gap: float, part: float | None = None) -> DataFrame:
    """Adds dt (seconds since the sample before), seg_id (from 0; a new one where dt > gap), pos (from 0) and n (samples of the segment).

    A stream is cut into parts of ``part`` seconds (a thousand gaps, if none is given), which are sorted and numbered
    on their own, so that a busy stream, and a segment without end, span as many tasks as they have parts. What
    crosses the borders is a row a part: its first and last time, its samples, where its first and last segment
    begins. Samples without a time are a part of their own, the stream's first.
    """
    width = (gap * 1000 if part is None else part) * 1e6
    us = micros("ts")
    own = samples.withColumn("_part", F.coalesce(F.floor(us / width), F.lit(-(1 << 62))))
    w = Window.partitionBy("src", "_part").orderBy(*BY_TIME)
    own = own.withColumn("_us", us).withColumn("_before", F.lag("_us").over(w)).withColumn("_at", F.row_number().over(w).cast("long") - 1)
    step = F.col("_us") - F.col("_before")
    parts = own.groupBy("src", "_part").agg(
        F.count("*").alias("_size"), F.min("_us").alias("_from"), F.max("_us").alias("_to"), F.count_if(step > gap * 1e6).alias("_gaps"),
        F.min(F.when(step > gap * 1e6, F.col("_at"))).alias("_first"), F.max(F.when(step > gap * 1e6, F.col("_at"))).alias("_last"),
    )
    s = Window.partitionBy("src").orderBy("_part")
    earlier = s.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_carried", F.lag("_to").over(s))
    opens = (F.col("_from") - F.col("_carried")) > gap * 1e6  # the part's first sample begins a segment
    parts = parts.withColumn("_opens", F.coalesce(opens, F.lit(False)))
    parts = parts.withColumn("_rows", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    first = F.when(F.col("_opens"), F.col("_rows")).otherwise(F.col("_rows") + F.col("_first"))
    last = F.when(F.col("_last").isNotNull(), F.col("_rows") + F.col("_last")).when(F.col("_opens"), F.col("_rows"))
    parts = parts.withColumns({"_start": first, "_end": last, "_new": F.col("_gaps") + F.col("_opens").cast("long")})
    parts = parts.select(
        "src", "_part", "_carried", "_opens", "_rows", F.coalesce(F.sum("_new").over(earlier), F.lit(0)).alias("_seg"), F.coalesce(F.last("_end", True).over(earlier), F.lit(0)).alias("_open_at"),
        F.coalesce(following("_start", ["src"], ["_part"]), F.sum("_size").over(Window.partitionBy("src"))).alias("_next"),
    )
    # merged where both lie by part: samples whose file is small would be broadcast, and the rest would run in the few tasks that the parts take
    both = own.join(parts.hint("merge"), ["src", "_part"])
    before = F.when(F.col("_at") == 0, F.col("_carried")).otherwise(F.col("_before"))
    begins = F.when(F.col("_at") == 0, F.col("_opens")).otherwise(F.coalesce(step > gap * 1e6, F.lit(False)))
    both = both.withColumn("dt", (F.col("_us") - before) / 1e6).withColumn("_begins", begins)
    at = F.col("_rows") + F.col("_at")
    start = F.coalesce(F.max(F.when(F.col("_begins"), at)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open_at"))
    both = both.withColumn("_begin", F.when(F.col("_begins"), at))
    after = F.coalesce(following("_begin", ["src", "_part"], BY_TIME), F.col("_next"))
    seg = F.col("_seg") + F.sum(F.col("_begins").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.select(*samples.columns, "dt", seg.alias("seg_id"), (at - start).alias("pos"), (after - start).alias("n"))


def segment_table(segments: DataFrame, channel: str = "ch0") -> DataFrame:
    """One row per segment: samples, start, end, duration, sample standard deviation and largest magnitude of a channel."""
    x = F.col(channel)
    return segments.groupBy("src", "seg_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), ((F.max(micros("ts")) - F.min(micros("ts"))) / 1e6).alias("dur"),
        F.stddev_samp(x).alias("sd"), F.max(F.abs(x)).alias("absmax"),
    )


def hop_windows(segments: DataFrame, win: int, step: int, channels: tuple[str, ...] = ("ch0",), more: dict[str, Column] | None = None) -> DataFrame:
    """One row per window of ``win`` samples every ``step``, from each segment's first; no partial one at the end.

    Adds, for each channel, rms, peak, p2p, kurt, crest, skew (population moments, null without spread) and shape_crest.
    ``more`` are further columns over frames of the segment. All frames share one sort of the segment.
    """
    f = in_segment().rowsBetween(0, win - 1)
    columns = [c.alias(k) for k, c in (more or {}).items()]
    for c in channels:
        x = F.col(c)
        kurt, skew = shape_stats(x, f)
        r, peak = rms(x, f), F.max(F.abs(x)).over(f)
        mean, sd = F.avg(x).over(f), F.stddev_pop(x).over(f)
        far = F.greatest(F.max(x).over(f) - mean, mean - F.min(x).over(f))
        columns += [r.alias(f"{c}_rms"), peak.alias(f"{c}_peak"), (F.max(x).over(f) - F.min(x).over(f)).alias(f"{c}_p2p"), kurt.alias(f"{c}_kurt"), ratio(peak, r).alias(f"{c}_crest"), skew.alias(f"{c}_skew"), ratio(far, sd).alias(f"{c}_shape_crest")]
    made = segments.select("src", "seg_id", "pos", "n", "ts", *columns)
    return made.filter((F.col("pos") % step == 0) & (F.col("pos") + win <= F.col("n")))


def relation_windows(segments: DataFrame, win: int, step: int, a: str = "ch0", b: str = "ch1", cumulative: bool = False) -> DataFrame:
    """Correlation of two channels per hop window, or from the segment's start to the window's end."""
    f = in_segment().rowsBetween(Window.unboundedPreceding if cumulative else 0, win - 1)
    made = segments.select("src", "seg_id", "pos", "n", guarded_corr(F.col(a), F.col(b), over=f).alias("corr"))
    return made.filter((F.col("pos") % step == 0) & (F.col("pos") + win <= F.col("n"))).drop("n")


def rolling_rms(segments: DataFrame, channel: str, win: int) -> DataFrame:
    """Moving RMS of the last ``win`` samples of a segment, null until there are as many."""
    r = rms(channel, in_segment().rowsBetween(-(win - 1), 0))
    return segments.withColumn("rolling_rms", F.when(F.col("pos") >= win - 1, r))


def coverage(segments: DataFrame, wins: tuple[int, ...], step: int) -> DataFrame:
    """Per window length: segments, those long enough, the share of others, and windows."""
    sizes = segments.groupBy("src", "seg_id").agg(F.count("*").alias("n"))
    own = sizes.withColumn("win", F.explode(F.array(*map(F.lit, wins))))
    ok = F.col("n") >= F.col("win")
    return own.groupBy("win").agg(
        F.count("*").alias("n_seg"), F.count_if(ok).alias("n_valid"), F.avg(F.when(ok, 0.0).otherwise(1.0)).alias("undetermined"),
        F.sum(F.when(ok, F.floor((F.col("n") - F.col("win")) / step) + 1).otherwise(0)).cast("long").alias("n_windows"),
    )


def time_profile(samples: DataFrame, gap: float) -> DataFrame:
    """Per stream: samples, steps back, zero steps, repeated times, median and mean step within segments."""
    own = samples.withColumn("dt", (micros("ts") - F.lag(micros("ts")).over(Window.partitionBy("src").orderBy("event_id"))) / 1e6)
    inside = F.when((F.col("dt") >= 0) & (F.col("dt") <= gap), F.col("dt"))
    return own.groupBy("src").agg(
        F.count("*").alias("n"), F.count_if(F.col("dt") < 0).alias("n_back"), F.count_if(F.col("dt") == 0).alias("n_zero"),
        (F.count("*") - F.countDistinct("ts")).alias("n_repeated"), F.median(inside).alias("median_dt"), F.avg(inside).alias("mean_dt"),
    )


def state_runs(samples: DataFrame, state: str) -> DataFrame:
    """Run-length encoding of a column along each stream: run (from 0), state, n, start, end. A busy stream spans many tasks."""
    own = lagged(samples.select("src", *BY_TIME, F.col(state).alias("_state")), BY_TIME, "_state", "_before", ["src"])
    own = own.withColumn("_new", F.when(F.col("_before").isNotNull() & (F.col("_before") != F.col("_state")), 1).otherwise(0))
    own = cumulative(own, [F.col(c) for c in BY_TIME], {"_earlier": F.col("_new")}, ["src"])
    runs = own.groupBy("src", (F.col("_earlier") + F.col("_new")).alias("run"))
    return runs.agg(F.min("_state").alias("state"), F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def bursts(segments: DataFrame) -> DataFrame:
    """Per segment its span, the silence before the next one and the duty cycle up to it."""
    own = segments.groupBy("src", "seg_id").agg(F.min(micros("ts")).alias("a"), F.max(micros("ts")).alias("b"))
    w = Window.partitionBy("src").orderBy("seg_id")
    following = F.lead("a").over(w)
    return own.select("src", "seg_id", ((F.col("b") - F.col("a")) / 1e6).alias("span"), ((following - F.col("b")) / 1e6).alias("silence"), ratio((F.col("b") - F.col("a")) / 1e6, (following - F.col("a")) / 1e6).alias("duty"))


def segment_arrays(segments: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Samples of each segment as an ordered array of structs. A segment must fit a task; sequential models alone use it."""
    return segments.groupBy("src", "seg_id").agg(F.sort_array(F.collect_list(F.struct("pos", *channels))).alias("samples"))


def fixed_length(segments: DataFrame, length: int) -> DataFrame:
    """Samples of the segments of exactly ``length`` samples."""
    return segments.filter(F.col("n") == length)


def spectrum(segments: DataFrame, channel: str) -> DataFrame:
    """src, seg_id, k, amplitude: every bin k from 1 to n / 2 of every segment's Fourier transform, 2 / n times its magnitude, without the mean.

    Null samples count in n and add nothing; a segment of nulls only has null amplitudes, one of a single sample no
    row. A segment is one group, as its transform needs all of its samples.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("pos")["x"].to_numpy(float)
        n, known = len(x), ~np.isnan(x)
        k = np.arange(1, n // 2 + 1)
        if known.any():
            a = 2 / n * np.abs(np.fft.rfft(np.where(known, x - x[known].mean(), 0.0)))[k]
        else:
            a = np.full(len(k), np.nan)
        return pd.DataFrame({"src": rows["src"].iloc[0], "seg_id": rows["seg_id"].iloc[0], "k": k, "amplitude": a})

    own = segments.select("src", "seg_id", "pos", F.col(channel).cast("double").alias("x"))
    made = own.groupBy("src", "seg_id").applyInPandas(run, "src long, seg_id long, k long, amplitude double")
    return made.withColumn("amplitude", F.when(~F.isnan("amplitude"), F.col("amplitude")))
