"""Window and segment features of several lengths, signal checks of channels, and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions import guarded_corr, ratio, rms
from gapwise.operators.evaluate import auc
from gapwise.operators.order import cumulative, following, lagged, quantiles
from gapwise.operators.segments import hop_windows, in_segment, spectrum

#: Columns that name a window or tell what it is; no model's input.
META = frozenset("src seg_id pos win n ts label state fold block grade".split())


def feature_columns(frame: DataFrame) -> list[str]:
    """Columns that models may take: all but META."""
    return [c for c in frame.columns if c not in META]


def frame_autocorrelation(x: str, first: int, last: int, least: int = 4) -> Column:
    """Lag-1 autocorrelation (biased, mean-removed) of the rows of a segment from ``first`` to ``last`` around each row; null below ``least`` rows or without spread.

    From sums over the frame: products of neighbours, less the mean's share of them.
    """
    seg = in_segment()
    f = seg.rowsBetween(first, last)
    v, n = F.col(x), F.count(x).over(f)
    after = F.when(F.lead("pos").over(seg) == F.col("pos") + 1, F.lead(x).over(seg))
    pairs = seg.rowsBetween(first, last - 1)
    mean = F.avg(v).over(f)
    top = F.sum(v * after).over(pairs) - mean * (F.sum(F.when(after.isNotNull(), v)).over(pairs) + F.sum(after).over(pairs)) + mean * mean * F.count(after).over(pairs)
    return F.when((n >= least) & (F.max(v).over(f) > F.min(v).over(f)), ratio(top, n * F.var_pop(v).over(f)))


def window_features(segments: DataFrame, wins: Sequence[int], step: int, a: str = "ch0", b: str = "ch1") -> DataFrame:
    """One row per window of each length: amplitudes of both channels, their ratio, correlation and autocorrelation in the window and from the segment's start.

    All lengths share one pass over the samples, and one sort of the segment. A segment shorter than a window has no row of that length.
    """
    made = {}
    for win in wins:
        f = in_segment().rowsBetween(0, win - 1)
        so_far = in_segment().rowsBetween(Window.unboundedPreceding, win - 1)
        x, y = rms(a, f), rms(b, f)
        made[f"_w{win}"] = {
            "rms0": x, "rms1": y, "peak0": F.max(F.abs(F.col(a))).over(f), "p2p0": F.max(a).over(f) - F.min(a).over(f), "rms_ratio": ratio(x, y),
            "corr_win": guarded_corr(F.col(a), F.col(b), over=f), "ac1_win": frame_autocorrelation(a, 0, win - 1), "corr_cum": guarded_corr(F.col(a), F.col(b), over=so_far),
        }
    own = segments.select("src", "seg_id", "pos", "n", *(c.alias(f"{w}_{k}") for w, columns in made.items() for k, c in columns.items()))
    rows = [F.struct(F.lit(win).alias("win"), *(F.col(f"_w{win}_{k}").alias(k) for k in made[f"_w{win}"])) for win in wins]
    own = own.filter((F.col("pos") % step == 0) & (F.col("pos") + min(wins) <= F.col("n"))).select("src", "seg_id", "pos", "n", F.explode(F.array(*rows)).alias("_r"))
    return own.select("src", "seg_id", "pos", "n", "_r.*").filter(F.col("pos") + F.col("win") <= F.col("n"))


def full_windows(segments: DataFrame, win: int, step: int, channels: Sequence[str] = ("ch0", "ch1")) -> DataFrame:
    """One row per window with all features of both channels: those of hop_windows(), the ratio of their RMS, and correlation and lag-1 autocorrelation in the window and from the segment's start.

    All frames share one sort of the segment.
    """
    a, b = channels
    inside, so_far = in_segment().rowsBetween(0, win - 1), in_segment().rowsBetween(Window.unboundedPreceding, win - 1)
    more = {
        "corr_win": guarded_corr(F.col(a), F.col(b), over=inside), "corr_cum": guarded_corr(F.col(a), F.col(b), over=so_far),
        **{f"{c}_ac1_win": frame_autocorrelation(c, 0, win - 1) for c in channels}, **{f"{c}_ac1_cum": frame_autocorrelation(c, Window.unboundedPreceding, win - 1) for c in channels},
    }
    made = hop_windows(segments, win, step, tuple(channels), more)
    return made.withColumn("rms_ratio", ratio(F.col(f"{a}_rms"), F.col(f"{b}_rms")))


def low_frequency_share(segments: DataFrame, channel: str, below: float) -> DataFrame:
    """src, seg_id, share: how much of the power of a segment's spectrum lies in bins of up to ``below`` cycles a sample; null without power."""
    own = spectrum(segments, channel).join(segments.groupBy("src", "seg_id").agg(F.count("*").alias("_n")), ["src", "seg_id"])
    power = F.col("amplitude") * F.col("amplitude")
    return own.groupBy("src", "seg_id").agg(ratio(F.sum(F.when(F.col("k") <= below * F.col("_n"), power).otherwise(0.0)), F.sum(power)).alias("share"))


def resolution(samples: DataFrame, x: str, by: str = "src") -> DataFrame:
    """Per group: range of a channel, the least step between its values, and the bits that a code of such steps takes for the range; null without a step."""
    distinct = samples.filter(F.col(x).isNotNull()).select(by, F.col(x).alias("v")).distinct()
    steps = lagged(distinct, ["v"], "v", "_before", [by]).withColumn("_step", F.col("v") - F.col("_before"))
    own = steps.groupBy(by).agg((F.max("v") - F.min("v")).alias("range"), F.min("_step").alias("step"))
    return own.withColumn("bits", F.when(F.col("step") > 0, F.ceil(F.log2(F.col("range") / F.col("step") + 1) - 1e-9)))


def segment_features(segments: DataFrame, x: str = "ch0") -> DataFrame:
    """One row per segment: n, start, rms, peak, mean (dc), crest and excess kurtosis (null up to 3 samples or without spread) of a channel as it is."""
    v = F.col(x)
    return segments.groupBy("src", "seg_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("start"), rms(x).alias("rms"), F.max(F.abs(v)).alias("peak"), F.avg(v).alias("dc"), ratio(F.max(F.abs(v)), rms(x)).alias("crest"),
        F.when((F.count("*") > 3) & (F.max(v) > F.min(v)), F.kurtosis(v)).alias("kurt"),
    )


def suspects(table: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """Rows for which a criterion holds, and which, joined by +."""
    flags = [F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in criteria.items()]
    return table.withColumn("criteria", F.concat_ws("+", *flags)).filter("criteria != ''")


def state_summary(table: DataFrame, state: str, values: Sequence[str]) -> DataFrame:
    """Per state: rows, their share of all, and means of values."""
    own = table.groupBy(state).agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))
    return own.crossJoin(F.broadcast(table.agg(F.count("*").alias("_all")))).select(state, "n", (F.col("n") / F.col("_all")).alias("share"), *values)


def feature_auc(table: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """feature, auc of each feature taken alone, and the larger of it and 1 - auc; null if there is one class only."""
    own = table.select(F.col(label).alias("label"), *(F.col(c).cast("double").alias(c) for c in features)).unpivot("label", list(features), "feature", "score")
    return auc(own, ["feature"]).select("feature", "auc", F.greatest("auc", 1 - F.col("auc")).alias("symmetric"), "n_pos", "n_neg")


def autocorrelations(segments: DataFrame, x: str, most: int) -> DataFrame:
    """src, seg_id, lag, value: biased autocorrelation of a channel at lags 0 to ``most``; null without spread."""
    w = Window.partitionBy("src", "seg_id")
    own = segments.select("src", "seg_id", "pos", (F.col(x) - F.avg(x).over(w)).alias("y"))
    sums = own.select("src", "seg_id", *((F.col("y") * F.lag("y", k).over(w.orderBy("pos"))).alias(f"p{k}") for k in range(most + 1)))
    made = sums.groupBy("src", "seg_id").agg(*(F.sum(f"p{k}").alias(f"s{k}") for k in range(most + 1)))
    lags = F.array(*(F.struct(F.lit(k).alias("lag"), ratio(F.coalesce(F.col(f"s{k}"), F.lit(0.0)), F.col("s0")).alias("value")) for k in range(most + 1)))
    return made.select("src", "seg_id", F.explode(lags).alias("z")).select("src", "seg_id", "z.*")


def value_steps(samples: DataFrame, x: str, by: str = "src") -> DataFrame:
    """Per group: distinct values of a channel, the least and the 1 % quantile of the steps between neighbours of them, and whether all survive as floats."""
    distinct = samples.filter(F.col(x).isNotNull()).select(by, F.col(x).alias("v")).distinct()
    steps = distinct.withColumn("step", F.col("v") - F.lag("v").over(Window.partitionBy(by).orderBy("v")))
    own = steps.groupBy(by).agg(F.count("*").alias("n_values"), F.min("step").alias("min_step"), F.bool_and(F.col("v").cast("float").cast("double") == F.col("v")).alias("float_exact"))
    return own.join(quantiles(steps, "step", [0.01], [by], ["p1_step"]), by, "left")


def clipping(samples: DataFrame, x: str, by: str = "src", share: float = 0.99) -> DataFrame:
    """Per group: the largest magnitude of a channel, samples at it, and at ``share`` of it or more."""
    top = samples.groupBy(by).agg(F.max(F.abs(F.col(x))).alias("top"))
    at = F.abs(F.col(x))
    return samples.join(top, by).groupBy(by).agg(F.max("top").alias("top"), F.count_if(at == F.col("top")).alias("n_top"), F.count_if(at >= share * F.col("top")).alias("n_near"))


def decimals(samples: DataFrame, x: str, by: str = "src") -> DataFrame:
    """Per group: the most frequent number of digits after the point of a channel's values (of ties the least), its share, and the range."""
    from gapwise.operators.clean import decimal_places

    counts = samples.filter(F.col(x).isNotNull()).groupBy(by, decimal_places(F.col(x)).alias("d")).agg(F.count("*").alias("k"))
    best = F.max(F.struct("k", (-F.col("d")).alias("d")))
    return counts.groupBy(by).agg((-best["d"]).alias("mode"), (best["k"] / F.sum("k")).alias("share"), F.min("d").alias("least"), F.max("d").alias("most"))


def offset_constancy(segments: DataFrame, x: str = "ch0") -> DataFrame:
    """Per segment: R2 of a line through a channel, and the difference of its halves' means over its standard deviation (population); null without spread."""
    v, p = F.col(x), F.col("pos").cast("double")
    own = segments.groupBy("src", "seg_id").agg(
        guarded_corr(p, v, 3).alias("c"), F.avg(F.when(F.col("pos") < F.col("n") / 2, v)).alias("a"), F.avg(F.when(F.col("pos") >= F.col("n") / 2, v)).alias("b"), F.stddev_pop(v).alias("sd"),
    )
    return own.select("src", "seg_id", (F.col("c") * F.col("c")).alias("r2"), ratio(F.col("b") - F.col("a"), F.col("sd")).alias("half_shift"))


def filled(segments: DataFrame, x: str, method: str = "linear") -> DataFrame:
    """Null samples of a segment filled: by 0, or by a line between the known ones around them (the nearest at an end)."""
    w = in_segment()
    if method == "zero":
        return segments.withColumn("filled", F.coalesce(F.col(x), F.lit(0.0)))
    known = segments.withColumn("_known", F.when(F.col(x).isNotNull(), F.struct("pos", F.col(x).alias("v"))))
    a = F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.coalesce("_known", following("_known", ["src", "seg_id"], ["pos"]))
    own = known.withColumn("_a", a).withColumn("_b", b).drop("_known")
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * ratio(F.col("pos") - F.col("_a.pos"), F.col("_b.pos") - F.col("_a.pos"))
    return own.withColumn("filled", F.coalesce(F.col(x), line, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")


def masked_reconstruction(segments: DataFrame, x: str, masked: Column, method: str) -> DataFrame:
    """One row: samples that were masked and filled again, R2 of what came back, and its RMSE over their standard deviation; null without spread."""
    own = filled(segments.withColumn("_m", masked).withColumn("_x", F.when(~F.col("_m"), F.col(x))), "_x", method).filter(F.col("_m") & F.col("filled").isNotNull())
    sse, sst = F.sum(F.pow(F.col(x) - F.col("filled"), 2)), F.var_pop(x) * F.count("*")
    return own.agg(F.count("*").alias("n"), (1 - ratio(sse, sst)).alias("r2"), ratio(F.sqrt(sse / F.count("*")), F.stddev_pop(x)).alias("nrmse"))


def row_deciles(samples: DataFrame, x: str, parts: int = 10) -> DataFrame:
    """Per stream and part of equal count in time order: rows, mean and RMS of a channel. A busy stream spans many tasks."""
    own = cumulative(samples.select("src", "ts", "event_id", x), [F.col("ts"), F.col("event_id")], {"_i": F.lit(1)}, ["src"])
    sizes = samples.groupBy("src").agg(F.count("*").alias("_n"))
    own = own.join(sizes, "src").withColumn("part", F.floor(F.col("_i") * parts / F.col("_n")).cast("int"))
    return own.groupBy("src", "part").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), rms(x).alias("rms"))
