"""Faults put into segments with all that follows from them: features anew, detection, and which channel is blamed; comparisons of systems by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions import ratio, rms
from gapwise.functions.storage import written
from gapwise.operators.evaluate import auc
from gapwise.operators.models import injected
from gapwise.operators.order import quantiles

#: Channels (first, second) that a fault of a kind may be blamed on.
EXPECTED = {"amplitude": (True, False), "antiphase": (True, False), "spike": (True, False), "noise": (True, False), "current": (False, True)}


def faulty(segments: DataFrame, kinds: Sequence[str], strengths: Sequence[float], a: str, b: str, every: int = 10, seed: int = 0) -> DataFrame:
    """Segments once for each kind and strength (columns kind, strength), with the fault in its channel, both without their segment's mean again.

    amplitude scales ``a``, antiphase mixes it with the negative of ``b``, spike adds a hundred strengths to one sample
    in ``every``, noise a normal deviate of that size by a hash of the sample's key, current scales ``b``. Grids are
    parameters, so that rows grow by a constant.
    """
    unknown = set(kinds) - set(EXPECTED)
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    out = None
    for kind in kinds:
        for s in strengths:
            if kind == "spike":
                own = segments.withColumn(a, F.col(a) + F.when(F.col("pos") % every == every // 2, 100.0 * s).otherwise(0.0))
            elif kind == "current":
                own = segments.withColumn(b, F.col(b) * (1 + s))
            else:
                own = injected(segments, kind, 100.0 * s if kind == "noise" else s, a, b, seed).withColumn(a, F.col(f"{a}_injected")).drop(f"{a}_injected")
            own = own.withColumns({"kind": F.lit(kind), "strength": F.lit(float(s))})
            out = own if out is None else out.unionByName(own)
    return centred(out, [a, b], ["kind", "strength", "src", "seg_id"])


def centred(segments: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("src", "seg_id")) -> DataFrame:
    w = Window.partitionBy(*keys)
    return segments.withColumns({c: F.col(c) - F.avg(c).over(w) for c in channels})


def amplitude_windows(segments: DataFrame, channels: Sequence[str], win: int, step: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, src, seg_id, pos and <channel>_rms, _peak, _p2p of every window of ``win`` samples, as hop_windows() has them, of any number of versions of the segments."""
    w = Window.partitionBy(*keys, "src", "seg_id").orderBy("pos").rowsBetween(0, win - 1)
    columns = []
    for c in channels:
        columns += [rms(c, w).alias(f"{c}_rms"), F.max(F.abs(F.col(c))).over(w).alias(f"{c}_peak"), (F.max(c).over(w) - F.min(c).over(w)).alias(f"{c}_p2p")]
    own = segments.select(*keys, "src", "seg_id", "pos", "n", *columns)
    return own.filter((F.col("pos") % step == 0) & (F.col("pos") + win <= F.col("n"))).drop("n")


def fault_table(clean: DataFrame, versions: DataFrame, train: Column, test: Column, abnormal: Column, channels: Sequence[str], q: float, strength: Sequence[str] = ("kind", "strength")) -> DataFrame:
    """kind, strength, n, n_caution, n_alarm, retention, hit_rate, median_z1, median_z2 of windows with faults, beside the real abnormal ones (kind real, strength null).

    ``clean`` and ``versions`` are amplitude_windows() of the segments as they are and with faults. z1 and z2 are the
    channels' RMS over the ``q`` quantile of the training windows; caution is either above 1, alarm both, retention the
    share of cautions that are alarms. Of the windows with caution, hit_rate is the share in which the feature that
    departs furthest from the training windows, in their deviations, is of a channel that the kind's fault is in.
    """
    a, b = channels
    own = written(clean.withColumn("_train", train).withColumn("_real", abnormal))
    fitted = own.filter("_train")
    limits = quantiles(fitted, f"{a}_rms", [q], names=["_q1"]).crossJoin(quantiles(fitted, f"{b}_rms", [q], names=["_q2"]))
    features = [f"{c}_{f}" for c in channels for f in ("rms", "peak", "p2p")]
    stats = fitted.agg(*(F.avg(f).alias(f"_m_{f}") for f in features), *(F.stddev_pop(f).alias(f"_s_{f}") for f in features))
    real = own.filter("_real").select(F.lit("real").alias("kind"), F.lit(None).cast("double").alias("strength"), *features)
    every = versions.filter(test).select(*strength, *features).unionByName(real).crossJoin(F.broadcast(limits)).crossJoin(F.broadcast(stats))  # one row each
    z1, z2 = F.col(f"{a}_rms") / F.col("_q1"), F.col(f"{b}_rms") / F.col("_q2")

    def away(c: str) -> Column:
        return F.greatest(*(F.coalesce(F.abs(ratio(F.col(f"{c}_{f}") - F.col(f"_m_{c}_{f}"), F.col(f"_s_{c}_{f}"))), F.lit(0.0)) for f in ("rms", "peak", "p2p")))

    blamed = F.when(away(b) > away(a), 1).otherwise(0)
    hit = F.lit(None).cast("boolean")
    for kind, (first, second) in EXPECTED.items():
        hit = F.when(F.col("kind") == kind, F.when(blamed == 1, F.lit(second)).otherwise(F.lit(first))).otherwise(hit)
    caution, alarm = (z1 > 1) | (z2 > 1), (z1 > 1) & (z2 > 1)
    made = every.select("kind", "strength", z1.alias("z1"), z2.alias("z2"), caution.alias("c"), alarm.alias("al"), hit.alias("hit"))
    return made.groupBy("kind", "strength").agg(
        F.count("*").alias("n"), F.count_if("c").alias("n_caution"), F.count_if("al").alias("n_alarm"), ratio(F.count_if("al"), F.count_if("c")).alias("retention"),
        ratio(F.count_if(F.col("c") & F.col("hit")), F.sum(F.when(F.col("hit").isNotNull() & F.col("c"), 1).otherwise(0))).alias("hit_rate"), F.median("z1").alias("median_z1"), F.median("z2").alias("median_z2"),
    )


# Comparisons by segment


def system_comparison(alarms: DataFrame, hours: DataFrame, first: str, second: str) -> DataFrame:
    """n_common, both, only_first, only_second, neither, and false alarms an hour of each system, on the segments that it judges (native) and on those that both do (common).

    ``alarms`` have src, seg_id and a boolean for each system, null where it doesn't judge a segment; ``hours`` a row a stream.
    """
    a, b = F.col(first), F.col(second)
    both = a.isNotNull() & b.isNotNull()
    total = hours.agg(F.sum("hours").alias("_h"))
    own = alarms.agg(
        F.count_if(both).alias("n_common"), F.count_if(a & b).alias("both"), F.count_if(both & a & ~b).alias("only_first"), F.count_if(both & b & ~a).alias("only_second"), F.count_if(both & ~a & ~b).alias("neither"),
        F.count_if(a).alias("_a"), F.count_if(b).alias("_b"), F.count_if(both & a).alias("_ca"), F.count_if(both & b).alias("_cb"),
    ).crossJoin(F.broadcast(total))
    rates = {"native_first": "_a", "native_second": "_b", "common_first": "_ca", "common_second": "_cb"}
    return own.select("n_common", "both", "only_first", "only_second", "neither", *(ratio(F.col(c), F.col("_h")).alias(k) for k, c in rates.items()))


def majority_false_positives(alarms: DataFrame, votes: Sequence[str], suspects: DataFrame) -> DataFrame:
    """src, seg_id, n_votes, share, suspect of normal segments that over half of the systems (boolean columns ``votes``; null doesn't vote) raise an alarm on, and whether they are among the suspects (src, seg_id, a row each or more)."""
    n = sum((F.when(F.col(v).isNotNull(), 1).otherwise(0) for v in votes), F.lit(0))
    k = sum((F.when(F.col(v), 1).otherwise(0) for v in votes), F.lit(0))
    own = alarms.select("src", "seg_id", n.alias("n_votes"), ratio(k, n).alias("share")).filter("share > 0.5")
    listed = suspects.select("src", "seg_id").distinct().withColumn("suspect", F.lit(True))
    return own.join(listed, ["src", "seg_id"], "left").select("src", "seg_id", "n_votes", "share", F.coalesce("suspect", F.lit(False)).alias("suspect"))


def offset_diagnostics(features: DataFrame, least: int = 17, tiny: float = 1e-5, leak: float = 0.8) -> DataFrame:
    """measure, auc, symmetric, leak: how well a segment's offset alone tells its label, as it is, over its RMS, and with magnitudes below ``tiny`` put to 0.

    ``features`` have dc, rms, n, label; segments of fewer than ``least`` samples are left out. leak marks a symmetric
    area above the bound, which a label that was not made from the offset should not reach.
    """
    own = features.filter(F.col("n") >= least).withColumn("abs_dc", F.abs("dc"))
    own = own.withColumns({"abs_dc_over_rms": ratio(F.col("abs_dc"), F.col("rms")), "residual_dc": F.when(F.col("abs_dc") < tiny, 0.0).otherwise(F.col("abs_dc"))})
    long = own.unpivot(["label"], ["abs_dc", "abs_dc_over_rms", "residual_dc"], "measure", "score")
    areas = auc(long, ["measure"])
    symmetric = F.greatest("auc", 1 - F.col("auc"))
    return areas.select("measure", "auc", symmetric.alias("symmetric"), (symmetric > leak).alias("leak"))


def offset_alarms(features: DataFrame, q: float = 0.99, least: int = 17) -> DataFrame:
    """src, seg_id, label, alarm: whether a segment's offset is larger than the ``q`` quantile of the normal ones; null below ``least`` samples."""
    own = features.withColumn("_x", F.when(F.col("n") >= least, F.abs("dc")))
    limit = quantiles(own.filter("label = 0"), "_x", [q], names=["_q"])
    return own.join(F.broadcast(limit), how="left").select("src", "seg_id", "label", (F.col("_x") > F.col("_q")).alias("alarm"))  # one row


def channel_attribution(windows: DataFrame, errors: Sequence[str], hit: Column) -> DataFrame:
    """src, seg_id, n_windows, the median of each channel's error over the windows of a segment in which ``hit`` holds, and the channel of the largest (of equal ones the first)."""
    own = windows.filter(hit).groupBy("src", "seg_id").agg(F.count("*").alias("n_windows"), *(F.median(e).alias(e) for e in errors))
    top, name = F.col(errors[0]), F.lit(errors[0])
    for e in errors[1:]:
        more = F.col(e) > top
        name, top = F.when(more, F.lit(e)).otherwise(name), F.when(more, F.col(e)).otherwise(top)
    return own.withColumn("dominant", name)


def missed(alarms: DataFrame, rules: Sequence[str]) -> DataFrame:
    """category, n: abnormal segments by who misses them: undetermined (no rule judges it), missed_by_all, missed_by_some, found_by_all; null votes don't count."""
    n = sum((F.when(F.col(r).isNotNull(), 1).otherwise(0) for r in rules), F.lit(0))
    k = sum((F.when(F.col(r), 1).otherwise(0) for r in rules), F.lit(0))
    category = F.when(n == 0, "undetermined").when(k == 0, "missed_by_all").when(k < n, "missed_by_some").otherwise("found_by_all")
    return alarms.filter("label = 1").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def threshold_stability(scores: DataFrame, q: float, folds: int) -> DataFrame:
    """n_folds, least, most, relative_range, realised: thresholds of training rows when each fold is left out, how far they spread over their mean, and the mean share of training rows above them."""
    own = scores.filter("label = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("fold != k")
    own = written(own.select("k", "score"))
    thr = quantiles(own, "score", [q], ["k"], ["thr"])
    rates = own.join(F.broadcast(thr), "k").groupBy("k").agg(F.max("thr").alias("thr"), F.avg(F.when(F.col("score") > F.col("thr"), 1.0).otherwise(0.0)).alias("rate"))  # a row a fold
    return rates.agg(F.count("*").alias("n_folds"), F.min("thr").alias("least"), F.max("thr").alias("most"), ratio(F.max("thr") - F.min("thr"), F.avg("thr")).alias("relative_range"), F.avg("rate").alias("realised"))


def finite_scores(frame: DataFrame, score: str) -> DataFrame:
    """The frame; a job that reads it fails if a score is null, not a number or infinite."""
    x = F.col(score)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return frame.filter(F.when(bad, F.raise_error(F.lit(f"{score}: a score that isn't finite")).cast("boolean")).otherwise(True))
