"""Rule baselines by operating state, the standard cleaning pipeline and its variants, replays of scored windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions import ratio
from gapwise.functions.storage import written
from gapwise.operators import evaluate as ev
from gapwise.operators.clean import first_difference, fit_baseline, remove_offset, unify_format
from gapwise.operators.conformal import thresholds
from gapwise.operators.joins import joined
from gapwise.operators.order import cumulative, quantiles, ranked_counts
from gapwise.operators.periodic import two_levels
from gapwise.operators.segments import gap_segments

RULES = ("rms", "rms_state", "rms_state_dir", "rms_state_ratio", "rms_state_dirz", "rms_state_ratioz", "rms_state_dirz_cum")


def rule_scores(windows: DataFrame, train: Column, level: str = "rms0", current: str = "rms1", corr: str = "corr_win", corr_cum: str = "corr_cum", share: str = "rms_ratio", q: float = 0.99) -> DataFrame:
    """``windows`` with state and a score for each of RULES, from the training windows alone.

    state is 1 above the cut of ``current`` in two levels. rms is the level itself; rms_state is over its ``q`` quantile
    in the window's state; dir multiplies by one less the correlation of the channels (null counts as 0), ratio by
    their ratio (null as the training median); dirz and ratioz multiply by one and how far the correlation is below,
    or the ratio above, the median of its state, in interquartile ranges over 1.349 (none for null, 1e-6 at least);
    dirz_cum is dirz of the correlation since the segment's start. Windows with a null current have null scores, but rms.
    """
    own = written(windows.withColumn("_train", F.coalesce(train, F.lit(False))))  # read by each of the fits
    cut = two_levels(own.filter(F.col("_train") & F.col(current).isNotNull()), current).select(F.col("boundary").alias("_cut"))
    own = own.join(F.broadcast(cut), how="left").withColumn("state", (F.col(current) > F.col("_cut")).cast("int"))  # one row
    trained = own.filter(F.col("_train") & F.col("state").isNotNull())
    fits = quantiles(trained, level, [q], ["state"], ["_thr"])
    for name, c in (("c", corr), ("k", corr_cum), ("r", share)):
        got = quantiles(trained, c, [0.25, 0.5, 0.75], ["state"], [f"_{name}1", f"_{name}m", f"_{name}3"])
        spread = (F.col(f"_{name}3") - F.col(f"_{name}1")) / 1.349
        fits = fits.join(got.select("state", f"_{name}m", F.when(spread != 0, spread).otherwise(1e-6).alias(f"_{name}s")), "state", "left")
    overall = quantiles(own.filter("_train"), share, [0.5], names=["_rm_all"])
    own = own.join(F.broadcast(fits), "state", "left").join(F.broadcast(overall), how="left")  # a row a state, one row
    rel = ratio(F.col(level), F.col("_thr"))

    def beyond(column: str, name: str, sign: int) -> Column:
        z = sign * (F.coalesce(F.col(column), F.col(f"_{name}m")) - F.col(f"_{name}m")) / F.col(f"_{name}s")
        return 1 + F.greatest(F.lit(0.0), z)

    scores = (
        F.col(level), rel, rel * (1 - F.coalesce(corr, F.lit(0.0))), rel * F.coalesce(F.col(share), F.col("_rm_all")), rel * beyond(corr, "c", -1), rel * beyond(share, "r", 1), rel * beyond(corr_cum, "k", -1),
    )
    return own.select(*(c for c in windows.columns if c != "state"), "state", *(s.alias(r) for r, s in zip(RULES, scores, strict=True)))


def rule_table(scored: DataFrame, train: Column, test: Column, q: float = 0.99) -> DataFrame:
    """rule, thr, auc, fpr_sample, fpr_segment, n_out_seg, n_detected of rule_scores(): thresholds from the training windows, all else from the test ones.

    All rules go through the same passes, as rows.
    """
    long = written(scored.withColumn("_train", train).withColumn("_test", test)).unpivot(["src", "seg_id", "pos", "label", "_train", "_test"], list(RULES), "rule", "score")
    thr = quantiles(long.filter(F.col("_train")), "score", [q], ["rule"], ["thr"])
    tested = long.filter(F.col("_test")).join(F.broadcast(thr), "rule")  # a row a rule
    hit = F.coalesce(F.col("score") > F.col("thr"), F.lit(False))
    found = tested.filter("label = 1").groupBy("rule", "src", "seg_id").agg(F.bool_or(hit).alias("hit")).groupBy("rule").agg(F.count("*").alias("n_out_seg"), F.count_if("hit").alias("n_detected"))
    rates = ev.false_positive_rates(tested, ["rule"]).drop("n_segments")
    areas = ev.auc(tested, ["rule"]).select("rule", "auc")
    return thr.join(areas, "rule", "left").join(rates, "rule", "left").join(found, "rule", "left")


# Cleaning


def prepared(samples: DataFrame, gap: float, rounded: str, quantised: str, digits: int, step: float, method: str = "mean", baseline: dict[str, float] | None = None) -> DataFrame:
    """The standard pipeline: segments, one format, offsets of both channels removed in place and kept as <channel>_dc."""
    own = unify_format(gap_segments(samples, gap), rounded, quantised, digits, step)
    for c in (rounded, quantised):
        own = remove_offset(own, c, method, (baseline or {}).get(c)).withColumn(f"{c}_dc", F.col("offset")).withColumn(c, F.col("clean")).drop("clean", "offset")
    return own


VARIANTS = ("offline_mean", "fixed_baseline", "first_difference")


def variant(segments: DataFrame, name: str, channels: Sequence[str], train: Column | None = None, least: int = 17) -> DataFrame:
    """Segments with channels as a detector's variant takes them: without their segment's mean, without a constant that the training segments' means give, or as steps from the sample before (0 for the first)."""
    if name == "offline_mean":
        own = segments
        for c in channels:
            own = remove_offset(own, c, "mean").withColumn(c, F.col("clean")).drop("clean", "offset")
        return own
    if name == "fixed_baseline":
        if train is None:
            raise ValueError("fixed_baseline needs the training segments")
        own = segments
        for c in channels:
            own = remove_offset(own, c, "baseline", fit_baseline(segments.filter(train), c, least)).withColumn(c, F.col("clean")).drop("clean", "offset")
        return own
    if name == "first_difference":
        own = first_difference(segments, *channels)
        return own.withColumns({c: F.col(f"{c}_diff") for c in channels}).drop(*(f"{c}_diff" for c in channels))
    raise ValueError(f"unknown variant {name}")


# Replay


def replay(scores: DataFrame, segments: DataFrame, z1: str, z2: str, outlier_fold: int, seconds: float) -> DataFrame:
    """view, src, seg_id, t, fold, label, state, abs_time, relative_sec, stage: windows as they would be shown one after another.

    Normal windows are those of every fold, each tested once; abnormal ones, which every fold tests, are those of
    ``outlier_fold``. A window begins ``t`` * ``seconds`` after its segment's start, which must be known and is a row a
    segment (a job fails otherwise); relative_sec is from the first window of the view. stage is alarm where both
    scores exceed 1, caution where the first one does.
    """
    own = scores.filter((F.col("label") == 0) | (F.col("fold") == outlier_fold)).withColumn("view", F.when(F.col("label") == 0, "normal").otherwise("outlier"))
    meta = segments.select("src", "seg_id", "start", F.col("state").alias("_state"))
    own = joined(own, meta, ["src", "seg_id"])
    start = F.when(F.col("start").isNull(), F.raise_error(F.concat(F.lit("no start of segment "), F.col("src"), F.lit(" "), F.col("seg_id"))).cast("timestamp")).otherwise(F.col("start").cast("timestamp"))
    own = own.withColumn("abs_us", F.unix_micros(start) + F.round(F.col("t") * seconds * 1e6).cast("long"))
    first = own.groupBy("view").agg(F.min("abs_us").alias("_first"))
    own = own.join(F.broadcast(first), "view")  # two rows
    both = F.coalesce(F.least(F.col(z1), F.col(z2)) > 1, F.lit(False)) & F.col(z1).isNotNull() & F.col(z2).isNotNull()
    stage = F.when(both, "alarm").when(F.col(z1) > 1, "caution").otherwise("normal")
    return own.select("view", "src", "seg_id", "t", "fold", "label", F.coalesce("state", "_state").alias("state"), "abs_us", ((F.col("abs_us") - F.col("_first")) / 1e6).alias("relative_sec"), z1, z2, stage.alias("stage"))


def replay_segments(windows: DataFrame, z1: str, z2: str) -> DataFrame:
    """A row per segment of a replay: when it begins, its highest scores and stage."""
    both = F.when(F.col(z1).isNotNull() & F.col(z2).isNotNull(), F.least(F.col(z1), F.col(z2)))
    own = windows.groupBy("view", "fold", "src", "seg_id").agg(F.min("relative_sec").alias("relative_sec"), F.max("label").alias("label"), F.max("state").alias("state"), F.max(z1).alias("first_max"), F.max(z2).alias("second_max"), F.max(both).alias("alarm_max"), F.count("*").alias("n_windows"))
    return own.withColumn("stage", F.when(F.col("alarm_max") > 1, "alarm").when(F.col("first_max") > 1, "caution").otherwise("normal"))


# Conformal levels


def operating_levels(test: DataFrame, calibration: DataFrame, by: str, alphas: Sequence[float]) -> DataFrame:
    """alpha, n_cal, attainable, n_normal, n_false, n_out, n_detected: what conformal thresholds of each level do on test segments (by, score, label), over all groups whose level can be attained.

    All levels are read off one ordered count of the calibration scores.
    """
    counts = ranked_counts(calibration, "score", [by])
    aggs = []
    for a in alphas:
        allowed = F.floor((F.col("total") + 1) * a + 1e-9)
        at = F.col("total") + 1 - allowed
        hit = (F.col("before") < at) & (at <= F.col("before") + F.col("n"))
        aggs.append(F.struct(F.lit(float(a)).alias("alpha"), F.max("total").alias("n_cal"), F.max(F.when(hit, F.col("score"))).alias("thr"), (F.max(allowed) > 0).alias("attainable")))
    levels = counts.groupBy(by).agg(F.array(*aggs).alias("_a")).select(by, F.explode("_a").alias("_l")).select(by, "_l.*")
    own = test.join(levels, by).withColumn("_hit", F.coalesce(F.col("score") > F.col("thr"), F.lit(False)))
    ok = F.col("attainable")
    made = own.groupBy("alpha").agg(
        F.count_if(ok & (F.col("label") == 0)).alias("n_normal"), F.count_if(ok & (F.col("label") == 0) & F.col("_hit")).alias("n_false"),
        F.count_if(ok & (F.col("label") == 1)).alias("n_out"), F.count_if(ok & (F.col("label") == 1) & F.col("_hit")).alias("n_detected"),
    )
    sizes = levels.groupBy("alpha").agg(F.sum(F.when(ok, F.col("n_cal")).otherwise(0)).alias("n_cal"), F.count_if(ok).alias("n_attainable"))
    return made.join(sizes, "alpha").withColumns({"false_rate": ratio(F.col("n_false"), F.col("n_normal")), "detected_rate": ratio(F.col("n_detected"), F.col("n_out"))})


def holdout_cost(segments: DataFrame, q: float, by: str) -> DataFrame:
    """by, fit, thr, n_normal, n_false, n_out, n_detected: a threshold from all training segments (full) beside one from those that calibration leaves (proper).

    ``segments`` have by, score, label, part: train, calibration or test.
    """
    trained = segments.filter((F.col("label") == 0) & F.col("part").isin("train", "calibration"))
    both = trained.select(by, "score", F.lit("full").alias("fit")).unionByName(trained.filter("part = 'train'").select(by, "score", F.lit("proper").alias("fit")))
    thr = quantiles(both, "score", [q], [by, "fit"], ["thr"])
    own = segments.filter("part = 'test'").join(thr, by)
    hit = F.coalesce(F.col("score") > F.col("thr"), F.lit(False))
    return own.groupBy(by, "fit").agg(
        F.max("thr").alias("thr"), F.count_if(F.col("label") == 0).alias("n_normal"), F.count_if((F.col("label") == 0) & hit).alias("n_false"),
        F.count_if(F.col("label") == 1).alias("n_out"), F.count_if((F.col("label") == 1) & hit).alias("n_detected"),
    )


def calibration_study(keys: DataFrame, by: str, fraction: float, alphas: Sequence[float], seeds: Sequence[int]) -> DataFrame:
    """alpha, rule, n_reps, rate_mean, rate_min, rate_max: false alarms of segments (by, src, seg_id, score) where calibration is drawn by seeded hashes, beside the latest ones.

    A draw takes floor(fraction * n + 0.5) segments of each group, one at least. All draws go through the same passes,
    as groups of one table; a draw's rate is over the groups that can attain the level, and n_reps is 0 where none can.
    """
    draws = keys.withColumn("rep", F.explode(F.array(*map(F.lit, [-1, *seeds]))))  # -1: the latest
    order = F.when(F.col("rep") < 0, -F.col("seg_id")).otherwise(F.xxhash64("rep", "src", "seg_id"))
    draws = cumulative(draws.withColumn("_o", order), [F.asc("_o"), F.asc("src"), F.asc("seg_id")], {"_before": F.lit(1)}, [by, "rep"])
    sizes = draws.groupBy(by, "rep").agg(F.greatest(F.lit(1), F.floor(fraction * F.count("*") + 0.5)).alias("_most"))
    draws = draws.join(sizes, [by, "rep"]).withColumn("_cal", F.col("_before") < F.col("_most")).withColumn("_g", F.concat_ws("|", F.col(by).cast("string"), F.col("rep").cast("string")))
    own = operating_levels_by(draws.filter("not _cal"), draws.filter("_cal"), alphas)
    rates = own.groupBy("alpha", "rep").agg(ratio(F.sum("n_false"), F.sum("n_test")).alias("rate"))
    rule = F.when(F.col("rep") < 0, "latest").otherwise("random")
    made = rates.groupBy("alpha", rule.alias("rule")).agg(F.count("rate").alias("n_reps"), F.avg("rate").alias("rate_mean"), F.min("rate").alias("rate_min"), F.max("rate").alias("rate_max"))
    every = keys.sparkSession.createDataFrame([(float(a), r) for a in alphas for r in ("latest", "random")], "alpha double, rule string")
    return every.join(made, ["alpha", "rule"], "left").fillna(0, ["n_reps"])


def operating_levels_by(test: DataFrame, calibration: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """_g, rep, alpha, n_test, n_false of groups that can attain a level."""
    out = None
    for a in alphas:
        thr = thresholds(calibration.select("_g", "score"), "_g", a).filter("attainable")
        made = test.join(thr, "_g").groupBy("_g", "rep").agg(F.count("*").alias("n_test"), F.count_if(F.col("score") > F.col("thr")).alias("n_false")).withColumn("alpha", F.lit(float(a)))
        out = made if out is None else out.unionByName(made)
    return out


def rolled_up(metrics: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means of values by keys, with a row 'all' for each leading part of the keys: the last key over all of its values, and so on up to the first."""
    own = metrics.select(*(F.col(k).cast("string").alias(k) for k in keys), *values)
    grouped = own.rollup(*keys).agg(F.grouping_id().alias("_id"), F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))
    places = len(keys)
    kept = grouped.filter(F.col("_id") < 1 << (places - 1))  # the first key stays apart
    marks = {k: F.when(F.col("_id").bitwiseAND(F.lit(1 << (places - 1 - i))) > 0, "all").otherwise(F.col(k)) for i, k in enumerate(keys)}
    return kept.withColumns(marks).select(*keys, "n", *values)



def verdicts(table: DataFrame, reference: str, slack: float = 0.0) -> DataFrame:
    """rule, d_auc, d_fpr, d_detected, verdict of rule_table() against one of its rows: accept where a rule's area is no lower, and its false alarms no more, by over ``slack``, and one of the two or what it detects is better."""
    own = table.select("rule", "auc", "fpr_segment", "n_detected")
    base = own.filter(F.col("rule") == reference).select(F.col("auc").alias("_a"), F.col("fpr_segment").alias("_f"), F.col("n_detected").alias("_d"))
    both = own.crossJoin(F.broadcast(base)).select("rule", (F.col("auc") - F.col("_a")).alias("d_auc"), (F.col("fpr_segment") - F.col("_f")).alias("d_fpr"), (F.col("n_detected") - F.col("_d")).alias("d_detected"))  # one row
    fine = (F.col("d_auc") >= -slack) & (F.col("d_fpr") <= slack)
    better = (F.col("d_auc") > 0) | (F.col("d_fpr") < 0) | (F.col("d_detected") > 0)
    verdict = F.when(F.col("rule") == reference, "reference").when(fine & better, "accept").otherwise("reject")
    return both.withColumn("verdict", verdict)
