"""Thresholds, alarms and quality of scores.

A score frame has keys of a segment (src, seg_id), t (order within it), score, label, and may have group columns
(model, split, fold ...), given as ``by``. Thresholds are exceeded strictly; null scores never exceed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions import average_rank, ratio
from gapwise.operators.order import quantiles, ranked_counts

SEGMENT = ("src", "seg_id")


def normal_threshold(scores: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Exact quantile (linear interpolation) of the scores of normal rows, per group."""
    return quantiles(scores.filter("label = 0"), "score", [q], by, ["thr"])


def with_threshold(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores with the threshold of their group; thresholds are a row per group."""
    return scores.join(thresholds, list(by)) if by else scores.crossJoin(F.broadcast(thresholds))


def false_positive_rates(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of normal rows, and of normal segments with any row, above thr."""
    own = scores.filter("label = 0")
    hit = F.coalesce(F.col("score") > F.col("thr"), F.lit(False))
    seg = own.groupBy(*by, *SEGMENT).agg(F.bool_or(hit).alias("any"), F.count("*").alias("n"), F.count_if(hit).alias("k"))
    return seg.groupBy(*by).agg((F.sum("k") / F.sum("n")).alias("fpr_sample"), F.avg(F.col("any").cast("double")).alias("fpr_segment"), F.count("*").alias("n_segments"))


def auc(scores: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Exact area under the ROC curve by ranks with ties shared; null if there is one class only.

    Rows are first counted by score and label, so that what is sorted is no longer than the distinct scores.
    """
    counts = ranked_counts(scores, score, by, more={"pos": F.sum(F.col("label").cast("long"))})
    ranked = counts.withColumn("rank", average_rank(F.col("before") + 1, F.col("n")))
    own = ranked.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("m"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    area = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("m"))
    return own.select(*by, F.when((F.col("p") > 0) & (F.col("m") > 0), area).alias("auc"), F.col("p").alias("n_pos"), F.col("m").alias("n_neg"))


def roc_points(scores: DataFrame) -> DataFrame:
    """thr, tpr, fpr, precision at each distinct score, counting scores from it up."""
    own = ranked_counts(scores, "score", descending=True, more={"pos": F.sum(F.col("label").cast("long"))})
    tp, up = F.col("before_pos") + F.col("pos"), F.col("before") + F.col("n")
    return own.select(F.col("score").alias("thr"), ratio(tp, F.col("total_pos")).alias("tpr"), ratio(up - tp, F.col("total") - F.col("total_pos")).alias("fpr"), ratio(tp, up).alias("precision"))


def exceed_runs(scores: DataFrame, n: int) -> DataFrame:
    """Adds hit (score above thr) and hits (of the last n rows of the segment)."""
    hit = F.coalesce(F.col("score") > F.col("thr"), F.lit(False)).cast("int")
    w = Window.partitionBy(*SEGMENT).orderBy("t").rowsBetween(-(n - 1), 0)
    return scores.withColumn("hit", hit).withColumn("hits", F.sum("hit").over(w))


def segment_alarms(scores: DataFrame, rule: str = "any", k: int = 2, n: int = 3, q: float = 0.9, skip_first: int = 0, win_s: float = 1.0, fs: float = 10.0) -> DataFrame:
    """One row per segment: label, n_used, alarm, first_t and delay.

    rule: any row, k of the last n rows, or the q quantile of the rows above thr. The first skip_first rows do not
    count; a segment without others stays as one without alarm.
    """
    order = Window.partitionBy(*SEGMENT).orderBy("t")
    own = scores.withColumn("_i", F.row_number().over(order)).withColumn("_used", F.col("_i") > skip_first)
    own = own.withColumn("score", F.when(F.col("_used"), F.col("score")))
    if rule == "quantile":
        made = own.groupBy(*SEGMENT).agg(
            F.max("label").alias("label"), F.count_if("_used").alias("n_used"), F.percentile("score", q).alias("s"), F.max("thr").alias("thr"),
            F.max(F.when(F.col("_used"), F.col("t"))).alias("last"),
        )
        made = made.withColumn("alarm", F.coalesce(F.col("s") > F.col("thr"), F.lit(False))).withColumn("first_t", F.when(F.col("alarm"), F.col("last")))
    else:
        width, least = (1, 1) if rule == "any" else (n, k)
        own = exceed_runs(own, width)
        fired = F.col("hits") >= least
        made = own.groupBy(*SEGMENT).agg(F.max("label").alias("label"), F.count_if("_used").alias("n_used"), F.bool_or(fired).alias("alarm"), F.min(F.when(fired, F.col("t"))).alias("first_t"))
    return made.select(*SEGMENT, "label", "n_used", "alarm", "first_t", (F.col("first_t") + max(win_s - 1 / fs, 0.0)).alias("delay"))


def confusion(alarms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of segments, precision, recall and F1 (null without denominator)."""
    pos, hit = F.col("label") == 1, F.col("alarm")
    own = alarms.groupBy(*by).agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn"))
    return rates(own)


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 to tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def segment_statistic(scores: DataFrame, k: int = 1, n: int = 1) -> DataFrame:
    """Per segment the highest threshold below which k of the last n rows fire: the largest k-th highest of n rows."""
    w = Window.partitionBy(*SEGMENT).orderBy("t").rowsBetween(-(n - 1), 0)
    last = F.sort_array(F.collect_list("score").over(w), asc=False)  # n values at most
    own = scores.withColumn("_s", F.when(F.size(last) >= k, F.get(last, F.lit(k - 1))))
    return own.groupBy(*SEGMENT).agg(F.max("label").alias("label"), F.max("_s").alias("stat"))


def operating_point(scores: DataFrame, targets: Sequence[float], k: int = 1, n: int = 1) -> DataFrame:
    """target, thr: the lowest score at which at most the target share of normal segments alarms.

    A segment alarms above its statistic only, so the threshold is the (m + 1)-th largest statistic, where m is the
    largest count of segments within the target; the lowest statistic if all may alarm.
    """
    stats = segment_statistic(scores.filter("label = 0"), k, n)
    counts = ranked_counts(stats, "stat", descending=True)
    total = stats.agg(F.count("*").alias("total"))
    own = total.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).withColumn("m", F.floor(F.col("target") * F.col("total") + 1e-9))
    made = counts.select("stat", "before", "n", F.col("total").alias("last")).crossJoin(F.broadcast(own))
    at = F.least(F.col("m") + 1, F.col("last"))
    return made.filter((F.col("before") < at) & (at <= F.col("before") + F.col("n"))).select("target", "total", "m", F.col("stat").alias("thr"))


def error_cases(scores: DataFrame, alarms: DataFrame) -> DataFrame:
    """kind (FP or FN) and key of wrong segments, with rows above thr and in all."""
    counts = scores.groupBy(*SEGMENT).agg(F.count_if(F.col("score") > F.col("thr")).alias("n_exceed"), F.count("*").alias("n_windows"))
    wrong = alarms.filter((F.col("label") == 1) != F.col("alarm")).select(*SEGMENT, F.when(F.col("label") == 1, "FN").otherwise("FP").alias("kind"))
    return wrong.join(counts, list(SEGMENT))


def overlap(alarms: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Jaccard similarity of the false alarms of two boolean columns; 0 without any."""
    own = alarms.filter("label = 0").groupBy(*by).agg(F.count_if(F.col(a) & F.col(b)).alias("both"), F.count_if(F.col(a) | F.col(b)).alias("either"))
    return own.withColumn("jaccard", F.coalesce(ratio("both", "either"), F.lit(0.0)))


def hourly(rate: Column, assessable: Column, hours: Column) -> Column:
    """Alarms per hour of a share of segments."""
    return rate * assessable / F.nullif(hours, F.lit(0.0))


def fused(a: Column, b: Column) -> dict[str, Column]:
    """AND, OR and mean of two scores whose threshold is 1; null if either is."""
    ok = a.isNotNull() & b.isNotNull()
    return {"z_and": F.when(ok, F.least(a, b)), "z_or": F.when(ok, F.greatest(a, b)), "z_mean": (a + b) / 2}
