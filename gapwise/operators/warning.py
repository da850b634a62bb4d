"""Early warning on series of bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions import ratio
from gapwise.operators.order import quantiles
from gapwise.operators.series import recursive_filter


def ewma(bursts: DataFrame, by: str, order: str, value: str, lam: float, init: float) -> DataFrame:
    """Adds ewma: s = lam * v + (1 - lam) * s from init, along each series.

    Folded over the ordered array of the last values, of which those that weigh under 1e-15 are left out: for small
    ``lam`` these are many, and trend_alerts() shows the filter that has no such array.
    """
    import math

    w = Window.partitionBy(by).orderBy(order)
    span = max(1, math.ceil(math.log(1e-15) / math.log(1 - lam))) if lam < 1 else 1
    last = F.collect_list(value).over(w.rowsBetween(-(span - 1), 0))
    i = F.row_number().over(w)
    start = F.when(i <= span, F.lit(float(init))).otherwise(F.lit(0.0))
    return bursts.withColumn("ewma", F.aggregate(last, start, lambda s, v: lam * v + (1 - lam) * s))


def episode_starts(bursts: DataFrame, by: str, order: str, alert: Column, rearm: int = 3) -> DataFrame:
    """Adds alert, and start: an alert without another in the ``rearm`` bursts before."""
    w = Window.partitionBy(by).orderBy(order)
    own = bursts.withColumn("alert", alert).withColumn("_i", F.row_number().over(w))
    last = F.last(F.when(F.col("alert"), F.col("_i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("start", F.col("alert") & (last.isNull() | (F.col("_i") - last - 1 >= rearm))).drop("_i")


def false_alert_rate(bursts: DataFrame, by: str, t: str) -> DataFrame:
    """Episodes per hour and the share of alerting bursts, per series with start and alert."""
    own = bursts.groupBy(by).agg(F.sum(F.col("start").cast("int")).alias("episodes"), F.avg(F.col("alert").cast("double")).alias("share"), ((F.max(t) - F.min(t)) / 3600.0).alias("hours"))
    return own.withColumn("per_hour", ratio("episodes", "hours"))


def lead_times(bursts: DataFrame, by: str, t: str, t0: Column, t_crit: Column) -> DataFrame:
    """First alert at or after t0, its lead to t_crit and its delay since t0."""
    own = bursts.withColumn("_t0", t0).withColumn("_crit", t_crit).groupBy(by).agg(F.min("_t0").alias("t0"), F.min("_crit").alias("crit"), F.min(F.when(F.col("alert") & (F.col(t) >= F.col("_t0")), F.col(t))).alias("hit"))
    return own.select(by, "hit", (F.col("crit") - F.col("hit")).alias("lead"), (F.col("hit") - F.col("t0")).alias("since"))


def eta(bursts: DataFrame, by: str, t: str, z: str, limit: float, m: int = 10) -> DataFrame:
    """Time at which a line through ln z of the last m bursts of each series reaches ln(limit); null if it doesn't rise."""
    recent = bursts.filter(F.col(z) > 0).withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(t)))).filter(F.col("_i") <= m)
    origin = recent.withColumn("_o", F.min(t).over(Window.partitionBy(by))).withColumn("_x", F.col(t) - F.col("_o")).withColumn("_y", F.log(z))
    own = origin.groupBy(by).agg(F.min("_o").alias("o"), F.count("*").alias("n"), F.var_pop("_x").alias("vx"), F.covar_pop("_x", "_y").alias("cxy"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"))
    slope = ratio("cxy", "vx")
    return own.select(by, "n", slope.alias("slope"), F.when(slope > 0, F.col("o") + F.col("mx") + (F.log(F.lit(float(limit))) - F.col("my")) / slope).alias("eta"))


def trend_alerts(bursts: DataFrame, value: str, train: Column, lam: float, q: float = 0.99) -> DataFrame:
    """src, seg_id, trend, thr, alert: the exponential average of a burst's value along each stream against its ``q`` quantile over the training bursts.

    The average begins at the training bursts' median. It is a recursive filter in parts, so that a stream of any
    length, and any weight, takes the same passes. seg_id numbers a stream's bursts from 0 without a gap; null values
    count as 0 in the average and have none of their own.
    """
    own = bursts.select("src", "seg_id", F.col(value).cast("double").alias("_x"), F.coalesce(train, F.lit(False)).alias("_train"))
    start = quantiles(own.filter("_train"), "_x", [0.5], names=["_init"])
    own = own.join(F.broadcast(start), how="left")  # one row
    made = recursive_filter(own, "_x", [lam, 0.0], [1.0, lam - 1.0], ["src"], "seg_id", first="_init").withColumnRenamed("filtered", "trend")
    limit = quantiles(made.filter("_train"), "trend", [q], names=["thr"])
    return made.join(F.broadcast(limit), how="left").select("src", "seg_id", "trend", "thr", F.coalesce(F.col("trend") > F.col("thr"), F.lit(False)).alias("alert"))


def paired_gain(leads: DataFrame, by: Sequence[str], rule: str, first: str, second: str) -> DataFrame:
    """n_both, n_only_first, n_only_second, mean_gain, median_gain, share_gain: how much earlier the second rule warns than the first, over the scenarios (keys ``by``) that both warn of."""
    a = F.max(F.when(F.col(rule) == first, F.col("lead")))
    b = F.max(F.when(F.col(rule) == second, F.col("lead")))
    own = leads.groupBy(*by).agg(a.alias("_a"), b.alias("_b")).withColumn("_gain", F.col("_b") - F.col("_a"))
    return own.agg(
        F.count("_gain").alias("n_both"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("n_only_first"), F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("n_only_second"),
        F.avg("_gain").alias("mean_gain"), F.median("_gain").alias("median_gain"), F.avg(F.when(F.col("_gain") > 0, 1.0).when(F.col("_gain") <= 0, 0.0)).alias("share_gain"),
    )
