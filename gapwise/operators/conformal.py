"""Conformal p-values and thresholds from a calibration set of segment scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapwise.operators.order import cumulative, ranked_counts


def calibration_split(segments: DataFrame, fraction: float) -> DataFrame:
    """Marks the latest max(1, floor(fraction * n + 0.5)) segments of each stream as calibration."""
    w = Window.partitionBy("src")
    late = F.row_number().over(w.orderBy(F.desc("seg_id")))
    return segments.withColumn("calibration", late <= F.greatest(F.lit(1), F.floor(fraction * F.count("*").over(w) + 0.5)))


def p_values(test: DataFrame, calibration: DataFrame, by: str) -> DataFrame:
    """(1 + calibration scores of the same group at or above the score) / (n + 1).

    Both sets are counted by distinct score, and calibration scores summed in descending order; no pair of rows is made.
    """
    both = test.select(by, "score", F.lit(0).alias("_c")).unionByName(calibration.select(by, "score", F.lit(1).alias("_c")))
    counts = both.groupBy(by, "score").agg(F.sum("_c").alias("_k"))
    own = cumulative(counts, [F.desc("score")], {"_above": F.col("_k")}, [by])
    totals = calibration.groupBy(by).agg(F.count("*").alias("n_cal"))
    own = own.join(totals, by, "left").select(by, "score", (F.col("_above") + F.col("_k")).alias("_at"), F.coalesce("n_cal", F.lit(0).cast("long")).alias("n_cal"))
    return test.join(own, [by, "score"]).select(*test.columns, "n_cal", ((1 + F.col("_at")) / (F.col("n_cal") + 1)).alias("p"))


def thresholds(calibration: DataFrame, by: str, alpha: float) -> DataFrame:
    """Per group the order statistic n + 1 - floor((n + 1) alpha + 1e-9); infinity, and not attainable, if that floor is 0."""
    counts = ranked_counts(calibration, "score", [by])
    allowed = F.floor((F.col("total") + 1) * alpha + 1e-9)
    at = F.col("total") + 1 - allowed
    hit = (F.col("before") < at) & (at <= F.col("before") + F.col("n"))
    own = counts.groupBy(by).agg(F.max("total").alias("n_cal"), F.max(F.when(hit, F.col("score"))).alias("thr"), F.max(allowed).alias("allowed"))
    return own.select(by, "n_cal", F.coalesce("thr", F.lit(float("inf"))).alias("thr"), (F.col("allowed") > 0).alias("attainable"))
