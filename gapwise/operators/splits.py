"""Leakage-safe splits of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.operators.order import cumulative


def fold_assignment(segments: DataFrame, folds: int, seed: int) -> DataFrame:
    """Deals the segments of each label to folds in turn, in an order that a hash of key and seed gives."""
    return _dealt(segments, folds, [F.xxhash64("src", "seg_id", F.lit(seed)), F.col("src"), F.col("seg_id")])


def ordered_folds(segments: DataFrame, folds: int) -> DataFrame:
    """As fold_assignment(), in order of the segment key."""
    return _dealt(segments, folds, [F.col("src"), F.col("seg_id")])


def _dealt(segments: DataFrame, folds: int, order: list[Column]) -> DataFrame:
    own = cumulative(segments, order, {"_i": F.lit(1)}, ["label"])
    return own.withColumn("fold", (F.col("_i") % folds).cast("int")).drop("_i")


def block_assignment(segments: DataFrame, blocks: int) -> DataFrame:
    """Blocks of equal count in time order within each stream: floor(i * blocks / n)."""
    w = Window.partitionBy("src")
    i = F.row_number().over(w.orderBy("seg_id")) - 1
    return segments.withColumn("block", F.floor(i * blocks / F.count("*").over(w)).cast("int"))


def group_k_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Each row once per fold k, as test where its fold is k and as train elsewhere."""
    ks = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    own = rows.withColumn("k", ks)
    return own.withColumn("part", F.when(F.col("fold") == F.col("k"), "test").otherwise("train"))


def forward_splits(rows: DataFrame, blocks: int) -> DataFrame:
    """Forward chaining: for k from 1, train on blocks before k and test on block k; rows without a block are tested always."""
    own = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))))
    part = F.when(F.col("block").isNull() | (F.col("block") == F.col("k")), "test").when(F.col("block") < F.col("k"), "train")
    return own.withColumn("part", part).filter("part is not null")


def split_summary(segments: DataFrame) -> DataFrame:
    """Per fold: segments, positive ones, first start, and the share of each state."""
    own = segments.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("n_pos"), F.min("start").alias("first"), F.max("start").alias("last"))
    shares = segments.groupBy("fold").pivot("state", [0, 1]).agg(F.count(F.lit(1))).fillna(0)
    return own.join(shares.select("fold", F.col("0").alias("n_high"), F.col("1").alias("n_low")), "fold")


def segment_label(rows: DataFrame, label: Column) -> DataFrame:
    return rows.groupBy("src", "seg_id").agg(F.bround(F.avg(label)).cast("int").alias("label"))
