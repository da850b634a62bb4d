"""Joins that fail where keys repeat that must not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sides whose keys must be unique.
KINDS = {"one_to_one": (True, True), "many_to_one": (False, True), "one_to_many": (True, False)}


def unique(frame: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """The frame; a job that reads it fails if two of its rows have the same keys.

    Rows are counted by key in a window, whose exchange serves a join by these keys too, so that nothing is read twice.
    Rows with a null among the keys match nothing and may repeat.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    told = F.raise_error(F.concat(F.lit(f"{name}: repeated key ({', '.join(keys)}) = "), F.to_json(F.struct(*keys))))
    own = frame.withColumn("_times", times)
    return own.filter(F.when(known & (F.col("_times") > 1), told.cast("boolean")).otherwise(True)).drop("_times")


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """left joined with right by equal keys; a job fails with a message that shows a key where one repeats on a side that allows none.

    ``validate``: one_to_one, many_to_one (right keys are unique) or one_to_many. Null keys match nothing. Columns that
    both sides have besides the keys are an error, as they would be told apart by place only.
    """
    if validate not in KINDS:
        raise ValueError(f"unknown kind of join {validate}")
    keys = [k.lower() for k in on]
    both = sorted({c.lower() for c in left.columns} & {c.lower() for c in right.columns} - set(keys))
    if both:
        raise ValueError(f"columns on both sides: {', '.join(both)}")
    first, second = KINDS[validate]
    a = unique(left, on, "left") if first else left
    b = unique(right, on, "right") if second else right
    return a.join(b, list(on), how)
