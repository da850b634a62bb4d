"""Alarm cards, attributions, and operators on short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions import ratio


def channel_shares(errors: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Each channel's share of the summed mean error of a group, and the dominant channel."""
    means = errors.groupBy(*by).agg(*(F.avg(c).alias(c) for c in channels))
    total = sum((F.col(c) for c in channels), F.lit(0.0))
    top = F.array_max(F.array(*(F.struct(F.col(c).alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(channels))))
    return means.select(*by, *(ratio(F.col(c), total).alias(f"{c}_share") for c in channels), top["name"].alias("dominant"))


def top_features(frame: DataFrame, keys: list[str], features: list[str], k: int) -> DataFrame:
    """The k features of largest |z| of each row, as text name:+z."""
    z = F.array(*(F.struct((-F.abs(F.round(F.col(c), 6))).alias("a"), F.lit(c).alias("name"), F.col(c).alias("z")) for c in features))
    top = F.slice(F.sort_array(z), 1, k)
    return frame.select(*keys, F.array_join(F.transform(top, lambda x: F.concat(x["name"], F.lit(":"), F.format_string("%+.1f", x["z"]))), ";").alias("top"))


def alarm_level(caution: Column, alarm: Column) -> Column:
    return F.when(alarm, "alarm").when(caution, "caution").otherwise("normal")


def route(text: Column, intents: dict[str, list[str]], otherwise: str = "unknown") -> Column:
    """Name of the first intent of which a keyword is in the text, in lower case."""
    low, out = F.lower(text), None
    for name, words in intents.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def citations(text: Column, pattern: str) -> Column:
    """Distinct matches, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))), ",")


def unsupported_numbers(answer: Column, facts: Column) -> Column:
    """Numbers of an answer that aren't among those of the facts, sorted, joined by commas."""
    found = [F.regexp_extract_all(F.regexp_replace(x, r"(\d),(\d{3})", "$1$2"), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)) for x in (answer, facts)]
    return F.array_join(F.array_sort(F.array_distinct(F.array_except(*found))), ",")


def flagged_lines(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key, line (from 1), rule of every line that a pattern finds."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_p", "_line"))
    rules = F.array_compact(F.array(*(F.when(F.col("_line").rlike(p), name) for name, p in patterns.items())))
    return lines.select(key, (F.col("_p") + 1).alias("line"), F.explode(rules).alias("rule"))


def without_lines(text: Column, pattern: str) -> Column:
    """The text without the lines that a pattern finds."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def table_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """One row: rows on one side only, largest difference, cells over the tolerance and a status."""
    left, right = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("_a")), b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("_b"))
    both = left.join(right, keys, "full")
    diffs = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns]
    made = both.agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_unmatched"), F.max(F.greatest(*diffs, F.lit(0.0))).alias("max_diff"), sum((F.count_if(d > tolerance) for d in diffs), F.lit(0)).cast("long").alias("n_over"))
    return made.withColumn("status", F.when(F.col("n_unmatched") > 0, "shape").when(F.col("n_over") > 0, "changed").otherwise("equal"))
