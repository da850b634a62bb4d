"""Queries over sine fits, two-level states and seeded splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.operators import periodic as pe
from gapwise.plans.base import KEYS, segment_keys, segments
from gapwise.plans.registry import Tables, query


def days() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 86_400e6


def fits(t: Tables) -> DataFrame:
    return pe.sine_fit(segments(t), "ch0", days())


@query()
def sine_fits(t: Tables) -> DataFrame:
    return fits(t).select("src", "seg_id", "n", *(F.round(c, 6).alias(c) for c in ("freq", "amp", "phase", "offset", "resid_rms", "r2")))


@query()
def sine_residual(t: Tables) -> DataFrame:
    own = pe.sine_residuals(segments(t), fits(t), "ch0", days())
    return own.select("src", "event_id", F.round("residual", 6).alias("residual"))


@query(f"""WITH {KEYS}, c AS (SELECT label, round(rms0, 6) AS x, count(*) AS n, sum(round(rms0, 6)) AS s FROM k WHERE rms0 IS NOT NULL GROUP BY 1, 2),
r AS (SELECT label, x, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER (PARTITION BY label) AS n, sum(s) OVER (PARTITION BY label) AS s
  FROM c WINDOW w AS (PARTITION BY label ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, s1 / n1 AS low, (s - s1) / (n - n1) AS high FROM r WHERE n1 > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n1 * (n - n1) * (high - low) * (high - low) / n DESC, x) AS i FROM m)
SELECT label, round((low + high) / 2, 4) AS boundary, CAST(n1 AS BIGINT) AS n_low, CAST(n - n1 AS BIGINT) AS n_high FROM b WHERE i = 1""")
def two_level_states(t: Tables) -> DataFrame:
    own = pe.two_levels(segment_keys(t).withColumn("x", F.round("rms0", 6)), "x", ("label",))
    return own.select("label", F.round("boundary", 4).alias("boundary"), "n_low", "n_high")


@query()
def random_calibration_split(t: Tables) -> DataFrame:
    """Three in ten of the normal segments, drawn by a seeded hash."""
    return pe.random_split(segment_keys(t).filter("label = 0").select("src", "seg_id"), 0.3, 7)
