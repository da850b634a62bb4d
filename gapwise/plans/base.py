"""Frames that many queries begin with, and their SQL.

Events stand in for sensor samples: a user is a stream, value and the number in props are channels, and a silence of
more than two days ends a segment. One segment in seven counts as abnormal (label 1), one in two as state 1, by the sum of user and number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.operators.segments import gap_segments, hop_windows
from gapwise.plans.registry import Tables

GAP, WIN, STEP = 172_800.0, 10, 5


def samples(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("src"), "event_id", "ts", F.col("value").alias("ch0"), F.get_json_object("props", "$.k").cast("double").alias("ch1"), "event_type")


def segments(t: Tables) -> DataFrame:
    return gap_segments(samples(t), GAP)


def marked(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"label": ((F.col("src") + F.col("seg_id")) % 7 == 0).cast("int"), "state": ((F.col("src") + F.col("seg_id")) % 2).cast("int")})


def segment_keys(t: Tables) -> DataFrame:
    """A row per segment: n, start, label, state."""
    own = segments(t).groupBy("src", "seg_id").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.avg("ch0").alias("mean0"), F.sqrt(F.avg(F.col("ch0") * F.col("ch0"))).alias("rms0"))
    return marked(own)


def windows(t: Tables) -> DataFrame:
    return hop_windows(segments(t), WIN, STEP, ("ch0", "ch1"))


def scores(t: Tables) -> DataFrame:
    """Windows as scores: score is the RMS of ch0, score2 that of ch1; folds by user. Rounded, so that ties and limits don't hang on the last bit."""
    own = windows(t).select("src", "seg_id", F.col("pos").alias("t"), F.round("ch0_rms", 6).alias("score"), F.round("ch1_rms", 6).alias("score2"), (F.col("src") % 5).cast("int").alias("fold"))
    return marked(own)


SAMPLES = """s AS (SELECT user_id AS src, event_id, ts, value AS ch0, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ch1, event_type FROM events)"""
SEGMENTS = SAMPLES + """,
d AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src ORDER BY ts, event_id)) / 1e6::DOUBLE AS dt FROM s),
g AS (SELECT *, CAST(sum(CASE WHEN dt > 172800 THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_id FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY src, seg_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY src, seg_id) AS n FROM g)"""
KEYS = SEGMENTS + """,
k AS (SELECT src, seg_id, count(*) AS n, min(ts) AS start, avg(ch0) AS mean0, sqrt(avg(ch0 * ch0)) AS rms0, CAST((src + seg_id) % 7 = 0 AS INTEGER) AS label, CAST((src + seg_id) % 2 AS INTEGER) AS state FROM p GROUP BY src, seg_id)"""
_FRAME = "OVER (PARTITION BY src, seg_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)"


def _channel(c: str) -> str:
    f = _FRAME
    m = {i: f"avg(pow({c}, {i})) {f}" for i in (1, 2, 3, 4)}
    return f"""sqrt(avg({c} * {c}) {f}) AS {c}_rms, max(abs({c})) {f} AS {c}_peak, max({c}) {f} - min({c}) {f} AS {c}_p2p,
  avg({c}) {f} AS {c}_m1, {m[2]} AS {c}_m2, {m[3]} AS {c}_m3, {m[4]} AS {c}_m4, max({c}) {f} AS {c}_hi, min({c}) {f} AS {c}_lo"""


WINDOWS = SEGMENTS + f""",
w0 AS (SELECT src, seg_id, pos, n, ts, {_channel('ch0')}, {_channel('ch1')} FROM p),
w AS (SELECT * FROM w0 WHERE pos % 5 = 0 AND pos + 10 <= n)"""
SCORES = WINDOWS + """,
sc AS (SELECT src, seg_id, pos AS t, round(ch0_rms, 6) AS score, round(ch1_rms, 6) AS score2, CAST(src % 5 AS INTEGER) AS fold, CAST((src + seg_id) % 7 = 0 AS INTEGER) AS label, CAST((src + seg_id) % 2 AS INTEGER) AS state FROM w)"""
THRESHOLD = SCORES + """,
th AS (SELECT quantile_cont(score, 0.9) AS thr FROM sc WHERE label = 0),
st AS (SELECT sc.*, th.thr, CAST(score > thr AS INTEGER) AS hit FROM sc CROSS JOIN th)"""
