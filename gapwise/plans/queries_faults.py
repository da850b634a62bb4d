"""Queries over faults that are put in, comparisons by segment, offsets, attribution and misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.operators import evaluate as ev, faults, features as fe
from gapwise.plans.base import KEYS, SCORES, SEGMENTS, STEP, WIN, marked, scores, segment_keys, segments
from gapwise.plans.queries_reports import rounded
from gapwise.plans.queries_scores import _TWO, calibrated
from gapwise.plans.registry import Tables, query

_KINDS, _STRENGTHS = ("amplitude", "antiphase", "spike", "current"), (0.5, 1.0, 2.0)
_OVER = "OVER (PARTITION BY kind, strength, src, seg_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)"
_FEATURES = ", ".join(f"round(sqrt(avg({c} * {c}) {_OVER}), 6) AS {c}_rms, round(max(abs({c})) {_OVER}, 6) AS {c}_peak, round(max({c}) {_OVER} - min({c}) {_OVER}, 6) AS {c}_p2p" for c in ("ch0", "ch1"))
_AWAY = {c: "greatest(" + ", ".join(f"coalesce(abs(({c}_{f} - m_{c}_{f}) / nullif(s_{c}_{f}, 0)), 0)" for f in ("rms", "peak", "p2p")) + ")" for c in ("ch0", "ch1")}
_STATS = ", ".join(f"avg({c}_{f}) AS m_{c}_{f}, stddev_pop({c}_{f}) AS s_{c}_{f}" for c in ("ch0", "ch1") for f in ("rms", "peak", "p2p"))

_FAULTS = f"""WITH {SEGMENTS}, gr AS (SELECT unnest(['clean', 'amplitude', 'antiphase', 'spike', 'current']) AS kind, unnest([[NULL::DOUBLE], [0.5::DOUBLE, 1.0, 2.0], [0.5::DOUBLE,
  1.0, 2.0], [0.5::DOUBLE, 1.0, 2.0], [0.5::DOUBLE, 1.0, 2.0]]) AS ss),
g2 AS (SELECT kind, unnest(ss) AS strength FROM gr),
iv AS (SELECT kind, strength, src, seg_id, pos, n,
  CASE kind WHEN 'amplitude' THEN ch0 * (1 + strength) WHEN 'antiphase' THEN (1 - strength) * ch0 - strength * ch1 WHEN 'spike' THEN ch0 + CASE WHEN pos % 10 = 5 THEN 100 * strength ELSE 0 END ELSE ch0 END AS x0,
  CASE kind WHEN 'current' THEN ch1 * (1 + strength) ELSE ch1 END AS x1 FROM p CROSS JOIN g2),
cv AS (SELECT kind, strength, src, seg_id, pos, n, x0 - avg(x0) OVER s AS ch0, x1 - avg(x1) OVER s AS ch1 FROM iv WINDOW s AS (PARTITION BY kind, strength, src, seg_id)),
fw AS (SELECT kind, strength, src, seg_id, pos, n, {_FEATURES} FROM cv), fv AS (SELECT *, (src + seg_id) % 7 = 0 AS bad, src % 5 = 0 AS test FROM fw WHERE pos % 5 = 0 AND pos + 10 <= n)"""


def fault_windows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Windows of the segments as they are, and of versions with faults."""
    own = segments(t).select("src", "seg_id", "pos", "n", "ch0", "ch1")
    clean = faults.amplitude_windows(faults.centred(own, ["ch0", "ch1"]), ["ch0", "ch1"], WIN, STEP)
    versions = faults.amplitude_windows(faults.faulty(own, _KINDS, _STRENGTHS, "ch0", "ch1"), ["ch0", "ch1"], WIN, STEP, ["kind", "strength"])
    names = [f"{c}_{f}" for c in ("ch0", "ch1") for f in ("rms", "peak", "p2p")]
    return rounded(clean, 6, *names), rounded(versions, 6, *names)


@query(_FAULTS + " SELECT kind, strength, src, seg_id, pos, ch0_rms, ch0_peak, ch0_p2p, ch1_rms, ch1_peak, ch1_p2p FROM fv WHERE kind <> 'clean' AND strength = 1.0")
def faulty_features(t: Tables) -> DataFrame:
    """Window features computed anew from segments with faults of strength 1."""
    return fault_windows(t)[1].filter("strength = 1.0")


@query(_FAULTS + f""", tr AS (SELECT * FROM fv WHERE kind = 'clean' AND NOT bad AND NOT test), lm AS (SELECT quantile_cont(ch0_rms, 0.9) AS q1, quantile_cont(ch1_rms, 0.9) AS q2 FROM tr), ft AS (SELECT {_STATS} FROM tr),
ev AS (SELECT kind, strength, COLUMNS('ch._(rms|peak|p2p)') FROM fv WHERE kind <> 'clean' AND test AND NOT bad UNION ALL SELECT 'real', NULL, COLUMNS('ch._(rms|peak|p2p)') FROM fv WHERE kind = 'clean' AND bad),
zz AS (SELECT kind, strength, ch0_rms / q1 AS z1, ch1_rms / q2 AS z2, {_AWAY['ch1']} > {_AWAY['ch0']} AS second FROM ev CROSS JOIN lm CROSS JOIN ft),
hh AS (SELECT *, z1 > 1 OR z2 > 1 AS c, z1 > 1 AND z2 > 1 AS al, CASE WHEN kind = 'real' THEN NULL WHEN kind = 'current' THEN second ELSE NOT second END AS hit FROM zz)
SELECT kind, strength, count(*) AS n, count(*) FILTER (WHERE c) AS n_caution, count(*) FILTER (WHERE al) AS n_alarm, round(count(*) FILTER (WHERE al) / nullif(count(*) FILTER (WHERE c), 0)::DOUBLE, 8) AS retention,
  round(count(*) FILTER (WHERE c AND hit) / nullif(count(*) FILTER (WHERE c AND hit IS NOT NULL), 0)::DOUBLE, 8) AS hit_rate, round(median(z1), 5) AS median_z1, round(median(z2), 5) AS median_z2 FROM hh GROUP BY 1, 2""")
def fault_detection(t: Tables) -> DataFrame:
    """Faults of four kinds and three strengths in the fifth user's normal segments: how many are seen, on which channel, and how the real abnormal ones compare."""
    clean, versions = fault_windows(t)
    bad, test = (F.col("src") + F.col("seg_id")) % 7 == 0, F.col("src") % 5 == 0
    made = faults.fault_table(clean, versions, ~bad & ~test, ~bad & test, bad, ["ch0", "ch1"], 0.9)
    return rounded(rounded(made, 8, "retention", "hit_rate"), 5, "median_z1", "median_z2")


# Comparisons by segment


_VOTES = _TWO + """, kn AS (SELECT *, sum((z1 > 1)::INT) OVER (PARTITION BY src, seg_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS k3 FROM z),
vt AS (SELECT src, seg_id, max(label) AS label, coalesce(bool_or(z1 > 1), false) AS a, coalesce(bool_or(z2 > 1), false) AS b, CASE WHEN count(*) >= 3 THEN coalesce(bool_or(k3 >= 2), false) END AS c FROM kn GROUP BY 1, 2)"""


def votes(t: Tables) -> DataFrame:
    """Per segment what three rules say: either score anywhere, and the first one in two of three windows (null below three windows)."""
    own = calibrated(t).withColumns({"score": F.col("z1"), "thr": F.lit(1.0)})
    runs = ev.exceed_runs(own, 3)
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return runs.groupBy("src", "seg_id").agg(F.max("label").alias("label"), hit(F.col("z1") > 1).alias("a"), hit(F.col("z2") > 1).alias("b"), F.when(F.count("*") >= 3, hit(F.col("hits") >= 2)).alias("c"))


@query(_VOTES + """, hr AS (SELECT sum(h) AS h FROM (SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9::DOUBLE AS h FROM events GROUP BY user_id)), nv AS (SELECT * FROM vt WHERE label = 0)
SELECT count(*) FILTER (WHERE c IS NOT NULL) AS n_common, count(*) FILTER (WHERE b AND c) AS "both", count(*) FILTER (WHERE b AND NOT c) AS only_first,
  count(*) FILTER (WHERE c AND NOT b) AS only_second, count(*) FILTER (WHERE NOT b AND NOT c) AS neither,
  round(count(*) FILTER (WHERE b) / max(h), 9) AS native_first, round(count(*) FILTER (WHERE c) / max(h), 9) AS native_second,
  round(count(*) FILTER (WHERE b AND c IS NOT NULL) / max(h), 9) AS common_first, round(count(*) FILTER (WHERE c) / max(h), 9) AS common_second FROM nv CROSS JOIN hr""")
def system_comparison(t: Tables) -> DataFrame:
    """Two systems' false alarms on the segments that both judge, and on their own."""
    hours = t.events.groupBy("user_id").agg(((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 3.6e9).alias("hours"))
    own = faults.system_comparison(votes(t).filter("label = 0"), hours, "b", "c")
    return rounded(own, 9, "native_first", "native_second", "common_first", "common_second")


@query(_VOTES + f""", ks AS (WITH {KEYS} SELECT src, seg_id, rms0 FROM k), nv AS (SELECT src, seg_id, 2 + (c IS NOT NULL)::INT AS n_votes, (a::INT + b::INT + coalesce(c,
  false)::INT) / (2 + (c IS NOT NULL)::INT)::DOUBLE AS share FROM vt WHERE label = 0)
SELECT src, seg_id, n_votes, round(share, 6) AS share, coalesce(rms0 > 60, false) AS suspect FROM nv LEFT JOIN ks USING (src, seg_id) WHERE share > 0.5""")
def majority_false_positives(t: Tables) -> DataFrame:
    """Normal segments that most rules raise an alarm on, and whether they are on the list of suspects."""
    listed = segment_keys(t).filter("rms0 > 60")
    return rounded(faults.majority_false_positives(votes(t).filter("label = 0"), ["a", "b", "c"], listed), 6, "share")


@query(_VOTES + """ SELECT CASE WHEN NOT a AND NOT b AND NOT coalesce(c, false) THEN 'missed_by_all' WHEN a AND b AND coalesce(c,
  true) THEN 'found_by_all' ELSE 'missed_by_some' END AS category, count(*) AS n FROM vt WHERE label = 1 GROUP BY 1""")
def missed_segments(t: Tables) -> DataFrame:
    return faults.missed(votes(t), ["a", "b", "c"])


@query(_TWO + """, ca AS (SELECT src, seg_id, count(*) AS n_windows, median(z1) AS z1, median(z2) AS z2 FROM z WHERE z1 > 1 OR z2 > 1 GROUP BY 1, 2) SELECT src, seg_id, n_windows,
  round(z1, 5) AS z1, round(z2, 5) AS z2, CASE WHEN z2 > z1 THEN 'z2' ELSE 'z1' END AS dominant FROM ca""")
def channel_attribution(t: Tables) -> DataFrame:
    """Which channel stands out in the windows of a segment above a threshold."""
    return rounded(faults.channel_attribution(calibrated(t), ["z1", "z2"], (F.col("z1") > 1) | (F.col("z2") > 1)), 5, "z1", "z2")


@query(f"""WITH {SCORES}, f AS (SELECT unnest([0, 1, 2, 3, 4]) AS k), tq AS (SELECT k, quantile_cont(score, 0.95) AS thr FROM sc JOIN f ON sc.fold <> f.k WHERE label = 0 GROUP BY 1),
rt AS (SELECT k, max(thr) AS thr, avg(CASE WHEN score > thr THEN 1.0::DOUBLE ELSE 0.0 END) AS rate FROM sc JOIN tq ON sc.fold <> tq.k WHERE label = 0 GROUP BY 1)
SELECT count(*) AS n_folds, round(min(thr), 6) AS least, round(max(thr), 6) AS most, round((max(thr) - min(thr)) / avg(thr), 8) AS relative_range, round(avg(rate), 8) AS realised FROM rt""")
def threshold_stability(t: Tables) -> DataFrame:
    return rounded(rounded(faults.threshold_stability(scores(t), 0.95, 5), 6, "least", "most"), 8, "relative_range", "realised")


# Offsets


_OFFSETS = f"""WITH {SEGMENTS}, sf AS (SELECT src, seg_id, count(*) AS n, round(avg(ch0), 6) AS dc, round(sqrt(avg(ch0 * ch0)), 6) AS rms, CAST((src + seg_id) % 7 = 0 AS INTEGER) AS label FROM p GROUP BY 1, 2)"""


def offsets(t: Tables) -> DataFrame:
    return rounded(marked(fe.segment_features(segments(t)).select("src", "seg_id", "n", "dc", "rms")), 6, "dc", "rms")


@query(_OFFSETS + """, lg AS (SELECT label, u.measure, u.score FROM sf, LATERAL (SELECT unnest([{'measure': 'abs_dc', 'score': abs(dc)},
  {'measure': 'abs_dc_over_rms', 'score': abs(dc) / nullif(rms, 0)}, {'measure': 'residual_dc', 'score': CASE WHEN abs(dc) < 1e-5 THEN 0.0 ELSE abs(dc) END}]) AS u) WHERE n >= 17),
rk AS (SELECT measure, label, rank() OVER (PARTITION BY measure ORDER BY score) + (count(*) OVER (PARTITION BY measure, score) - 1) / 2.0::DOUBLE AS r FROM lg WHERE score IS NOT NULL),
au AS (SELECT measure,
  (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0), 0)::DOUBLE AS auc FROM rk GROUP BY 1)
SELECT measure, round(auc, 8) AS auc, round(greatest(auc, 1 - auc), 8) AS symmetric, greatest(auc, 1 - auc) > 0.8 AS leak FROM au""")
def offset_diagnostics(t: Tables) -> DataFrame:
    """How well a segment's mean alone tells its label."""
    return rounded(faults.offset_diagnostics(offsets(t)), 8, "auc", "symmetric")


@query(_OFFSETS + """, q AS (SELECT quantile_cont(abs(dc), 0.95) AS q FROM sf WHERE label = 0 AND n >= 17) SELECT src, seg_id, label, CASE WHEN n >= 17 THEN abs(dc) > q END AS alarm FROM sf CROSS JOIN q""")
def offset_alarms(t: Tables) -> DataFrame:
    return faults.offset_alarms(offsets(t), 0.95)
