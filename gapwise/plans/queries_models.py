"""Queries over fits of folds and states, curves through gaps, filters, windows as vectors, rebuilt segments, validated joins, drift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions import mad, robust_scale
from gapwise.operators import classify, drift, evaluate as ev, features as fe, joins, pairs, periodic as pe, rebuild, series, splits, stats, warning, window_models as wm
from gapwise.operators.segments import gap_segments
from gapwise.plans.base import KEYS, SAMPLES, SCORES, SEGMENTS, STEP, WIN, WINDOWS, marked, samples, scores, segment_keys, segments
from gapwise.plans.queries_reports import R, rounded
from gapwise.plans.queries_segments import _amp_sql
from gapwise.plans.registry import Tables, query

FOLDS = 5


def hours() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6


def days() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 86_400e6


# One stream


_ONE = SEGMENTS.replace("SELECT user_id AS src", "SELECT 1::BIGINT AS src").replace("dt > 172800", "dt > 600")


@query(f"WITH {_ONE} SELECT src, event_id, dt, seg_id, pos, n FROM p")
def gap_segments_one_stream(t: Tables) -> DataFrame:
    """All samples as one stream, in parts of a day: a busy stream spans many tasks."""
    own = samples(t).withColumn("src", F.lit(1).cast("long"))
    return gap_segments(own, 600.0, 86_400.0).select("src", "event_id", "dt", "seg_id", "pos", "n")


# Folds and states


def fold_features(t: Tables) -> DataFrame:
    own = marked(fe.segment_features(segments(t)))
    return own.withColumn("fold", (F.col("src") % FOLDS).cast("int"))


@query()
def oof_logistic_auc(t: Tables) -> DataFrame:
    """Area of out-of-fold predictions of a segment's label by its features; fold null is of all folds."""
    return rounded(classify.logistic_auc(fold_features(t), ["n", "rms", "peak", "dc", "crest", "kurt"]), 8, "auc")


@query()
def operating_states(t: Tables) -> DataFrame:
    """States of normal segments by RMS and mean: each number that was tried, and how many segments each state of the chosen one has."""
    own = segment_keys(t).filter("label = 0")
    found = classify.operating_states(own, ["rms0", "mean0"], F.struct("src", "seg_id"))
    sizes = own.groupBy(found.state().alias("state")).agg(F.count("*").alias("n_segments")).withColumn("k", F.lit(found.k))
    return rounded(classify.state_table(found, own), 6, "cost", "silhouette").join(sizes, "k", "left")


# Curves and filters


@query()
def cubic_gap_fill(t: Tables) -> DataFrame:
    """Two of every seven samples are taken out and filled by a cubic spline over time."""
    own = segments(t).withColumn("x", F.when(F.col("pos") % 7 >= 2, F.col("ch0")))
    return series.cubic_filled(own, "x", days()).select("src", "event_id", R("filled", 6).alias("filled"))


_MASKED = f"""WITH {SEGMENTS}, mm AS (SELECT *, avg(ch0) OVER s AS m0, avg(ch1) OVER s AS m1 FROM p WINDOW s AS (PARTITION BY src, seg_id)),
ks AS (SELECT unnest([3, 7, 12]) AS k), mc AS (SELECT src, seg_id, pos, n, k, c.channel, c.x, pos >= (n - k) // 2 AND pos < (n - k) // 2 + k AS gone
  FROM mm CROSS JOIN ks, LATERAL (SELECT unnest([{{'channel': 'ch0', 'x': ch0 - m0}}, {{'channel': 'ch1', 'x': ch1 - m1}}]) AS c) WHERE n >= k + 10),
ab AS (SELECT *, last_value(CASE WHEN NOT gone THEN x END IGNORE NULLS) OVER w AS a, first_value(CASE WHEN NOT gone THEN x END IGNORE NULLS) OVER v AS b FROM mc
  WINDOW w AS (PARTITION BY src, seg_id, k, channel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY src, seg_id, k, channel
  ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT k, channel, src, seg_id, x, 0.0::DOUBLE AS zero, a + (b - a) * (pos - (n - k) // 2 + 1) / (k + 1) AS linear FROM ab WHERE gone)"""


@query(_MASKED + """ SELECT k, method, channel, count(DISTINCT (src, seg_id)) AS n_segments, count(*) AS n, round(1 - sum(pow(x - f, 2)) / (var_pop(x) * count(*)), 6) AS r2,
  round(sqrt(sum(pow(x - f, 2)) / count(*)) / stddev_pop(x), 6) AS nrmse
FROM (SELECT *, 'zero' AS method, zero AS f FROM fl UNION ALL SELECT *, 'linear', linear FROM fl) GROUP BY k, method, channel""")
def masked_runs(t: Tables) -> DataFrame:
    return rounded(rebuild.masked_runs(segments(t), ["ch0", "ch1"], [3, 7, 12], ["zero", "linear"], days()), 6, "r2", "nrmse")


@query()
def masked_runs_curves(t: Tables) -> DataFrame:
    """Runs of seven samples taken out and filled by splines and sines."""
    return rounded(rebuild.masked_runs(segments(t), ["ch0"], [7], ["cubic", "sine"], days()), 6, "r2", "nrmse")


_B, _A = series.butterworth_highpass(0.1, 1.0)
_B0, _B1, _B2, _A1, _A2 = (f"{float(x)!r}::DOUBLE" for x in (*_B, *_A[1:]))


def _step_sql(y: str, x: str, s1: str) -> str:
    """What comes out, and the two numbers of the state after it."""
    return f"{y} AS y, {s1} + {_B1} * {x} - {_A1} * ({y}) AS s0, {_B2} * {x} - {_A2} * ({y}) AS s1"


@query(f"""WITH RECURSIVE {SEGMENTS}, q AS MATERIALIZED (SELECT src, seg_id, pos, event_id, coalesce(ch0, 0) AS x, ch0 IS NOT NULL AS known FROM p),
f AS (SELECT src, seg_id, pos, event_id, known, {_step_sql(f'{_B0} * x', 'x', '0.0')} FROM q WHERE pos = 0
  UNION ALL SELECT q.src, q.seg_id, q.pos, q.event_id, q.known, {_step_sql(f'f.s0 + {_B0} * q.x', 'q.x', 'f.s1')} FROM f JOIN q ON q.src = f.src AND q.seg_id = f.seg_id AND q.pos = f.pos + 1)
SELECT src, event_id, round(CASE WHEN known THEN y END, 6) AS filtered FROM f""")
def highpass_causal(t: Tables) -> DataFrame:
    """A second-order high-pass at a tenth of the sampling rate, along each segment."""
    return series.recursive_filter(segments(t), "ch0", _B, _A, ["src", "seg_id"], "pos").select("src", "event_id", R("filtered", 6).alias("filtered"))


@query()
def highpass_zero_phase(t: Tables) -> DataFrame:
    return series.zero_phase_filter(segments(t), "ch0", _B, _A).select("src", "event_id", R("filtered", 6).alias("filtered"))


# Windows as vectors


@query()
def window_pca_scores(t: Tables) -> DataFrame:
    """Windows of ten samples of two channels against eight components of the normal ones."""
    own = segments(t)
    fit = wm.fit_windows(own, ["ch0", "ch1"], WIN, STEP, 8, (F.col("src") + F.col("seg_id")) % 7 != 0)
    return rounded(wm.window_errors(own, fit, STEP), 5, "e_ch0", "e_ch1", "score")


# Rebuilt segments


_SPANS = (0.0, 200.0, 400.0, 800.0, 1e6)


@query(f"""WITH {SEGMENTS}, h AS (SELECT *, epoch_us(ts) / 3600e6::DOUBLE AS t FROM p),
e AS (SELECT src, seg_id, count(*) AS n, arg_min(t, pos) AS t0, arg_min(ch0, pos) AS x0, arg_max(t, pos) AS t1, arg_max(ch0, pos) AS x1 FROM h GROUP BY 1, 2 HAVING count(*) >= 10),
b AS (SELECT m.src, m.seg_id, a.t1 AS ta, a.x1 AS xa, c.t0 AS tc, c.x0 AS xc FROM e m JOIN e a ON a.src = m.src AND a.seg_id = m.seg_id - 1 JOIN e c ON c.src = m.src AND c.seg_id = m.seg_id + 1),
gs AS (SELECT h.src, h.seg_id, tc - ta AS span, ch0 AS x, 0.0::DOUBLE AS zero, xa + (xc - xa) * (t - ta) / nullif(tc - ta, 0) AS linear FROM h JOIN b USING (src, seg_id) WHERE ch0 IS NOT NULL),
y AS (SELECT *, x - avg(x) OVER s AS d, 0.0::DOUBLE AS dz, linear - avg(linear) OVER s AS dl FROM gs WINDOW s AS (PARTITION BY src, seg_id)),
r AS (SELECT src, seg_id, 'zero' AS method, max(span) AS span, count(*) AS n, sum(pow(d - dz, 2)) AS sse, sum(d * d) AS sst FROM y GROUP BY 1, 2 UNION ALL SELECT src, seg_id,
  'linear', max(span), count(*), sum(pow(d - dl, 2)), sum(d * d) FROM y GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN span < 200 THEN 0.0::DOUBLE WHEN span < 400 THEN 200.0 WHEN span < 800 THEN 400.0 WHEN span < 1e6 THEN 800.0 END AS span_from FROM r)
SELECT method, span_from, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n, round(1 - sum(sse) / nullif(sum(sst), 0), 6) AS r2,
  round(sqrt(sum(sse) / sum(n)) / nullif(sqrt(sum(sst) / sum(n)), 0), 6) AS nrmse FROM z WHERE span_from IS NOT NULL GROUP BY 1, 2""")
def holdout_reconstruction(t: Tables) -> DataFrame:
    """Segments rebuilt from the one before and the one after, by the hours between these."""
    return rounded(rebuild.by_span(rebuild.held_out(segments(t), "ch0", hours()), _SPANS), 6, "r2", "nrmse")


@query()
def holdout_sine(t: Tables) -> DataFrame:
    return rounded(rebuild.by_span(rebuild.held_out(segments(t), "ch0", days(), ["sine"]), (0.0, 10.0, 20.0, 1e6)), 6, "r2", "nrmse")


@query()
def phase_continuity(t: Tables) -> DataFrame:
    own = segments(t)
    return rounded(rebuild.phase_steps(own, pe.sine_fit(own, "ch0", days()), "ch0", days()), 6, "gap", "phase_error", "r2_forward")


# Validated joins


@query(f"""WITH {KEYS} SELECT p.src, p.event_id, p.ch0, k.label, k.state, round(k.rms0, 6) AS rms0 FROM p LEFT JOIN k USING (src, seg_id)""")
def validated_join(t: Tables) -> DataFrame:
    """Samples with their segment's attributes, which must be a row a segment."""
    made = joins.joined(segments(t).select("src", "seg_id", "event_id", "ch0"), segment_keys(t).select("src", "seg_id", "label", "state", "rms0"), ["src", "seg_id"])
    return made.select("src", "event_id", "ch0", "label", "state", R("rms0", 6).alias("rms0"))


_DECIDED = SCORES + """, th AS (SELECT fold, quantile_cont(score, 0.9) AS thr FROM sc WHERE label = 0 GROUP BY 1), hit AS (SELECT sc.*, score > thr AS h FROM sc JOIN th USING (fold)),
run AS (SELECT *, sum(h::INT) OVER (PARTITION BY src, seg_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits FROM hit),
seg AS (SELECT fold, src, seg_id, label, bool_or(h) AS one, bool_or(hits >= 2) AS several FROM run GROUP BY 1, 2, 3, 4),
dec AS (SELECT fold, rule, count(*) FILTER (WHERE label = 1 AND alarm) AS detected, count(*) FILTER (WHERE label = 1) AS n_out FROM (SELECT *, 'any' AS rule, one AS alarm FROM seg
  UNION ALL SELECT *, 'kofn', several FROM seg) GROUP BY 1, 2),
sm AS (SELECT fold, count(*) FILTER (WHERE h) / count(*)::DOUBLE AS fpr_sample FROM hit WHERE label = 0 GROUP BY 1)"""


@query(f"WITH {_DECIDED} SELECT dec.fold, rule, detected, n_out, round(fpr_sample, 8) AS fpr_sample FROM dec LEFT JOIN sm USING (fold)")
def final_summary(t: Tables) -> DataFrame:
    """What two rules of alarm detect in each fold, with the fold's rate of false positives: a validated join of the two reports."""
    own = scores(t)
    above = ev.with_threshold(own, ev.normal_threshold(own, 0.9, ["fold"]), ["fold"])
    decided = None
    for rule, k, n in (("any", 1, 1), ("kofn", 2, 3)):
        runs = ev.exceed_runs(above, n).groupBy("fold", "src", "seg_id", "label").agg(F.bool_or(F.col("hits") >= k).alias("alarm"))
        made = runs.groupBy("fold").agg(F.count_if((F.col("label") == 1) & F.col("alarm")).alias("detected"), F.count_if(F.col("label") == 1).alias("n_out")).withColumn("rule", F.lit(rule))
        decided = made if decided is None else decided.unionByName(made)
    rates = ev.false_positive_rates(above, ["fold"]).select("fold", "fpr_sample")
    return joins.joined(decided, rates, ["fold"]).select("fold", "rule", "detected", "n_out", R("fpr_sample", 8).alias("fpr_sample"))


# Drift and normality


def blocked(t: Tables) -> DataFrame:
    return t.orders.select((F.year("o_orderdate") % 4).cast("int").alias("block"), F.round("o_totalprice", -1).alias("v"), F.col("o_orderstatus").alias("g"))


_BLOCKS = (0, 1, 2, 3)


@query("""WITH o AS (SELECT CAST(year(o_orderdate) % 4 AS INTEGER) AS block, round(o_totalprice, -1) AS v, o_orderstatus AS g FROM orders WHERE o_totalprice IS NOT NULL),
s AS (SELECT g, k, v, CASE WHEN block = k THEN 1 ELSE 0 END AS cur FROM o CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE block <= k),
c AS (SELECT g, k, v, count(*) FILTER (WHERE cur = 0) AS a, count(*) FILTER (WHERE cur = 1) AS b FROM s GROUP BY 1, 2, 3),
d AS (SELECT g, k, sum(a) OVER w / nullif(sum(a) OVER t, 0)::DOUBLE AS fa, sum(b) OVER w / nullif(sum(b) OVER t, 0)::DOUBLE AS fb FROM c WINDOW w AS (PARTITION BY g, k ORDER BY v), t AS (PARTITION BY g, k)),
ks AS (SELECT g, k, max(abs(fa - fb)) AS ks FROM d GROUP BY 1, 2),
m AS (SELECT g, k, median(v) FILTER (WHERE cur = 0) AS ma, median(v) FILTER (WHERE cur = 1) AS mb, count(*) FILTER (WHERE cur = 0) AS na, count(*) FILTER (WHERE cur = 1) AS nb FROM s GROUP BY 1, 2),
z AS (SELECT s.g, s.k, cur, abs(v - CASE WHEN cur = 1 THEN mb ELSE ma END) AS z FROM s JOIN m ON m.g = s.g AND m.k = s.k),
l AS (SELECT g, k, avg(z) AS mean, avg(z) FILTER (WHERE cur = 0) AS a, avg(z) FILTER (WHERE cur = 1) AS b, var_pop(z) FILTER (WHERE cur = 0) AS va, var_pop(z) FILTER (WHERE cur = 1) AS vb FROM z GROUP BY 1, 2)
SELECT m.g, CAST(m.k AS INTEGER) AS block, na AS n_ref, nb AS n_blk, CASE WHEN na >= 2 AND nb >= 2 THEN round(ks, 8) END AS ks,
  CASE WHEN na >= 2 AND nb >= 2 THEN round((na * pow(a - mean, 2) + nb * pow(b - mean, 2)) * (na + nb - 2) / nullif(na * va + nb * vb, 0), 5) END AS levene, ma AS median_ref, mb AS median_blk
FROM m JOIN ks USING (g, k) JOIN l USING (g, k)""")
def block_drift(t: Tables) -> DataFrame:
    """Each year of four against all earlier ones, by order status."""
    return rounded(rounded(drift.block_drift(blocked(t), "v", "block", _BLOCKS, ["g"]), 8, "ks"), 5, "levene")


@query()
def block_drift_p(t: Tables) -> DataFrame:
    return rounded(drift.drift_p_values(drift.block_drift(blocked(t), "v", "block", _BLOCKS, ["g"])), 8, "ks", "levene", "ks_p", "levene_p")


@query()
def shapiro_wilk(t: Tables) -> DataFrame:
    """Whether order prices are normal, by status: up to 5,000 orders of each, drawn by a seeded hash of their key."""
    return rounded(drift.shapiro_wilk(t.orders, "o_totalprice", ["o_orderkey"], ["o_orderstatus"]), 8, "w", "z", "p")


@query(f"""WITH {SAMPLES}, o AS (SELECT src, epoch_us(ts) AS t, round(ch0, 0) AS v FROM s WHERE ch0 IS NOT NULL)
SELECT a.src, CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s, count(*) AS n_pairs FROM o a JOIN o b ON a.src = b.src AND a.t < b.t GROUP BY 1""")
def sample_trend(t: Tables) -> DataFrame:
    """Rising less falling pairs of all samples of each stream, which are not made."""
    own = samples(t).select("src", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.round("ch0", 0).alias("x"))
    return pairs.signed_pairs(own, ["src"], 64).filter("n_pairs > 0").select("src", "s", "n_pairs")


# Tables of columns, counts and segments


@query(f"WITH {SEGMENTS}, e AS (SELECT src, seg_id, CAST(event_id % 3 = 0 AS INTEGER) AS label FROM p) SELECT src, seg_id, CAST(round_even(avg(label), 0) AS INTEGER) AS label FROM e GROUP BY 1, 2")
def segment_labels(t: Tables) -> DataFrame:
    """A segment's label is the rounded mean of its samples' labels."""
    return splits.segment_label(segments(t).withColumn("l", (F.col("event_id") % 3 == 0).cast("int")), F.col("l"))


@query(f"""WITH {SEGMENTS}, m AS (SELECT src, median(ch0) AS med, (quantile_cont(ch0, 0.75) - quantile_cont(ch0, 0.25)) / 1.349 AS iqr FROM p GROUP BY 1)
SELECT p.src, round(max(med), 6) AS median, round(median(abs(ch0 - med)), 6) AS mad, round(max(iqr), 6) AS iqr FROM p JOIN m USING (src) GROUP BY 1""")
def robust_summary(t: Tables) -> DataFrame:
    """Median, median absolute deviation and scaled interquartile range of each stream."""
    own = segments(t).select("src", "ch0")
    center = own.groupBy("src").agg(F.median("ch0").alias("median"), robust_scale(F.col("ch0")).alias("iqr"))
    made = own.join(center, "src").groupBy("src").agg(F.max("median").alias("median"), mad(F.col("ch0"), F.col("median")).alias("mad"), F.max("iqr").alias("iqr"))
    return rounded(made, 6, "median", "mad", "iqr")


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem
  WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL)
SELECT 'l_quantity' AS feature, round(1 / (1 - (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc)), 6) AS vif FROM c UNION ALL SELECT 'l_extendedprice',
  round(1 / (1 - (ab * ab + bc * bc - 2 * ab * ac * bc) / (1 - ac * ac)), 6) FROM c
UNION ALL SELECT 'l_discount', round(1 / (1 - (ac * ac + bc * bc - 2 * ab * ac * bc) / (1 - ab * ab)), 6) FROM c""")
def vif_table(t: Tables) -> DataFrame:
    """How far each column follows from the others; a row a column."""
    found, _ = stats.vif(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return t.spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "feature string, vif double")


_CELLS = KEYS + """, cl AS (SELECT CAST(src % 5 AS INTEGER) AS fold, count(*) FILTER (WHERE state = 1 AND label = 1) AS a, count(*) FILTER (WHERE state = 1 AND label = 0) AS b,
  count(*) FILTER (WHERE state = 0 AND label = 1) AS c, count(*) FILTER (WHERE state = 0 AND label = 0) AS d FROM k GROUP BY 1)"""


def cells(t: Tables) -> DataFrame:
    hit = lambda s, v: F.count_if((F.col("state") == s) & (F.col("label") == v))
    own = segment_keys(t).groupBy((F.col("src") % FOLDS).cast("int").alias("fold"))
    return own.agg(hit(1, 1).alias("a"), hit(1, 0).alias("b"), hit(0, 1).alias("c"), hit(0, 0).alias("d"))


@query(f"""WITH {_CELLS}, xs AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM cl),
lp AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS m,
  lgamma(x + 1) + lgamma(a + b - x + 1) + lgamma(a + c - x + 1) + lgamma(d - a + x + 1) AS g, lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1) AS g0 FROM xs)
SELECT fold, a, b, c, d, round(CASE WHEN max(b * c) <> 0 THEN max(a * d) / max(b * c)::DOUBLE END, 6) AS odds_ratio, round(least(1.0,
  sum(exp(m - g)) FILTER (WHERE m - g <= m - g0 + 1e-7)), 6) AS p FROM lp GROUP BY fold, a, b, c, d""")
def fisher_by_fold(t: Tables) -> DataFrame:
    """Exact test of label by state in each fold; a row a fold."""
    exact = F.pandas_udf(lambda a, b, c, d: pd.Series([stats.fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)]), "double")
    odds = F.when(F.col("b") * F.col("c") != 0, F.col("a") * F.col("d") / (F.col("b") * F.col("c")))
    return cells(t).select("fold", "a", "b", "c", "d", R(odds, 6).alias("odds_ratio"), R(exact("a", "b", "c", "d"), 6).alias("p"))


@query()
def detection_intervals(t: Tables) -> DataFrame:
    """The share of abnormal segments in state 1 in each fold, with its exact interval; a row a fold."""
    def bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stats.clopper_pearson(int(a), int(b)) if b else (0.0, 1.0) for a, b in zip(k, n, strict=True)], columns=["low", "high"])

    both = F.pandas_udf(bounds, "low double, high double")
    own = cells(t).select("fold", F.col("a").alias("k"), (F.col("a") + F.col("c")).alias("n"))
    return rounded(own.withColumn("_i", both("k", "n")).select("fold", "k", "n", "_i.*"), 8, "low", "high")


@query()
def feature_clusters(t: Tables) -> DataFrame:
    """Groups of segment features that follow each other, and the one that stands for each; a row a feature."""
    columns = ["n", "rms", "peak", "dc", "crest"]
    own = fe.segment_features(segments(t))
    pairs_of = {(r["a"], r["b"]): r["rho"] for r in stats.correlation_pairs(own, columns).collect()}  # as many as pairs of columns
    corr = np.array([[1.0 if a == b else pairs_of.get((a, b), pairs_of.get((b, a))) or 0.0 for b in columns] for a in columns])
    rows = [(member, head, len(group)) for head, group in stats.correlation_clusters(corr, columns, 0.3) for member in group]
    return t.spark.createDataFrame(rows, "feature string, representative string, size int")


# Features of whole windows and channels


_CUM = "OVER (PARTITION BY src, seg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {k} FOLLOWING)"


def _ac_sql(c: str, first: str, last: int) -> str:
    f, p = (f"OVER (PARTITION BY src, seg_id ORDER BY pos ROWS BETWEEN {first} AND {k} FOLLOWING)" for k in (last, last - 1))
    top = f"sum({c} * n_{c}) {p} - avg({c}) {f} * (sum({c}) {p} + sum(n_{c}) {p}) + pow(avg({c}) {f}, 2) * count(*) {p}"
    return f"CASE WHEN max({c}) {f} > min({c}) {f} THEN ({top}) / nullif(count(*) {f} * var_pop({c}) {f}, 0) END"


_ALL = f"""WITH {WINDOWS}, nx AS (SELECT *, lead(ch0) OVER (PARTITION BY src, seg_id ORDER BY pos) AS n_ch0, lead(ch1) OVER (PARTITION BY src, seg_id ORDER BY pos) AS n_ch1 FROM p),
rl AS (SELECT src, seg_id, pos, corr(ch0, ch1) {_CUM.replace('UNBOUNDED PRECEDING', 'CURRENT ROW').format(k=9)} AS corr_win, corr(ch0, ch1) {_CUM.format(k=9)} AS corr_cum,
  {', '.join(f"{_ac_sql(c, 'CURRENT ROW', 9)} AS {c}_ac1_win, {_ac_sql(c, 'UNBOUNDED PRECEDING', 9)} AS {c}_ac1_cum" for c in ('ch0', 'ch1'))} FROM nx)"""


@query(_ALL + f""" SELECT w.src, w.seg_id, w.pos, {_amp_sql('ch0')}, {_amp_sql('ch1')}, round(ch0_rms / nullif(ch1_rms, 0), 5) AS rms_ratio,
  CASE WHEN ch0_hi > ch0_lo AND ch1_hi > ch1_lo THEN round(corr_win, 3) END AS corr_win, round(corr_cum, 3) AS corr_cum,
  round(ch0_ac1_win, 3) AS ch0_ac1_win, round(ch0_ac1_cum, 3) AS ch0_ac1_cum, round(ch1_ac1_win, 3) AS ch1_ac1_win, round(ch1_ac1_cum, 3) AS ch1_ac1_cum FROM w JOIN rl USING (src, seg_id, pos)""")
def full_window_features(t: Tables) -> DataFrame:
    """All features of windows of ten samples of both channels."""
    own = fe.full_windows(segments(t), WIN, STEP)
    own = rounded(own, 4, *(f"{c}_{k}" for c in ("ch0", "ch1") for k in ("rms", "p2p", "crest")))
    own = rounded(own, 3, *(f"{c}_{k}" for c in ("ch0", "ch1") for k in ("kurt", "skew", "shape_crest", "ac1_win", "ac1_cum")), "corr_win", "corr_cum")
    return rounded(own, 5, "rms_ratio").drop("n", "ts")


@query(f"""WITH {SEGMENTS}, y AS (SELECT src, seg_id, pos, n, ch0 - avg(ch0) OVER (PARTITION BY src, seg_id) AS y FROM p), b AS (SELECT src, seg_id, n, kk,
  pow(sum(y * cos(2 * pi() * kk * pos / n)), 2) + pow(sum(y * sin(2 * pi() * kk * pos / n)), 2) AS pw
  FROM y, LATERAL (SELECT unnest(range(1, n // 2 + 1)) AS kk) WHERE n > 1 GROUP BY 1, 2, 3, 4) SELECT src, seg_id,
  round(sum(CASE WHEN kk <= 0.1::DOUBLE * n THEN pw ELSE 0 END) / nullif(sum(pw), 0), 6) AS share FROM b GROUP BY 1, 2""")
def low_frequency_share(t: Tables) -> DataFrame:
    """Power of a segment below a tenth of the sampling rate."""
    return rounded(fe.low_frequency_share(segments(t), "ch0", 0.1), 6, "share")


@query(f"""WITH {SAMPLES}, d AS (SELECT DISTINCT src, ch0 AS v FROM s WHERE ch0 IS NOT NULL), st AS (SELECT src, v, v - lag(v) OVER (PARTITION BY src ORDER BY v) AS step FROM d)
SELECT src, round(max(v) - min(v), 6) AS range, round(min(step), 9) AS step, CASE WHEN min(step) > 0 THEN CAST(ceil(log2((max(v) - min(v)) / min(step) + 1) - 1e-9) AS BIGINT) END AS bits FROM st GROUP BY 1""")
def channel_resolution(t: Tables) -> DataFrame:
    """Bits that a code of a channel's least steps takes for its range."""
    return rounded(rounded(fe.resolution(samples(t), "ch0"), 6, "range"), 9, "step")


_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(max(abs({a} - {b})), 6) AS most, max(abs({a} - {b})) < 1e-9 AS same FROM lineitem" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]))
def duplicate_column_scan(t: Tables) -> DataFrame:
    """Every pair of the items' numbers: how far they depart at most."""
    return rounded(stats.duplicate_columns(t.lineitem, list(_COLUMNS)), 6, "most")


_TREND = f"""WITH RECURSIVE {KEYS}, x AS (SELECT src, seg_id, ln(greatest(rms0, 1e-6)) AS x, src % 5 <> 0 AND label = 0 AS train FROM k), i0 AS (SELECT median(x) AS m FROM x WHERE train),
e AS (SELECT x.src, x.seg_id, x.train, 0.2 * x.x + 0.8 * m AS s FROM x CROSS JOIN i0 WHERE x.seg_id = 0 UNION ALL SELECT x.src, x.seg_id, x.train, 0.2 * x.x + 0.8 * e.s FROM e
  JOIN x ON x.src = e.src AND x.seg_id = e.seg_id + 1),
tq AS (SELECT quantile_cont(s, 0.95) AS thr FROM e WHERE train)"""


@query(_TREND + " SELECT src, seg_id, round(s, 6) AS trend, round(thr, 6) AS thr, s > thr AS alert FROM e CROSS JOIN tq")
def trend_alerts(t: Tables) -> DataFrame:
    """The average of a burst's log level against that of four users' normal bursts."""
    own = segment_keys(t).withColumn("x", F.log(F.greatest("rms0", F.lit(1e-6))))
    return rounded(warning.trend_alerts(own, "x", (F.col("src") % 5 != 0) & (F.col("label") == 0), 0.2, 0.95), 6, "trend", "thr")


@query("""WITH u AS (SELECT z.feature, z.x FROM lineitem, LATERAL (SELECT unnest([{'feature': 'l_quantity', 'x': l_quantity}, {'feature': 'l_extendedprice', 'x': l_extendedprice}]) AS z) WHERE z.x IS NOT NULL),
w AS (SELECT feature, 'none' AS transform, x AS y FROM u UNION ALL SELECT feature, 'log1p', ln(x + 1) FROM u),
m AS (SELECT feature, transform, count(*)::DOUBLE AS n, avg(y) AS mean, stddev_samp(y) AS sd FROM w GROUP BY 1, 2), c AS (SELECT w.feature, w.transform, avg(pow(y - mean,
  2)) AS m2, avg(pow(y - mean, 3)) AS m3, avg(pow(y - mean, 4)) AS m4 FROM w JOIN m ON m.feature = w.feature AND m.transform = w.transform GROUP BY 1, 2)
SELECT feature, transform, CAST(n AS BIGINT) AS n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 5) AS skew,
  round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), 4) AS kurt FROM m JOIN c USING (feature, transform)""")
def transform_effect(t: Tables) -> DataFrame:
    """Shape of two columns as they are and as logarithms."""
    return rounded(rounded(stats.transform_effect(t.lineitem, ["l_quantity", "l_extendedprice"]), 5, "mean", "sd", "skew"), 4, "kurt")


@query()
def pca_loadings(t: Tables) -> DataFrame:
    """Components of the items' numbers: what they explain, and which columns they load on; a row a component and column."""
    rows, _ = stats.loadings_ranking(t.lineitem, list(_COLUMNS))
    made = t.spark.createDataFrame(rows, "component int, explained double, cumulative double, feature string, loading double, rank int")
    return rounded(made, 6, "explained", "cumulative", "loading")


@query(f"""WITH {KEYS}, b AS (SELECT src, CAST(epoch_us(start) AS DOUBLE) / 1e6::DOUBLE AS t, round(rms0, 6) AS z FROM k), w AS (SELECT src, min(t) + 86400 AS t0, max(t) AS crit FROM b GROUP BY 1),
h AS (SELECT src, max(crit) - min(CASE WHEN z > 80 AND t >= t0 THEN t END) AS la, max(crit) - min(CASE WHEN z > 60 AND t >= t0 THEN t END) AS lb FROM b JOIN w USING (src)
  GROUP BY 1), gn AS (SELECT *, lb - la AS gain FROM h)
SELECT count(gain) AS n_both, count(*) FILTER (WHERE la IS NOT NULL AND lb IS NULL) AS n_only_first, count(*) FILTER (WHERE la IS NULL AND lb IS NOT NULL) AS n_only_second,
  round(avg(gain), 3) AS mean_gain, round(median(gain), 3) AS median_gain,
  round(avg(CASE WHEN gain > 0 THEN 1.0::DOUBLE WHEN gain <= 0 THEN 0.0 END), 6) AS share_gain FROM gn""")
def paired_gain(t: Tables) -> DataFrame:
    """How much earlier a lower limit warns than a higher one, stream by stream."""
    own = segment_keys(t).select("src", "seg_id", (F.unix_micros(F.col("start").cast("timestamp")) / 1e6).alias("t"), F.round("rms0", 6).alias("z"))
    window = own.groupBy("src").agg((F.min("t") + 86400).alias("t0"), F.max("t").alias("crit"))
    leads = None
    for rule, limit in (("high", 80.0), ("low", 60.0)):
        alerts = own.join(window, "src").withColumn("alert", F.col("z") > limit)
        made = warning.lead_times(alerts, "src", "t", F.col("t0"), F.col("crit")).select("src", F.lit(rule).alias("rule"), "lead")
        leads = made if leads is None else leads.unionByName(made)
    return rounded(rounded(warning.paired_gain(leads, ["src"], "rule", "high", "low"), 3, "mean_gain", "median_gain"), 6, "share_gain")
