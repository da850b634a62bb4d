"""Queries over window features of several lengths, signal checks, and tables that detection is reported by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.storage import checkpoint
from gapwise.operators import evaluate as ev, features as fe, reports as rp
from gapwise.operators.segments import in_segment
from gapwise.plans.base import KEYS, SAMPLES, SCORES, SEGMENTS, STEP, THRESHOLD, marked, samples, scores, segment_keys, segments
from gapwise.plans.queries_scores import above, calibrated
from gapwise.plans.registry import Tables, query

R = lambda c, d=4: F.round(F.col(c) if isinstance(c, str) else c, d)
WINS = (10, 20, 30)


def rounded(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    return frame.withColumns({c: R(c, digits) for c in columns})


def _window_sql(win: int) -> str:
    f, p, c = (f"OVER (PARTITION BY src, seg_id ORDER BY pos ROWS BETWEEN {a} AND {b} FOLLOWING)" for a, b in (("CURRENT ROW", win - 1), ("CURRENT ROW", win - 2), ("UNBOUNDED PRECEDING", win - 1)))
    return f"""SELECT src, seg_id, pos, n, {win} AS win, sqrt(avg(ch0 * ch0) {f}) AS rms0, sqrt(avg(ch1 * ch1) {f}) AS rms1, max(abs(ch0)) {f} AS peak0,
  max(ch0) {f} - min(ch0) {f} AS p2p0, max(ch0) {f} > min(ch0) {f} AS s0, max(ch1) {f} > min(ch1) {f} AS s1, corr(ch0, ch1) {f} AS cw, corr(ch0, ch1) {c} AS cc,
  (sum(ch0 * nx) {p} - avg(ch0) {f} * (sum(ch0) {p} + sum(nx) {p}) + pow(avg(ch0) {f}, 2) * {win - 1}) / nullif({win} * var_pop(ch0) {f}, 0) AS ac FROM nx"""


_WF = f"""WITH {SEGMENTS}, nx AS (SELECT *, lead(ch0) OVER (PARTITION BY src, seg_id ORDER BY pos) AS nx FROM p),
wf AS ({' UNION ALL '.join(map(_window_sql, WINS))}), wk AS (SELECT * FROM wf WHERE pos % 5 = 0 AND pos + win <= n)"""


def feature_windows(t: Tables) -> DataFrame:
    return fe.window_features(segments(t), WINS, STEP)


@query(_WF + """ SELECT src, seg_id, pos, n, win, round(rms0, 4) AS rms0, round(rms1, 4) AS rms1, peak0, round(p2p0, 4) AS p2p0, round(rms0 / nullif(rms1, 0), 5) AS rms_ratio,
CASE WHEN s0 AND s1 THEN round(cw, 3) END AS corr_win, CASE WHEN s0 THEN round(ac, 3) END AS ac1_win, round(cc, 3) AS corr_cum FROM wk""")
def window_features(t: Tables) -> DataFrame:
    return rounded(rounded(rounded(feature_windows(t), 4, "rms0", "rms1", "p2p0"), 3, "corr_win", "ac1_win", "corr_cum"), 5, "rms_ratio")


@query(_WF + """, f AS (SELECT win, CAST((src + seg_id) % 7 = 0 AS INTEGER) AS label, src, seg_id, round(rms0, 6) AS x FROM wk),
r AS (SELECT *, rank() OVER (PARTITION BY win ORDER BY x) + (count(*) OVER (PARTITION BY win, x) - 1) / 2.0 AS rk FROM f),
a AS (SELECT win, count(*) AS n_windows, count(DISTINCT CASE WHEN label = 0 THEN src * 1000000 + seg_id END) AS n_normal, count(DISTINCT CASE WHEN label = 1 THEN src * 1000000 + seg_id END) AS n_abnormal,
  (sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM r GROUP BY win)
SELECT win, n_normal, n_abnormal, n_windows, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS symmetric FROM a""")
def window_length_auc(t: Tables) -> DataFrame:
    own = marked(feature_windows(t)).withColumn("rms0", R("rms0", 6))
    return rounded(rp.window_length_auc(own, "rms0"), 6, "auc", "symmetric")


_SF = f"""WITH {SEGMENTS}, sf AS (SELECT src, seg_id, count(*) AS n, min(ts) AS start, sqrt(avg(ch0 * ch0)) AS rms, max(abs(ch0)) AS peak, avg(ch0) AS dc, max(ch0) > min(ch0) AS spread,
  avg(ch0) AS m1, avg(pow(ch0, 2)) AS m2, avg(pow(ch0, 3)) AS m3, avg(pow(ch0, 4)) AS m4, CAST((src + seg_id) % 2 AS INTEGER) AS state, CAST((src + seg_id) % 7 = 0 AS INTEGER) AS label FROM p GROUP BY src, seg_id)"""


def table_of_segments(t: Tables) -> DataFrame:
    return marked(fe.segment_features(segments(t)))


@query(_SF + """ SELECT src, seg_id, n, start, round(rms, 4) AS rms, peak, round(dc, 6) AS dc, round(peak / nullif(rms, 0), 4) AS crest,
CASE WHEN n > 3 AND spread THEN round((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4)) / pow(m2 - m1 * m1, 2) - 3, 3) END AS kurt FROM sf""")
def segment_features(t: Tables) -> DataFrame:
    own = fe.segment_features(segments(t))
    return rounded(rounded(rounded(own, 4, "rms", "crest"), 6, "dc"), 3, "kurt")


@query(_SF + """, c AS (SELECT src, seg_id, concat_ws('+', CASE WHEN n < 10 THEN 'short' END, CASE WHEN peak > 400 THEN 'peak' END, CASE WHEN rms > 120 THEN 'rms' END) AS criteria FROM sf)
SELECT * FROM c WHERE criteria <> ''""")
def suspect_segments(t: Tables) -> DataFrame:
    own = table_of_segments(t)
    return fe.suspects(own, {"short": F.col("n") < 10, "peak": F.col("peak") > 400, "rms": F.col("rms") > 120}).select("src", "seg_id", "criteria")


@query(_SF + """ SELECT state, count(*) AS n, round(count(*) / (SELECT count(*) FROM sf)::DOUBLE, 6) AS share, round(avg(rms), 4) AS rms, round(avg(dc), 4) AS dc FROM sf GROUP BY state""")
def state_summary(t: Tables) -> DataFrame:
    return rounded(rounded(fe.state_summary(table_of_segments(t), "state", ["rms", "dc"]), 4, "rms", "dc"), 6, "share")


@query(_SF + """ SELECT state, count(*) AS n, round(avg(CASE WHEN (CASE WHEN round(rms, 6) > 70 THEN 0 ELSE 1 END) = state THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM sf GROUP BY state""")
def state_accuracy(t: Tables) -> DataFrame:
    return rounded(rp.state_accuracy(table_of_segments(t).withColumn("rms", R("rms", 6)), "rms", 70.0), 6, "accuracy")


@query(_SF + """, u AS (SELECT 'rms' AS feature, label, round(rms, 6) AS x FROM sf UNION ALL SELECT 'peak', label, peak FROM sf UNION ALL SELECT 'dc', label, round(abs(dc), 6) FROM sf
  UNION ALL SELECT 'dc_share', label, round(abs(dc) / nullif(rms, 0), 8) FROM sf), r AS (SELECT *, rank() OVER (PARTITION BY feature
  ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM u WHERE x IS NOT NULL),
a AS (SELECT feature, (sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc, CAST(sum(label) AS BIGINT) AS n_pos,
  CAST(count(*) - sum(label) AS BIGINT) AS n_neg FROM r GROUP BY 1)
SELECT feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS symmetric, n_pos, n_neg FROM a""")
def feature_auc(t: Tables) -> DataFrame:
    """Each feature's AUC, and that of the offset and its share of the RMS, which should tell nothing."""
    own = table_of_segments(t)
    own = own.select("label", R("rms", 6).alias("rms"), "peak", R(F.abs("dc"), 6).alias("dc"), R(F.when(F.col("rms") != 0, F.abs("dc") / F.col("rms")), 8).alias("dc_share"))
    return rounded(fe.feature_auc(own, ["rms", "peak", "dc", "dc_share"]), 6, "auc", "symmetric")


@query(f"""WITH {SEGMENTS}, m AS (SELECT *, ch0 - avg(ch0) OVER (PARTITION BY src, seg_id) AS y FROM p), l AS (SELECT unnest([0, 1, 2, 3, 4]) AS lag)
SELECT a.src, a.seg_id, lag, round(coalesce(sum(a.y * b.y), 0) / nullif(max(v.s), 0), 4) AS value FROM m a CROSS JOIN l LEFT JOIN m b ON b.src = a.src AND b.seg_id = a.seg_id AND b.pos = a.pos - lag
JOIN (SELECT src, seg_id, sum(y * y) AS s FROM m GROUP BY 1, 2) v ON v.src = a.src AND v.seg_id = a.seg_id GROUP BY 1, 2, 3""")
def autocorrelation_lags(t: Tables) -> DataFrame:
    return rounded(fe.autocorrelations(segments(t), "ch0", 4), 4, "value")


@query(f"""WITH {SAMPLES}, d AS (SELECT DISTINCT src, ch0 AS v FROM s WHERE ch0 IS NOT NULL), l AS (SELECT *, v - lag(v) OVER (PARTITION BY src ORDER BY v) AS step FROM d)
SELECT src, count(*) AS n_values, round(min(step), 6) AS min_step, bool_and(v::FLOAT::DOUBLE = v) AS float_exact, round(quantile_cont(step, 0.01), 6) AS p1_step FROM l GROUP BY src""")
def value_steps(t: Tables) -> DataFrame:
    return rounded(fe.value_steps(samples(t), "ch0"), 6, "min_step", "p1_step")


@query(f"""WITH {SAMPLES} SELECT src, max(top) AS top, count(*) FILTER (WHERE abs(ch0) = top) AS n_top, count(*) FILTER (WHERE abs(ch0) >= 0.99 * top) AS n_near
FROM s JOIN (SELECT src, max(abs(ch0)) AS top FROM s GROUP BY 1) USING (src) GROUP BY src""")
def clipping(t: Tables) -> DataFrame:
    return fe.clipping(samples(t), "ch0")


@query(f"""WITH {SAMPLES}, d AS (SELECT src, CASE WHEN ch0 = floor(ch0) THEN 0 WHEN abs(ch0 * 10 - round(ch0 * 10)) < 1e-6 THEN 1 ELSE 2 END AS d, count(*) AS k FROM s GROUP BY 1, 2)
SELECT src, CAST(arg_max(d, k * 10 - d) AS INTEGER) AS mode, round(max(k) / sum(k)::DOUBLE, 6) AS share, min(d) AS least, max(d) AS most FROM d GROUP BY src""")
def decimals(t: Tables) -> DataFrame:
    return rounded(fe.decimals(samples(t), "ch0"), 6, "share")


@query(f"""WITH {SEGMENTS} SELECT src, seg_id, CASE WHEN count(*) >= 3 AND max(ch0) > min(ch0) THEN round(pow(corr(pos, ch0), 2), 4) END AS r2,
round((avg(ch0) FILTER (WHERE pos >= n / 2.0) - avg(ch0) FILTER (WHERE pos < n / 2.0)) / nullif(stddev_pop(ch0), 0), 4) AS half_shift FROM p GROUP BY src, seg_id""")
def offset_constancy(t: Tables) -> DataFrame:
    return rounded(fe.offset_constancy(segments(t)), 4, "r2", "half_shift")


_GAP = f"""WITH {SEGMENTS}, g0 AS (SELECT *, pos % 4 = 2 AS m, CASE WHEN pos % 4 <> 2 THEN ch0 END AS x FROM p),
g1 AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM g0 WINDOW w AS (PARTITION BY src, seg_id ORDER BY pos))"""


@query(_GAP + """ SELECT src, event_id, round(coalesce(x, (a + b) / 2, a, b), 8) AS filled FROM g1""")
def gap_fill(t: Tables) -> DataFrame:
    """Every fourth sample is taken out and filled by a line; it has neighbours, or one at an end."""
    own = segments(t).withColumn("x", F.when(F.col("pos") % 4 != 2, F.col("ch0")))
    return fe.filled(own, "x").select("src", "event_id", R("filled", 8).alias("filled"))


@query(_GAP + """, f AS (SELECT ch0, coalesce(x, (a + b) / 2, a, b) AS f, 0.0::DOUBLE AS z FROM g1 WHERE m)
SELECT 'linear' AS method, count(*) AS n, round(1 - sum(pow(ch0 - f, 2)) / (var_pop(ch0) * count(*)), 6) AS r2, round(sqrt(sum(pow(ch0 - f, 2)) / count(*)) / stddev_pop(ch0), 6) AS nrmse FROM f
UNION ALL SELECT 'zero', count(*), round(1 - sum(pow(ch0 - z, 2)) / (var_pop(ch0) * count(*)), 6), round(sqrt(sum(pow(ch0 - z, 2)) / count(*)) / stddev_pop(ch0), 6) FROM f""")
def masked_reconstruction(t: Tables) -> DataFrame:
    own = segments(t)
    made = [fe.masked_reconstruction(own, "ch0", F.col("pos") % 4 == 2, m).select(F.lit(m).alias("method"), "*") for m in ("linear", "zero")]
    return rounded(made[0].unionByName(made[1]), 6, "r2", "nrmse")


@query(f"""WITH {SAMPLES}, i AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY src ORDER BY ts, event_id) - 1) * 10 / count(*) OVER (PARTITION BY src)) AS INTEGER) AS part FROM s)
SELECT src, part, count(*) AS n, round(avg(ch0), 6) AS mean, round(sqrt(avg(ch0 * ch0)), 4) AS rms FROM i GROUP BY 1, 2""")
def row_deciles(t: Tables) -> DataFrame:
    return rounded(rounded(fe.row_deciles(samples(t), "ch0"), 6, "mean"), 4, "rms")


@query(f"""WITH {SCORES}, k AS (SELECT DISTINCT src, seg_id FROM sc WHERE label = 0), pl AS (SELECT *, (row_number() OVER (PARTITION BY src
  ORDER BY seg_id) - 1) / (count(*) OVER (PARTITION BY src))::DOUBLE AS place FROM k),
o AS (SELECT sc.*, place, f AS fraction FROM sc JOIN pl USING (src, seg_id) CROSS JOIN (SELECT unnest([0.4::DOUBLE, 0.6::DOUBLE]) AS f) WHERE label = 0),
h AS (SELECT fraction, quantile_cont(score, 0.9) AS thr FROM o WHERE place < fraction GROUP BY 1),
g2 AS (SELECT fraction, src, seg_id, max(thr) AS thr, bool_or(score > thr) AS a, count(*) AS n, count(*) FILTER (WHERE score > thr) AS k FROM o JOIN h USING (fraction) WHERE place >= fraction GROUP BY 1, 2, 3)
SELECT fraction, round(max(thr), 5) AS thr, round(sum(k) / sum(n)::DOUBLE, 6) AS fpr_sample, round(avg(a::INTEGER), 6) AS fpr_segment, count(*) AS n_segments FROM g2 GROUP BY fraction""")
def leak_free_rates(t: Tables) -> DataFrame:
    return rounded(rounded(rp.leak_free_rates(scores(t), [0.4, 0.6], 0.9), 5, "thr"), 6, "fpr_sample", "fpr_segment")


_ALARMS = f"""WITH {THRESHOLD}, a AS (SELECT src, seg_id, max(label) AS label, bool_or(hit = 1) AS alarm, min(CASE WHEN hit = 1 THEN t END) + 0.9::DOUBLE AS delay, max(fold) AS fold FROM st GROUP BY src, seg_id),
ks AS (SELECT src, seg_id, count(*) AS n, CAST((src + seg_id) % 7 = 0 AS INTEGER) AS label FROM p GROUP BY src, seg_id)"""


@query(_ALARMS + """ SELECT src, seg_id, n, round(delay, 4) AS delay, CASE WHEN n < 10 THEN 'too-short' WHEN coalesce(alarm, false) THEN 'detected' ELSE 'no-alarm' END AS reason
FROM ks LEFT JOIN a USING (src, seg_id) WHERE ks.label = 1""")
def delay_reasons(t: Tables) -> DataFrame:
    return rounded(rp.delay_table(segment_keys(t), ev.segment_alarms(above(t)), 10), 4, "delay")


@query(_ALARMS + """, c AS (SELECT fold, count(*) FILTER (WHERE label = 1 AND alarm) AS tp, count(*) FILTER (WHERE label = 0 AND alarm) AS fp,
  count(*) FILTER (WHERE label = 1 AND NOT alarm) AS fn, count(*) FILTER (WHERE label = 0 AND NOT alarm) AS tn FROM a GROUP BY fold),
s2 AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, (SELECT count(*) FROM ks WHERE label = 1 AND n < 10) AS miss FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS "precision",
  round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, CAST(fn + miss AS BIGINT) AS fn_all, round(tp / nullif(tp + fn + miss, 0)::DOUBLE, 6) AS recall_all,
  round(2 * tp / nullif(2 * tp + fp + fn + miss, 0)::DOUBLE, 6) AS f1_all FROM s2""")
def pooled_confusion(t: Tables) -> DataFrame:
    """Counts of all folds pooled; abnormal segments too short for a window count as missed in fn_all."""
    by_fold = ev.confusion(ev.segment_alarms(above(t)).withColumn("fold", (F.col("src") % 5).cast("int")), ["fold"])
    miss = segment_keys(t).filter("label = 1 and n < 10").agg(F.count("*").alias("miss"))
    out = rp.with_undetermined(rp.pooled(by_fold).crossJoin(F.broadcast(miss)), F.col("miss")).drop("miss")
    return rounded(out, 6, "precision", "recall", "f1", "recall_all", "f1_all")


@query(f"""WITH {THRESHOLD}, x AS (SELECT state, src, seg_id, bool_or(hit = 1) AS a, count(*) AS n, sum(hit) AS k FROM st WHERE label = 0 GROUP BY 1, 2, 3)
SELECT state, round(sum(k) / sum(n)::DOUBLE, 6) AS fpr_sample, round(avg(a::INTEGER), 6) AS fpr_segment, count(*) AS n_segments FROM x GROUP BY state""")
def state_rates(t: Tables) -> DataFrame:
    return rounded(rp.state_rates(above(t)), 6, "fpr_sample", "fpr_segment")


@query(f"""WITH {SCORES}, m AS (SELECT state, src, seg_id, max(score) AS stat FROM sc WHERE label = 0 GROUP BY 1, 2, 3), r AS (SELECT state, stat,
  row_number() OVER (PARTITION BY state ORDER BY stat DESC, src, seg_id) AS rk, count(*) OVER (PARTITION BY state) AS total FROM m),
goal AS (SELECT unnest([0.05::DOUBLE, 0.2::DOUBLE]) AS target)
SELECT state, target, total, CAST(floor(target * total + 1e-9) AS BIGINT) AS m, stat AS thr FROM r JOIN goal ON rk = least(floor(target * total + 1e-9) + 1, total)""")
def state_operating_points(t: Tables) -> DataFrame:
    return rp.state_operating_points(scores(t), [0.05, 0.2], [0, 1])


def _rule_sql(name: str, k: int, n: int) -> str:
    return f"""SELECT '{name}' AS rule, label, src, seg_id, bool_or(h >= {k}) AS alarm, min(CASE WHEN h >= {k} THEN t END) + 0.9::DOUBLE AS delay
  FROM (SELECT *, sum(hit) OVER (PARTITION BY src, seg_id ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS h FROM st) GROUP BY label, src, seg_id"""


@query(f"""WITH {THRESHOLD}, a AS ({_rule_sql('any', 1, 1)} UNION ALL {_rule_sql('2of3', 2, 3)}),
c AS (SELECT rule, count(*) FILTER (WHERE label = 1 AND alarm) AS tp, count(*) FILTER (WHERE label = 0 AND alarm) AS fp, count(*) FILTER (WHERE label = 1 AND NOT alarm) AS fn,
  count(*) FILTER (WHERE label = 0 AND NOT alarm) AS tn, avg(delay) FILTER (WHERE label = 1) AS mean_delay FROM a GROUP BY rule)
SELECT rule, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn,
  0)::DOUBLE, 6) AS f1, round(mean_delay, 4) AS mean_delay FROM c""")
def rule_metrics(t: Tables) -> DataFrame:
    out = rp.rule_metrics(above(t), {"any": ("any", 1, 1), "2of3": ("kofn", 2, 3)})
    return rounded(rounded(out, 6, "precision", "recall", "f1"), 4, "mean_delay")


@query(f"""WITH {SCORES}, l AS (SELECT *, list_sort(list(score) OVER (PARTITION BY src, seg_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 'DESC') AS z FROM sc),
m AS (SELECT src, seg_id, max(label) AS label, max(score) AS mx, avg(score) AS mn, max(z[2]) AS kn FROM l GROUP BY 1, 2),
u AS (SELECT 'max' AS way, label, mx AS x FROM m UNION ALL SELECT 'mean', label, mn FROM m UNION ALL SELECT 'kofn', label, kn FROM m), h AS (SELECT way, quantile_cont(x, 0.9) AS thr FROM u WHERE label = 0 GROUP BY 1)
SELECT way, round(max(thr), 5) AS thr, count(*) FILTER (WHERE label = 1 AND x > thr) AS tp, count(*) FILTER (WHERE label = 0 AND x > thr) AS fp FROM u JOIN h USING (way) GROUP BY way""")
def segment_score_ways(t: Tables) -> DataFrame:
    return rounded(rp.aggregated_scores(scores(t), 0.9), 5, "thr")


@query("""WITH x AS (SELECT CAST(n_chars AS DOUBLE) AS thr, sum(quality) AS pos, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
c AS (SELECT thr, sum(pos) OVER w AS tp, sum(n) OVER w AS up, sum(pos) OVER () AS p FROM x WINDOW w AS (ORDER BY thr DESC)), r AS (SELECT thr, tp / up::DOUBLE AS pr, tp / nullif(p, 0)::DOUBLE AS rc FROM c)
SELECT thr, round(pr, 6) AS "precision", round(rc, 6) AS recall FROM r WHERE rc IS NOT NULL ORDER BY round(abs(pr - rc), 9), thr DESC LIMIT 1""")
def equal_error_threshold(t: Tables) -> DataFrame:
    own = t.documents.join(t.labels, "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
    return rounded(rp.equal_error_threshold(own), 6, "precision", "recall")


@query()
def bootstrap_auc(t: Tables) -> DataFrame:
    """AUC of either score, and of their difference, with intervals over resampled segments."""
    areas = checkpoint(rp.resampled_auc(scores(t), ["score", "score2"], 100, 3))  # a row a resample
    auc = {"score": F.col("score"), "score2": F.col("score2"), "difference": F.col("score") - F.col("score2")}
    made = [rp.interval(areas.select(c.alias("auc")), "auc").select(F.lit(name).alias("what"), "*") for name, c in auc.items()]
    return rounded(made[0].unionByName(made[1]).unionByName(made[2]), 6, "mean", "lo", "hi", "p")


@query()
def bootstrap_fpr_difference(t: Tables) -> DataFrame:
    own = calibrated(t).groupBy("src", "seg_id").agg(F.max("label").alias("label"), F.bool_or(F.col("z1") > 1).alias("a"), F.bool_or((F.col("z1") > 1) & (F.col("z2") > 1)).alias("b"))
    return rounded(rp.bootstrap_rate_difference(own, 200, 3, "b", "a"), 6, "mean", "lo", "hi", "p")


_Z = f"""WITH {SCORES}, th AS (SELECT quantile_cont(score, 0.9) AS a, quantile_cont(score2, 0.9) AS b FROM sc WHERE label = 0), z AS (SELECT sc.*, score / a AS z1, score2 / b AS z2 FROM sc CROSS JOIN th),
ks AS (SELECT src, seg_id, count(*) AS n FROM p GROUP BY src, seg_id)"""


@query(_Z + """, x AS (SELECT src, seg_id, count(*) AS k, bool_or(z1 > 1 OR z2 > 1) AS c, bool_or(z1 > 1 AND z2 > 1) AS a, min(CASE WHEN z1 > 1 OR z2 > 1 THEN t END) AS fc,
  min(CASE WHEN z1 > 1 AND z2 > 1 THEN t END) AS fa FROM z GROUP BY 1, 2)
SELECT src, seg_id, n, coalesce(k, 0) AS n_windows, k IS NOT NULL AS judgable, c::INTEGER AS caution, a::INTEGER AS alarm, fc AS first_caution, fa AS first_alarm,
  CASE WHEN k IS NULL THEN 'shorter than 10 samples' END AS note
FROM ks LEFT JOIN x USING (src, seg_id)""")
def predictions(t: Tables) -> DataFrame:
    return rp.predictions(calibrated(t), segment_keys(t), 10)


@query(_Z + """, c AS (SELECT count(*) FILTER (WHERE NOT coalesce(z1 >= 0 AND z2 >= 0, false)) AS a, count(*) FILTER (WHERE NOT coalesce(least(z1, z2) <= greatest(z1, z2),
  false)) AS b, count(*) FILTER (WHERE NOT coalesce(t % 5 = 0, false)) AS c, count(*) FILTER (WHERE NOT coalesce(z1 > 0.5, false)) AS d FROM z)
SELECT 'not_negative' AS "check", a AS n_bad, a = 0 AS ok FROM c UNION ALL SELECT 'alarm_in_caution', b, b = 0 FROM c UNION ALL SELECT 'on_the_grid', c, c = 0 FROM c UNION ALL SELECT 'loud', d, d = 0 FROM c""")
def contract_checks(t: Tables) -> DataFrame:
    z1, z2 = F.col("z1"), F.col("z2")
    return rp.contract_checks(calibrated(t), {"not_negative": (z1 >= 0) & (z2 >= 0), "alarm_in_caution": F.least(z1, z2) <= F.greatest(z1, z2), "on_the_grid": F.col("t") % 5 == 0, "loud": z1 > 0.5})


@query(f"""WITH {THRESHOLD}, m AS (SELECT label, state, score / nullif(thr, 0) AS x FROM st)
SELECT label, state, round(quantile_cont(x, 0.05), 5) AS p5, round(quantile_cont(x, 0.5), 5) AS p50, round(quantile_cont(x, 0.95), 5) AS p95, count(x) AS n FROM m GROUP BY 1, 2""")
def score_margins(t: Tables) -> DataFrame:
    return rounded(rp.margins(above(t), ["label", "state"]), 5, "p5", "p50", "p95")


@query(f"""WITH {SCORES}, f AS (SELECT unnest([0, 1, 2, 3, 4]) AS k) SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE fold <> k) AS train_windows,
  count(DISTINCT CASE WHEN fold <> k THEN src * 1000000 + seg_id END) AS train_segments,
count(*) FILTER (WHERE fold = k) AS test_windows, count(DISTINCT CASE WHEN fold = k THEN src * 1000000 + seg_id END) AS test_segments FROM sc CROSS JOIN f GROUP BY k""")
def split_sizes(t: Tables) -> DataFrame:
    seg = scores(t).groupBy("fold", "src", "seg_id").agg(F.count("*").alias("n"))
    own = seg.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    test = F.col("fold") == F.col("k")
    return own.groupBy("k").agg(
        F.sum(F.when(~test, F.col("n")).otherwise(0)).alias("train_windows"), F.count_if(~test).alias("train_segments"), F.sum(F.when(test, F.col("n")).otherwise(0)).alias("test_windows"), F.count_if(test).alias("test_segments")
    )


_BURST = f"""WITH {SCORES}, th AS (SELECT quantile_cont(score, 0.9) AS a, quantile_cont(score2, 0.9) AS b FROM sc WHERE label = 0),
bt AS (SELECT src, seg_id, avg(score / a) AS zc_mean, max(score / a) AS zc_max, max(score2 / b) AS zm_max, max(least(score / a, score2 / b)) AS z_and FROM sc CROSS JOIN th GROUP BY 1, 2)"""


def burst_table(t: Tables) -> DataFrame:
    z1, z2 = F.col("z1"), F.col("z2")
    return calibrated(t).groupBy("src", "seg_id").agg(F.avg(z1).alias("zc_mean"), F.max(z1).alias("zc_max"), F.max(z2).alias("zm_max"), F.max(F.least(z1, z2)).alias("z_and"))


@query(_BURST + " SELECT src, seg_id, round(zc_mean, 5) AS zc_mean, round(zc_max, 5) AS zc_max, round(zm_max, 5) AS zm_max, round(z_and, 5) AS z_and FROM bt")
def burst_scores(t: Tables) -> DataFrame:
    return rounded(burst_table(t), 5, "zc_mean", "zc_max", "zm_max", "z_and")


@query(_BURST + """ SELECT src, seg_id, zc_max > 1 AS cnn, z_and > 1 AS alarm, zc_max > 1 OR round(zc_mean, 9) > 0.9 AS trend FROM bt""")
def burst_alerts(t: Tables) -> DataFrame:
    own, high = burst_table(t), F.col("zc_max") > 1
    return own.select("src", "seg_id", high.alias("cnn"), (F.col("z_and") > 1).alias("alarm"), (high | (F.round("zc_mean", 9) > 0.9)).alias("trend"))


@query(f"""WITH {SEGMENTS}, m AS (SELECT src, seg_id, max(abs(ch0 - ch1)) AS d01, max(abs(ch0 - ch0 * 1.0)) AS d00 FROM p GROUP BY 1, 2)
SELECT 'ch0' AS a, 'ch1' AS b, round(max(d01), 6) AS most, max(d01) < 1e-9 AS same FROM m UNION ALL SELECT 'ch0', 'twin', round(max(d00), 6), max(d00) < 1e-9 FROM m""")
def duplicate_columns(t: Tables) -> DataFrame:
    own = segments(t).select("ch0", "ch1", (F.col("ch0") * 1.0).alias("twin"))
    made = own.agg(*(F.max(F.abs(F.col("ch0") - F.col(c))).alias(c) for c in ("ch1", "twin"))).unpivot([], ["ch1", "twin"], "b", "most")
    return made.select(F.lit("ch0").alias("a"), "b", R("most", 6).alias("most"), (F.col("most") < 1e-9).alias("same"))


@query(f"""WITH {SEGMENTS}, r AS (SELECT *, 4 * least(1, greatest(0, (pos - 5) / 10.0::DOUBLE)) AS severity FROM p) SELECT src, event_id, round(severity, 6) AS severity, round(ch0 * (1 + severity), 6) AS degraded FROM r""")
def degradation_ramp(t: Tables) -> DataFrame:
    """A fault that grows from the sixth sample of a segment to four times its size ten samples later."""
    own = segments(t).withColumn("severity", 4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("pos") - 5) / 10.0)))
    return own.select("src", "event_id", R("severity", 6).alias("severity"), R(F.col("ch0") * (1 + F.col("severity")), 6).alias("degraded"))


@query(f"""WITH {SEGMENTS}, c AS (SELECT *, CASE WHEN pos < 5 THEN 'start' WHEN pos < 20 THEN 'middle' ELSE 'late' END AS part FROM p) SELECT part, count(*) AS n, round(avg(ch0),
  6) AS mean, round(stddev_pop(ch0), 5) AS sd FROM c GROUP BY part""")
def position_bins(t: Tables) -> DataFrame:
    part = F.when(F.col("pos") < 5, "start").when(F.col("pos") < 20, "middle").otherwise("late")
    return segments(t).groupBy(part.alias("part")).agg(F.count("*").alias("n"), R(F.avg("ch0"), 6).alias("mean"), R(F.stddev_pop("ch0"), 5).alias("sd"))


@query(_BURST + """, s3 AS (SELECT src, seg_id, ln(zc_mean) AS x, row_number() OVER (PARTITION BY src ORDER BY seg_id) AS i FROM bt WHERE zc_mean > 0), s4 AS (SELECT *,
  x - lag(x) OVER (PARTITION BY src ORDER BY i) AS step FROM s3)
SELECT src, count(*) AS n, round(avg(x), 5) AS mean_log, round(stddev_samp(step), 5) AS sd_step FROM s4 GROUP BY src""")
def log_trend(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    own = burst_table(t).filter("zc_mean > 0").withColumn("x", F.log("zc_mean"))
    own = own.withColumn("step", F.col("x") - F.lag("x").over(Window.partitionBy("src").orderBy("seg_id")))
    return own.groupBy("src").agg(F.count("*").alias("n"), R(F.avg("x"), 5).alias("mean_log"), R(F.stddev_samp("step"), 5).alias("sd_step"))


@query(f"""WITH {SCORES}, w2 AS (SELECT src, seg_id, t, avg(score) OVER (PARTITION BY src, seg_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM sc) SELECT src,
  seg_id, t, round(m, 6) AS window_score FROM w2""")
def window_mean_score(t: Tables) -> DataFrame:
    own = scores(t).withColumn("pos", F.col("t"))
    return own.select("src", "seg_id", "t", R(F.avg("score").over(in_segment().rowsBetween(0, 2)), 6).alias("window_score"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '(?:guarantee[ds]?|never fails?|worthless|always safe)'))), ',') AS claims
  FROM documents WHERE regexp_matches(lower(text), '(?:guarantee[ds]?|never fails?|worthless|always safe)')""")
def unsafe_claims(t: Tables) -> DataFrame:
    from gapwise.operators.explain import citations

    low, pattern = F.lower("text"), "(?:guarantee[ds]?|never fails?|worthless|always safe)"
    return t.documents.filter(low.rlike(pattern)).select("doc_id", citations(low, pattern).alias("claims"))
