"""Queries over rule baselines, cleaning variants, conformal levels, replays and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.operators import evaluate as ev, joins, rules
from gapwise.plans.base import GAP, KEYS, SCORES, SEGMENTS, marked, samples, scores, segment_keys, segments
from gapwise.plans.queries_reports import _WF, R, feature_windows, rounded
from gapwise.plans.queries_scores import _CAL, _TWO, calibrated, calibration
from gapwise.plans.registry import Tables, query

# Rule baselines


_RULES = _WF + """, rw AS (SELECT src, seg_id, pos, CAST((src + seg_id) % 7 = 0 AS INTEGER) AS label, src % 5 <> 0 AND (src + seg_id) % 7 <> 0 AS train, src % 5 = 0 AS test,
  round(rms0, 6) AS rms0, round(rms1, 6) AS rms1, round(rms0 / nullif(rms1, 0), 6) AS rms_ratio, CASE WHEN s0 AND s1 THEN round(cw, 4) END AS corr_win, round(cc, 4) AS corr_cum FROM wk WHERE win = 10),
c AS (SELECT rms1 AS x, count(*) AS n, sum(rms1) AS s FROM rw WHERE train AND rms1 IS NOT NULL GROUP BY 1),
r AS (SELECT x, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER () AS n, sum(s) OVER () AS s FROM c WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT (s1 / n1 + (s - s1) / (n - n1)) / 2 AS cut FROM r WHERE n1 > 0 ORDER BY n1 * (n - n1) * pow((s - s1) / (n - n1) - s1 / n1, 2) / n DESC, x LIMIT 1),
st AS (SELECT rw.*, CAST(rms1 > cut AS INTEGER) AS state FROM rw CROSS JOIN cut),
ft AS (SELECT state, quantile_cont(rms0, 0.99) AS thr, median(corr_win) AS cm, (quantile_cont(corr_win, 0.75) - quantile_cont(corr_win, 0.25)) / 1.349 AS cs, median(corr_cum) AS km,
  (quantile_cont(corr_cum, 0.75) - quantile_cont(corr_cum, 0.25)) / 1.349 AS ks, median(rms_ratio) AS rm, (quantile_cont(rms_ratio, 0.75) - quantile_cont(rms_ratio, 0.25)) / 1.349 AS rs FROM st WHERE train GROUP BY 1),
al AS (SELECT median(rms_ratio) AS ra FROM rw WHERE train),
rel AS (SELECT st.*, rms0 / nullif(thr, 0) AS rel, ra, cm, CASE WHEN cs <> 0 THEN cs ELSE 1e-6 END AS cs, km, CASE WHEN ks <> 0 THEN ks ELSE 1e-6 END AS ks, rm,
  CASE WHEN rs <> 0 THEN rs ELSE 1e-6 END AS rs FROM st JOIN ft USING (state) CROSS JOIN al),
rq AS (SELECT src, seg_id, pos, label, train, test, state, rms0 AS rms, rel AS rms_state, rel * (1 - coalesce(corr_win, 0)) AS rms_state_dir, rel * coalesce(rms_ratio, ra) AS rms_state_ratio,
  rel * (1 + greatest(0, (cm - coalesce(corr_win, cm)) / cs)) AS rms_state_dirz, rel * (1 + greatest(0, (coalesce(rms_ratio, rm) - rm) / rs)) AS rms_state_ratioz,
  rel * (1 + greatest(0, (km - coalesce(corr_cum, km)) / ks)) AS rms_state_dirz_cum FROM rel),
rs AS (SELECT src, seg_id, pos, label, train, test, state, rms, round(rms_state, 6) AS rms_state, round(rms_state_dir, 6) AS rms_state_dir, round(rms_state_ratio,
  6) AS rms_state_ratio, round(rms_state_dirz, 6) AS rms_state_dirz, round(rms_state_ratioz, 6) AS rms_state_ratioz, round(rms_state_dirz_cum, 6) AS rms_state_dirz_cum FROM rq)"""


def ruled(t: Tables) -> DataFrame:
    own = marked(feature_windows(t).filter("win = 10")).drop("state")
    own = rounded(rounded(own, 6, "rms0", "rms1", "rms_ratio"), 4, "corr_win", "corr_cum").withColumn("train", (F.col("src") % 5 != 0) & (F.col("label") == 0))
    return rules.rule_scores(own, F.col("train"))


@query(_RULES + " SELECT src, seg_id, pos, state, rms, " + ", ".join(f"round({r}, 4) AS {r}" for r in rules.RULES[1:]) + " FROM rq")
def rule_scores(t: Tables) -> DataFrame:
    """Seven rule scores of each window, from cuts, thresholds and medians of the normal windows of four users in five."""
    return rounded(ruled(t).select("src", "seg_id", "pos", "state", *rules.RULES), 4, *rules.RULES[1:])


_JUDGED = _RULES + f""", lg AS (SELECT src, seg_id, label, train, test, u.rule, u.score FROM rs, LATERAL (SELECT unnest([{', '.join(f"{{'rule': '{r}', 'score': {r}}}" for r in rules.RULES)}]) AS u)),
rt AS (SELECT rule, quantile_cont(score, 0.9) AS thr FROM lg WHERE train GROUP BY 1), te AS (SELECT lg.*, thr, score > thr AS h FROM lg JOIN rt USING (rule) WHERE test),
rk AS (SELECT rule, label, rank() OVER (PARTITION BY rule ORDER BY score) + (count(*) OVER (PARTITION BY rule, score) - 1) / 2.0::DOUBLE AS rk FROM te WHERE score IS NOT NULL),
au AS (SELECT rule,
  (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0), 0)::DOUBLE AS auc FROM rk GROUP BY 1),
sg AS (SELECT rule, label, src, seg_id, bool_or(coalesce(h, false)) AS h FROM te GROUP BY 1, 2, 3, 4),
fs AS (SELECT rule, avg(CASE WHEN h THEN 1.0::DOUBLE ELSE 0.0 END) AS fpr_sample FROM te WHERE label = 0 GROUP BY 1),
fg AS (SELECT rule, avg(CASE WHEN h THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE label = 0) AS fpr_segment, count(*) FILTER (WHERE label = 1) AS n_out_seg,
  count(*) FILTER (WHERE label = 1 AND h) AS n_detected FROM sg GROUP BY 1)"""
_FOUND = "FROM rt LEFT JOIN au USING (rule) LEFT JOIN fs USING (rule) LEFT JOIN fg USING (rule)"


@query(_JUDGED + " SELECT rule, round(thr, 5) AS thr, round(auc, 8) AS auc, round(fpr_sample, 8) AS fpr_sample, round(fpr_segment, 8) AS fpr_segment, n_out_seg, n_detected " + _FOUND)
def rule_baselines(t: Tables) -> DataFrame:
    """What the rules find among the windows of the fifth user."""
    own = rules.rule_table(rounded(ruled(t), 6, *rules.RULES), F.col("train"), F.col("src") % 5 == 0, 0.9)
    return rounded(rounded(own, 8, "auc", "fpr_sample", "fpr_segment"), 5, "thr")


@query(_JUDGED + f""", tb AS (SELECT rule, round(auc, 8) AS auc, round(fpr_segment, 8) AS f, n_detected AS d {_FOUND}), df AS (SELECT a.rule, a.auc - b.auc AS d_auc,
  a.f - b.f AS d_fpr, a.d - b.d AS d_detected FROM tb a CROSS JOIN tb b WHERE b.rule = 'rms')
SELECT rule, round(d_auc, 8) AS d_auc, round(d_fpr, 8) AS d_fpr, d_detected,
  CASE WHEN rule = 'rms' THEN 'reference' WHEN d_auc >= 0 AND d_fpr <= 0 AND (d_auc > 0 OR d_fpr < 0 OR d_detected > 0) THEN 'accept' ELSE 'reject' END AS verdict FROM df""")
def rule_verdicts(t: Tables) -> DataFrame:
    """Which rules are accepted in place of the plainest one."""
    own = rules.rule_table(rounded(ruled(t), 6, *rules.RULES), F.col("train"), F.col("src") % 5 == 0, 0.9)
    return rounded(rules.verdicts(rounded(own, 8, "auc", "fpr_segment"), "rms"), 8, "d_auc", "d_fpr")


# Cleaning


_UNIFIED = SEGMENTS + """, un AS (SELECT src, seg_id, event_id, pos, n, round_even(ch0, 1) AS c0, round_even(ch1 / 1.19209, 0) * 1.19209 AS c1 FROM p)"""


@query(f"""WITH {_UNIFIED} SELECT src, event_id, round(c0 - avg(c0) OVER s, 6) AS ch0, round(avg(c0) OVER s, 6) AS ch0_dc, round(c1 - avg(c1) OVER s, 6) AS ch1,
  round(avg(c1) OVER s, 6) AS ch1_dc FROM un WINDOW s AS (PARTITION BY src, seg_id)""")
def cleaned_standard(t: Tables) -> DataFrame:
    """Segments, one format and the mean of each segment taken away, in one pipeline."""
    own = rules.prepared(samples(t), GAP, "ch0", "ch1", 1, 1.19209)
    return rounded(own.select("src", "event_id", "ch0", "ch0_dc", "ch1", "ch1_dc"), 6, "ch0", "ch0_dc", "ch1", "ch1_dc")


@query(f"""WITH {SEGMENTS}, mb AS (SELECT median(m0) AS b0, median(m1) AS b1 FROM (SELECT avg(ch0) AS m0, avg(ch1) AS m1 FROM p WHERE src % 5 <> 0 GROUP BY src, seg_id HAVING count(*) >= 17)),
s3 AS (SELECT src, event_id, ch0 - avg(ch0) OVER s AS a0, ch1 - avg(ch1) OVER s AS a1, ch0 - b0 AS f0, ch1 - b1 AS f1, coalesce(ch0 - lag(ch0) OVER o, 0) AS d0, coalesce(ch1 - lag(ch1) OVER o, 0) AS d1
  FROM p CROSS JOIN mb WINDOW s AS (PARTITION BY src, seg_id), o AS (PARTITION BY src, seg_id ORDER BY pos))
SELECT 'offline_mean' AS variant, src, event_id, round(a0, 6) AS ch0, round(a1, 6) AS ch1 FROM s3 UNION ALL SELECT 'fixed_baseline', src, event_id, round(f0, 6), round(f1, 6)
  FROM s3 UNION ALL SELECT 'first_difference', src, event_id, round(d0, 6), round(d1, 6) FROM s3""")
def cleaning_variants(t: Tables) -> DataFrame:
    own = segments(t)
    made = [rules.variant(own, v, ["ch0", "ch1"], F.col("src") % 5 != 0).select(F.lit(v).alias("variant"), "src", "event_id", "ch0", "ch1") for v in rules.VARIANTS]
    return rounded(made[0].unionByName(made[1]).unionByName(made[2]), 6, "ch0", "ch1")


# Conformal levels


_ALPHAS = (0.02, 0.05, 0.1, 0.2)


@query(_CAL + """, al AS (SELECT unnest([0.02::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS alpha), r AS (SELECT state, score, row_number() OVER (PARTITION BY state
  ORDER BY score) AS i, count(*) OVER (PARTITION BY state) AS n FROM x WHERE cal),
lv AS (SELECT state, alpha, max(n) AS n_cal, max(CASE WHEN i = n + 1 - floor((n + 1) * alpha + 1e-9) THEN score END) AS thr, bool_or(floor((n + 1) * alpha + 1e-9) > 0) AS ok FROM r CROSS JOIN al GROUP BY 1, 2),
te AS (SELECT alpha, (src + seg_id) % 7 = 0 AS out, coalesce(score > thr, false) AS h FROM x JOIN lv USING (state) WHERE NOT cal AND ok),
sz AS (SELECT alpha, CAST(sum(CASE WHEN ok THEN n_cal ELSE 0 END) AS BIGINT) AS n_cal, count(*) FILTER (WHERE ok) AS n_attainable FROM lv GROUP BY 1),
cn AS (SELECT alpha, count(*) FILTER (WHERE NOT out) AS n_normal, count(*) FILTER (WHERE NOT out AND h) AS n_false, count(*) FILTER (WHERE out) AS n_out,
  count(*) FILTER (WHERE out AND h) AS n_detected FROM te GROUP BY 1)
SELECT alpha, coalesce(n_normal, 0) AS n_normal, coalesce(n_false, 0) AS n_false, coalesce(n_out, 0) AS n_out, coalesce(n_detected, 0) AS n_detected, n_cal, n_attainable,
  round(n_false / nullif(n_normal, 0)::DOUBLE, 8) AS false_rate, round(n_detected / nullif(n_out, 0)::DOUBLE, 8) AS detected_rate FROM sz LEFT JOIN cn USING (alpha)""")
def conformal_operating(t: Tables) -> DataFrame:
    """False alarms and detections of conformal thresholds at four levels, by state."""
    own = calibration(t).withColumn("label", ((F.col("src") + F.col("seg_id")) % 7 == 0).cast("int"))
    return rounded(rules.operating_levels(own.filter("not calibration"), own.filter("calibration"), "state", _ALPHAS), 8, "false_rate", "detected_rate")


@query(_CAL + """, pt AS (SELECT state, score, (src + seg_id) % 7 = 0 AS out, CASE WHEN src % 5 = 0 THEN 'test' WHEN cal THEN 'calibration' ELSE 'train' END AS part FROM x),
bt AS (SELECT state, score, 'full' AS fit FROM pt WHERE NOT out AND part <> 'test' UNION ALL SELECT state, score, 'proper' FROM pt WHERE NOT out AND part = 'train'),
th AS (SELECT state, fit, quantile_cont(score, 0.95) AS thr FROM bt GROUP BY 1, 2), te AS (SELECT pt.state, fit, thr, out, coalesce(score > thr, false) AS h FROM pt JOIN th USING (state) WHERE part = 'test')
SELECT state, fit, round(max(thr), 6) AS thr, count(*) FILTER (WHERE NOT out) AS n_normal, count(*) FILTER (WHERE NOT out AND h) AS n_false, count(*) FILTER (WHERE out) AS n_out,
  count(*) FILTER (WHERE out AND h) AS n_detected FROM te GROUP BY 1, 2""")
def holdout_cost(t: Tables) -> DataFrame:
    """What a threshold costs that has only the segments which calibration leaves."""
    part = F.when(F.col("src") % 5 == 0, "test").when(F.col("calibration"), "calibration").otherwise("train")
    own = calibration(t).withColumns({"label": ((F.col("src") + F.col("seg_id")) % 7 == 0).cast("int"), "part": part})
    return rounded(rules.holdout_cost(own, 0.95, "state"), 6, "thr")


@query()
def calibration_study(t: Tables) -> DataFrame:
    """Calibration drawn five times beside the latest segments: normal segments' false alarms at three levels."""
    own = segment_keys(t).filter("label = 0").select("src", "seg_id", "state", F.round("rms0", 6).alias("score"))
    return rounded(rules.calibration_study(own, "state", 0.25, (0.05, 0.1, 0.2), range(5)), 8, "rate_mean", "rate_min", "rate_max")


# Thresholds by state, replay, roll-ups


@query(f"""WITH {SCORES}, th AS (SELECT state, quantile_cont(score, 0.95) AS thr FROM sc WHERE label = 0 GROUP BY 1) SELECT src, seg_id, t, state, round(score - thr, 5) AS margin,
  coalesce(score > thr, false) AS alarm FROM sc LEFT JOIN th USING (state)""")
def state_thresholds(t: Tables) -> DataFrame:
    """Scores against the threshold of their state, looked up in a table that must be a row a state."""
    own = scores(t)
    thr = ev.normal_threshold(own, 0.95, ["state"])
    made = joins.joined(own, thr, ["state"])
    return made.select("src", "seg_id", "t", "state", R(F.col("score") - F.col("thr"), 5).alias("margin"), F.coalesce(F.col("score") > F.col("thr"), F.lit(False)).alias("alarm"))


_SEGMENT_STARTS = "(" + f"WITH {KEYS} SELECT src, seg_id, start FROM k" + ")"


@query(_TWO + f""", v AS (SELECT z.*, CASE WHEN z.label = 0 THEN 'normal' ELSE 'outlier' END AS view, epoch_us(b.start) + CAST(round(t * 3600.0 * 1e6) AS BIGINT) AS abs_us FROM z
  LEFT JOIN {_SEGMENT_STARTS} b USING (src, seg_id) WHERE z.label = 0 OR z.fold = 4)
SELECT "view", src, seg_id, t, fold, label, state, abs_us, round((abs_us - min(abs_us) OVER (PARTITION BY "view")) / 1e6::DOUBLE, 3) AS relative_sec, round(z1, 5) AS z1, round(z2,
  5) AS z2, CASE WHEN z1 > 1 AND z2 > 1 THEN 'alarm' WHEN z1 > 1 THEN 'caution' ELSE 'normal' END AS stage FROM v""")
def replay_windows(t: Tables) -> DataFrame:
    """All normal windows and one fold's abnormal ones, as a monitor would show them, an hour a sample."""
    return replayed(t).withColumns({"relative_sec": R("relative_sec", 3), "z1": R("z1", 5), "z2": R("z2", 5)})


def replayed(t: Tables) -> DataFrame:
    return rules.replay(calibrated(t), segment_keys(t), "z1", "z2", 4, 3600.0)


@query(_TWO + f""", v AS (SELECT z.*, CASE WHEN z.label = 0 THEN 'normal' ELSE 'outlier' END AS view, epoch_us(b.start) + CAST(round(t * 3600.0 * 1e6) AS BIGINT) AS abs_us FROM z
  LEFT JOIN {_SEGMENT_STARTS} b USING (src, seg_id) WHERE z.label = 0 OR z.fold = 4),
wr AS (SELECT *, (abs_us - min(abs_us) OVER (PARTITION BY "view")) / 1e6::DOUBLE AS rel FROM v),
gr AS (SELECT "view", fold, src, seg_id, min(rel) AS relative_sec, max(label) AS label, max(state) AS state, max(z1) AS first_max, max(z2) AS second_max,
  max(CASE WHEN z1 IS NOT NULL AND z2 IS NOT NULL THEN least(z1, z2) END) AS alarm_max, count(*) AS n_windows FROM wr GROUP BY 1, 2, 3, 4)
SELECT "view", fold, src, seg_id, round(relative_sec, 3) AS relative_sec, label, state, round(first_max, 5) AS first_max, round(second_max, 5) AS second_max, round(alarm_max, 5) AS alarm_max, n_windows,
CASE WHEN alarm_max > 1 THEN 'alarm' WHEN first_max > 1 THEN 'caution' ELSE 'normal' END AS stage FROM gr""")
def replay_segments(t: Tables) -> DataFrame:
    own = rules.replay_segments(replayed(t), "z1", "z2")
    return rounded(rounded(own, 3, "relative_sec"), 5, "first_max", "second_max", "alarm_max")


@query(f"""WITH {SCORES}, m AS (SELECT 'first' AS model, CAST(state AS VARCHAR) AS split, CAST(fold AS VARCHAR) AS fold, avg(score) AS mean, max(score) AS top FROM sc GROUP BY state, fold
  UNION ALL SELECT 'second', CAST(state AS VARCHAR), CAST(fold AS VARCHAR), avg(score2), max(score2) FROM sc GROUP BY state, fold)
SELECT model, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, CASE WHEN grouping(fold) = 1 THEN 'all' ELSE fold END AS fold, count(*) AS n, round(avg(mean), 6) AS mean, round(avg(top), 6) AS top
FROM m GROUP BY GROUPING SETS ((model, split, fold), (model, split), (model))""")
def metric_rollup(t: Tables) -> DataFrame:
    """Means of two models' figures by split and fold, with rows 'all' over the folds, and over the splits."""
    own, made = scores(t), None
    for model, c in (("first", "score"), ("second", "score2")):
        one = own.groupBy(F.col("state").alias("split"), "fold").agg(F.avg(c).alias("mean"), F.max(c).alias("top")).withColumn("model", F.lit(model))
        made = one if made is None else made.unionByName(one)
    return rounded(rules.rolled_up(made, ["model", "split", "fold"], ["mean", "top"]), 6, "mean", "top")
