"""Queries over window scores: splits, thresholds, alarms, metrics, conformal levels and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions import micros, ratio
from gapwise.operators import conformal, evaluate as ev, splits
from gapwise.operators.order import quantiles
from gapwise.plans.base import KEYS, SCORES, THRESHOLD, scores, segment_keys
from gapwise.plans.registry import Tables, query

R = lambda c, d=4: F.round(F.col(c) if isinstance(c, str) else c, d)


def above(t: Tables) -> DataFrame:
    """Scores with the 0.9 quantile of normal windows as threshold."""
    own = scores(t)
    return ev.with_threshold(own, ev.normal_threshold(own, 0.9))


@query(f"WITH {KEYS} SELECT src, seg_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY src, seg_id) - 1) % 5 AS INTEGER) AS fold FROM k")
def fold_assignment(t: Tables) -> DataFrame:
    return splits.ordered_folds(segment_keys(t), 5).select("src", "seg_id", "label", "fold")


@query(f"WITH {KEYS} SELECT src, seg_id, CAST(floor((row_number() OVER (PARTITION BY src ORDER BY seg_id) - 1) * 5 / count(*) OVER (PARTITION BY src)) AS INTEGER) AS block FROM k")
def block_assignment(t: Tables) -> DataFrame:
    return splits.block_assignment(segment_keys(t), 5).select("src", "seg_id", "block")


@query(f"""WITH {KEYS}, b AS (SELECT *, CASE WHEN label = 0 THEN CAST(floor((row_number() OVER (PARTITION BY src ORDER BY seg_id) - 1) * 5 / count(*) OVER (PARTITION BY src)) AS INTEGER) END AS block FROM k)
SELECT src, seg_id, CAST(kk AS INTEGER) AS k, CASE WHEN block IS NULL OR block = kk THEN 'test' ELSE 'train' END AS part FROM b CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS kk) WHERE block IS NULL OR block <= kk""")
def split_forward(t: Tables) -> DataFrame:
    own = splits.block_assignment(segment_keys(t), 5).withColumn("block", F.when(F.col("label") == 0, F.col("block")))
    return splits.forward_splits(own, 5).select("src", "seg_id", "k", "part")


@query(f"""WITH {KEYS}, f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY src, seg_id) - 1) % 5 AS INTEGER) AS fold FROM k)
SELECT k.kk AS k, CASE WHEN fold = k.kk THEN 'test' ELSE 'train' END AS part, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM f CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS kk) k GROUP BY 1, 2""")
def split_group_k(t: Tables) -> DataFrame:
    own = splits.group_k_folds(splits.ordered_folds(segment_keys(t), 5), 5)
    return own.groupBy("k", "part").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("n_pos"))


@query(f"""WITH {KEYS}, f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY src, seg_id) - 1) % 5 AS INTEGER) AS fold FROM k)
SELECT fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, min(start) AS "first", max(start) AS "last", count(*) FILTER (WHERE state = 0) AS n_high, count(*) FILTER (WHERE state = 1) AS n_low FROM f GROUP BY fold""")
def split_summary(t: Tables) -> DataFrame:
    return splits.split_summary(splits.ordered_folds(segment_keys(t), 5))


@query(f"WITH {SCORES} SELECT fold, round(quantile_cont(score, 0.99), 4) AS thr FROM sc WHERE label = 0 GROUP BY fold")
def threshold_q99(t: Tables) -> DataFrame:
    return ev.normal_threshold(scores(t), 0.99, ("fold",)).select("fold", R("thr").alias("thr"))


@query(f"""WITH {THRESHOLD}, gg AS (SELECT fold, src, seg_id, max(hit) AS h, sum(hit) AS k, count(*) AS n FROM st WHERE label = 0 GROUP BY fold, src, seg_id)
SELECT fold, round(sum(k)::DOUBLE / sum(n), 6) AS fpr_sample, round(avg(h), 6) AS fpr_segment, count(*) AS n_segments FROM gg GROUP BY fold""")
def false_positive_rates(t: Tables) -> DataFrame:
    return ev.false_positive_rates(above(t), ("fold",)).withColumns({"fpr_sample": R("fpr_sample", 6), "fpr_segment": R("fpr_segment", 6)})


_AUC = """r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 AS rk FROM {f} WHERE {x} IS NOT NULL)
SELECT {by}, round(CASE WHEN sum({y}) > 0 AND sum({y}) < count(*) THEN (sum(rk * {y}) - sum({y}) * (sum({y}) + 1) / 2.0) / (sum({y}) * (count(*) - sum({y}))) END, 6) AS auc,
  CAST(sum({y}) AS BIGINT) AS n_pos, CAST(count(*) - sum({y}) AS BIGINT) AS n_neg FROM r GROUP BY {by}"""


@query(f"WITH {SCORES}, " + _AUC.format(by="fold", x="score", y="label", f="sc"))
def roc_auc(t: Tables) -> DataFrame:
    return ev.auc(scores(t), ("fold",)).withColumn("auc", R("auc", 6))


@query("WITH x AS (SELECT lang, source, n_chars, toxic FROM documents JOIN labels USING (doc_id)), " + _AUC.format(by="lang", x="n_chars", y="toxic", f="x"))
def label_auc(t: Tables) -> DataFrame:
    own = t.documents.join(t.labels, "doc_id").select("lang", F.col("n_chars").alias("score"), F.col("toxic").alias("label"))
    return ev.auc(own, ("lang",)).withColumn("auc", R("auc", 6))


@query("""WITH x AS (SELECT CAST(n_chars AS DOUBLE) AS thr, sum(quality) AS pos, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
c AS (SELECT thr, sum(pos) OVER w AS tp, sum(n) OVER w AS up, sum(pos) OVER () AS p, sum(n) OVER () AS a FROM x WINDOW w AS (ORDER BY thr DESC))
SELECT thr, round(tp / nullif(p, 0)::DOUBLE, 6) AS tpr, round((up - tp) / nullif(a - p, 0)::DOUBLE, 6) AS fpr, round(tp / up::DOUBLE, 6) AS "precision" FROM c""")
def roc_curve(t: Tables) -> DataFrame:
    own = t.documents.join(t.labels, "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
    return ev.roc_points(own).select("thr", R("tpr", 6).alias("tpr"), R("fpr", 6).alias("fpr"), R("precision", 6).alias("precision"))


@query(f"""WITH {THRESHOLD} SELECT src, seg_id, max(label) AS label, count(*) AS n_used, max(hit) = 1 AS alarm, min(CASE WHEN hit = 1 THEN t END) AS first_t,
  round(min(CASE WHEN hit = 1 THEN t END) + 0.9::DOUBLE, 4) AS delay FROM st GROUP BY src, seg_id""")
def alarm_any(t: Tables) -> DataFrame:
    return ev.segment_alarms(above(t)).withColumn("delay", R("delay"))


_KOFN = f"""WITH {THRESHOLD}, i AS (SELECT *, row_number() OVER (PARTITION BY src, seg_id ORDER BY t) AS i FROM st), u AS (SELECT *, CASE WHEN i > 1 THEN hit ELSE 0 END AS h FROM i),
v AS (SELECT *, sum(h) OVER (PARTITION BY src, seg_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits FROM u),
a AS (SELECT src, seg_id, max(label) AS label, count(*) FILTER (WHERE i > 1) AS n_used, bool_or(hits >= 2) AS alarm, min(CASE WHEN hits >= 2 THEN t END) AS first_t FROM v GROUP BY src, seg_id)"""


@query(_KOFN + " SELECT src, seg_id, label, n_used, alarm, first_t, round(first_t + 0.9::DOUBLE, 4) AS delay FROM a")
def alarm_kofn(t: Tables) -> DataFrame:
    return ev.segment_alarms(above(t), "kofn", 2, 3, skip_first=1).withColumn("delay", R("delay"))


@query(f"""WITH {THRESHOLD}, a AS (SELECT src, seg_id, max(label) AS label, count(*) AS n_used, coalesce(quantile_cont(score, 0.9) > max(thr), false) AS alarm, max(t) AS last FROM st GROUP BY src, seg_id)
SELECT src, seg_id, label, n_used, alarm, CASE WHEN alarm THEN last END AS first_t FROM a""")
def alarm_quantile(t: Tables) -> DataFrame:
    return ev.segment_alarms(above(t), "quantile", q=0.9).drop("delay")


_RATES = "round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS \"precision\", round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1"


@query(_KOFN + f""", c AS (SELECT count(*) FILTER (WHERE label = 1 AND alarm) AS tp, count(*) FILTER (WHERE label = 0 AND alarm) AS fp,
  count(*) FILTER (WHERE label = 1 AND NOT alarm) AS fn, count(*) FILTER (WHERE label = 0 AND NOT alarm) AS tn FROM a)
SELECT *, {_RATES} FROM c""")
def confusion_f1(t: Tables) -> DataFrame:
    out = ev.confusion(ev.segment_alarms(above(t), "kofn", 2, 3, skip_first=1))
    return out.withColumns({c: R(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {SCORES}, th AS (SELECT 0.8::DOUBLE AS q, quantile_cont(score, 0.8) AS thr FROM sc WHERE label = 0 UNION ALL SELECT 0.9::DOUBLE, quantile_cont(score, 0.9) FROM sc
  WHERE label = 0 UNION ALL SELECT 0.95::DOUBLE, quantile_cont(score, 0.95) FROM sc WHERE label = 0),
a AS (SELECT q, src, seg_id, max(label) AS label, bool_or(score > thr) AS alarm FROM sc CROSS JOIN th GROUP BY q, src, seg_id),
c AS (SELECT q, count(*) FILTER (WHERE label = 1 AND alarm) AS tp, count(*) FILTER (WHERE label = 0 AND alarm) AS fp, count(*) FILTER (WHERE label = 1 AND NOT alarm) AS fn,
  count(*) FILTER (WHERE label = 0 AND NOT alarm) AS tn FROM a GROUP BY q)
SELECT *, {_RATES} FROM c""")
def f1_grid(t: Tables) -> DataFrame:
    own, qs = scores(t), [0.8, 0.9, 0.95]
    thr = quantiles(own.filter("label = 0"), "score", qs, names=["a", "b", "c"]).select(F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(c).alias("thr")) for q, c in zip(qs, "abc", strict=True)))).alias("z"))
    made = own.crossJoin(F.broadcast(thr.select("z.q", "z.thr")))
    alarms = made.groupBy("q", "src", "seg_id").agg(F.max("label").alias("label"), F.bool_or(F.col("score") > F.col("thr")).alias("alarm"))
    return ev.confusion(alarms, ("q",)).withColumns({c: R(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {SCORES}, m AS (SELECT src, seg_id, max(score) AS stat FROM sc WHERE label = 0 GROUP BY src, seg_id), r AS (SELECT stat, row_number() OVER (ORDER BY stat DESC, src,
  seg_id) AS rk, count(*) OVER () AS total FROM m),
goal AS (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS target)
SELECT target, total, CAST(floor(target * total + 1e-9) AS BIGINT) AS m, stat AS thr FROM r JOIN goal ON rk = least(floor(target * total + 1e-9) + 1, total)""")
def operating_point(t: Tables) -> DataFrame:
    return ev.operating_point(scores(t), [0.01, 0.05, 0.1])


@query(f"""WITH {SCORES}, l AS (SELECT *, list_sort(list(score) OVER (PARTITION BY src, seg_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 'DESC') AS z FROM sc WHERE label = 0),
m AS (SELECT src, seg_id, max(z[2]) AS stat FROM l GROUP BY src, seg_id), n AS (SELECT count(*) AS total FROM m),
r AS (SELECT stat, row_number() OVER (ORDER BY stat DESC, src, seg_id) AS rk, count(*) OVER () AS last FROM m WHERE stat IS NOT NULL), goal AS (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE]) AS target)
SELECT target, total, CAST(floor(target * total + 1e-9) AS BIGINT) AS m, stat AS thr FROM n CROSS JOIN goal JOIN r ON rk = least(floor(target * total + 1e-9) + 1, last)""")
def operating_point_kofn(t: Tables) -> DataFrame:
    return ev.operating_point(scores(t), [0.01, 0.05], 2, 3)


@query(_KOFN + """, b AS (SELECT src, seg_id, count(*) FILTER (WHERE score > thr) AS n_exceed, count(*) AS n_windows FROM st GROUP BY src, seg_id)
SELECT src, seg_id, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS kind, n_exceed, n_windows FROM a JOIN b USING (src, seg_id) WHERE (label = 1) <> alarm""")
def error_cases(t: Tables) -> DataFrame:
    own = above(t)
    return ev.error_cases(own, ev.segment_alarms(own, "kofn", 2, 3, skip_first=1))


_TWO = f"""WITH {SCORES}, th AS (SELECT quantile_cont(score, 0.9) AS a, quantile_cont(score2, 0.9) AS b FROM sc WHERE label = 0),
z AS (SELECT sc.*, score / a AS z1, score2 / b AS z2 FROM sc CROSS JOIN th)"""


def calibrated(t: Tables) -> DataFrame:
    """Both scores over their 0.9 quantile of normal windows, so that 1 is the threshold of either."""
    own = scores(t)
    normal = own.filter("label = 0")
    th = quantiles(normal, "score", [0.9], names=["a"]).crossJoin(quantiles(normal, "score2", [0.9], names=["b"]))
    return own.crossJoin(F.broadcast(th)).withColumn("z1", F.col("score") / F.col("a")).withColumn("z2", F.col("score2") / F.col("b"))


@query(_TWO + " SELECT src, seg_id, t, round(CASE WHEN z1 IS NOT NULL AND z2 IS NOT NULL THEN least(z1, z2) END, 5) AS z_and, round(CASE WHEN z1 IS NOT NULL AND z2 IS NOT NULL THEN greatest(z1, z2) END, 5) AS z_or, round((z1 + z2) / 2, 5) AS z_mean FROM z")
def fusion(t: Tables) -> DataFrame:
    made = ev.fused(F.col("z1"), F.col("z2"))
    return calibrated(t).select("src", "seg_id", "t", *(R(c, 5).alias(n) for n, c in made.items()))


@query(_TWO + """, a AS (SELECT fold, src, seg_id, bool_or(z1 > 1) AS a, bool_or(z2 > 1) AS b FROM z WHERE label = 0 GROUP BY fold, src, seg_id)
SELECT fold, count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a OR b) AS either,
  round(coalesce(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a OR b), 0)::DOUBLE, 0), 6) AS jaccard FROM a GROUP BY fold""")
def fp_jaccard(t: Tables) -> DataFrame:
    own = calibrated(t).groupBy("fold", "src", "seg_id").agg(F.max("label").alias("label"), F.bool_or(F.col("z1") > 1).alias("a"), F.bool_or(F.col("z2") > 1).alias("b"))
    return ev.overlap(own, "a", "b", ("fold",)).withColumn("jaccard", R("jaccard", 6))


@query(_TWO + """, a AS (SELECT src, seg_id, min(CASE WHEN z1 > 1 OR z2 > 1 THEN t END) AS caution_t, min(CASE WHEN z1 > 1 AND z2 > 1 THEN t END) AS alarm_t FROM z GROUP BY src, seg_id)
SELECT src, seg_id, caution_t, alarm_t, alarm_t - caution_t AS gap, CASE WHEN alarm_t IS NOT NULL THEN 'alarm' WHEN caution_t IS NOT NULL THEN 'caution' ELSE 'normal' END AS level FROM a""")
def two_level_alarm(t: Tables) -> DataFrame:
    from gapwise.operators.explain import alarm_level

    z1, z2 = F.col("z1") > 1, F.col("z2") > 1
    own = calibrated(t).groupBy("src", "seg_id").agg(F.min(F.when(z1 | z2, F.col("t"))).alias("caution_t"), F.min(F.when(z1 & z2, F.col("t"))).alias("alarm_t"))
    return own.select("src", "seg_id", "caution_t", "alarm_t", (F.col("alarm_t") - F.col("caution_t")).alias("gap"), alarm_level(F.col("caution_t").isNotNull(), F.col("alarm_t").isNotNull()).alias("level"))


@query(_TWO + """, a AS (SELECT src, seg_id, bool_or(z1 > 1) AS alarm FROM z WHERE label = 0 GROUP BY src, seg_id), h AS (SELECT user_id AS src,
  (max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9::DOUBLE AS hours FROM events GROUP BY user_id)
SELECT src, round(count(*) FILTER (WHERE alarm) / nullif(max(hours), 0), 6) AS per_hour FROM a JOIN h USING (src) GROUP BY src""")
def hourly_rate(t: Tables) -> DataFrame:
    own = calibrated(t).filter("label = 0").groupBy("src", "seg_id").agg(F.bool_or(F.col("z1") > 1).alias("alarm"))
    hours = t.events.groupBy(F.col("user_id").alias("src")).agg(((F.max(micros("ts")) - F.min(micros("ts"))) / 3.6e9).alias("hours"))
    return own.join(hours, "src").groupBy("src").agg(R(ratio(F.count_if("alarm"), F.max("hours")), 6).alias("per_hour"))


_CAL = f"""WITH {KEYS}, x AS (SELECT src, seg_id, state, round(rms0, 6) AS score, row_number() OVER (PARTITION BY src ORDER BY seg_id DESC) <= greatest(1,
  floor(0.5 * count(*) OVER (PARTITION BY src) + 0.5)) AS cal FROM k)"""


def calibration(t: Tables) -> DataFrame:
    own = conformal.calibration_split(segment_keys(t), 0.5)
    return own.select("src", "seg_id", "state", F.round("rms0", 6).alias("score"), "calibration")


@query(_CAL + " SELECT src, seg_id, cal AS calibration FROM x")
def conformal_split(t: Tables) -> DataFrame:
    return calibration(t).select("src", "seg_id", "calibration")


@query(_CAL + """, c AS (SELECT state, score FROM x WHERE cal), n AS (SELECT state, count(*) AS n_cal FROM c GROUP BY state)
SELECT a.src, a.seg_id, n.n_cal, round((1.0 + (SELECT count(*) FROM c WHERE c.state = a.state AND c.score >= a.score)) / (n.n_cal + 1), 6) AS p FROM x a JOIN n USING (state) WHERE NOT a.cal""")
def conformal_p(t: Tables) -> DataFrame:
    own = calibration(t)
    made = conformal.p_values(own.filter("not calibration"), own.filter("calibration"), "state")
    return made.select("src", "seg_id", "n_cal", R("p", 6).alias("p"))


@query(_CAL + """, r AS (SELECT state, score, row_number() OVER (PARTITION BY state ORDER BY score) AS i, count(*) OVER (PARTITION BY state) AS n FROM x WHERE cal)
SELECT state, max(n) AS n_cal, coalesce(max(CASE WHEN i = n + 1 - floor((n + 1) * 0.05::DOUBLE + 1e-9) THEN score END), 'Infinity'::DOUBLE) AS thr,
  bool_or(floor((n + 1) * 0.05::DOUBLE + 1e-9) > 0) AS attainable FROM r GROUP BY state""")
def conformal_threshold(t: Tables) -> DataFrame:
    return conformal.thresholds(calibration(t).filter("calibration"), "state", 0.05)


@query(_CAL + """, c AS (SELECT state, score FROM x WHERE cal), n AS (SELECT state, count(*) AS n_cal FROM c GROUP BY state),
pp AS (SELECT a.state, (1.0 + (SELECT count(*) FROM c WHERE c.state = a.state AND c.score >= a.score)) / (n.n_cal + 1) AS p FROM x a JOIN n USING (state) WHERE NOT a.cal)
SELECT state, count(*) AS n, round(avg(CASE WHEN p <= 0.1 + 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS realised FROM pp GROUP BY state""")
def conformal_validity(t: Tables) -> DataFrame:
    own = calibration(t)
    made = conformal.p_values(own.filter("not calibration"), own.filter("calibration"), "state")
    return made.groupBy("state").agg(F.count("*").alias("n"), R(F.avg(F.when(F.col("p") <= 0.1 + 1e-12, 1.0).otherwise(0.0)), 6).alias("realised"))


@query(f"""WITH {SCORES}, f AS (SELECT fold, avg(score) AS m, count(*) AS n FROM sc GROUP BY fold) SELECT CAST(fold AS VARCHAR) AS fold, round(m, 8) AS m FROM f UNION ALL SELECT 'mean', round(avg(m), 8) FROM f""")
def fold_means(t: Tables) -> DataFrame:
    own = scores(t).groupBy("fold").agg(F.avg("score").alias("m"))
    return own.select(F.col("fold").cast("string").alias("fold"), "m").unionByName(own.agg(F.avg("m").alias("m")).select(F.lit("mean").alias("fold"), "m")).select("fold", R("m", 8).alias("m"))


@query(f"""WITH {SCORES}, f AS (SELECT fold AS k FROM sc GROUP BY fold), q AS (SELECT k, quantile_cont(score, 0.99) AS q99 FROM sc JOIN f ON sc.fold <> f.k GROUP BY k)
SELECT round(max(q99) - min(q99), 4) AS spread, round(stddev_samp(q99) / avg(q99), 6) AS cv, count(*) AS n FROM q""")
def quantile_stability(t: Tables) -> DataFrame:
    own = scores(t).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("fold != k")
    own = quantiles(own, "score", [0.99], ["k"], ["q99"])
    return own.agg(R(F.max("q99") - F.min("q99")).alias("spread"), R(F.stddev_samp("q99") / F.avg("q99"), 6).alias("cv"), F.count("*").alias("n"))


@query(f"""WITH {KEYS}, q AS (SELECT quantile_cont(rms0, 0.9) AS hi, quantile_cont(rms0, 0.5) AS lo FROM k WHERE label = 0)
SELECT src, seg_id, CASE WHEN rms0 > hi THEN 'severe' WHEN rms0 <= lo THEN 'mild' ELSE 'middle' END AS grade FROM k CROSS JOIN q WHERE label = 1""")
def grade_by_quantile(t: Tables) -> DataFrame:
    own = segment_keys(t)
    q = quantiles(own.filter("label = 0"), "rms0", [0.9, 0.5], names=["hi", "lo"])
    r = F.col("rms0")
    return own.filter("label = 1").crossJoin(F.broadcast(q)).select("src", "seg_id", F.when(r > F.col("hi"), "severe").when(r <= F.col("lo"), "mild").otherwise("middle").alias("grade"))


@query(_TWO + """, m AS (SELECT src, seg_id, label, state, median(z1) AS z1, median(z2) AS z2, count(*) AS n FROM z GROUP BY ALL) SELECT src, seg_id, label, state, round(z1, 5) AS z1, round(z2, 5) AS z2, n FROM m""")
def segment_representatives(t: Tables) -> DataFrame:
    return calibrated(t).groupBy("src", "seg_id", "label", "state").agg(R(F.median("z1"), 5).alias("z1"), R(F.median("z2"), 5).alias("z2"), F.count("*").alias("n"))


@query(_TWO + ", b AS (SELECT label, CAST(floor(log10(greatest(z1, 1e-6)) * 4) AS BIGINT) AS bin FROM z) SELECT label, bin, count(*) AS n FROM b GROUP BY label, bin")
def score_histogram(t: Tables) -> DataFrame:
    return calibrated(t).groupBy("label", F.floor(F.log10(F.greatest("z1", F.lit(1e-6))) * 4).alias("bin")).agg(F.count("*").alias("n"))
