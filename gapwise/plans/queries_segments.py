"""Queries over samples, segments and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions import guarded_corr, micros, ratio
from gapwise.operators import clean, segments as seg
from gapwise.plans.base import GAP, KEYS, SAMPLES, SEGMENTS, STEP, WIN, WINDOWS, samples, segment_keys, segments, windows
from gapwise.plans.registry import Tables, query

R = lambda c, d=4: F.round(F.col(c) if isinstance(c, str) else c, d)


@query(f"WITH {SEGMENTS} SELECT src, event_id, seg_id, pos, n, round(dt, 4) AS dt FROM p")
def gap_segments(t: Tables) -> DataFrame:
    return segments(t).select("src", "event_id", "seg_id", "pos", "n", R("dt").alias("dt"))


@query(f"WITH {SEGMENTS} SELECT src, seg_id, count(*) AS n, min(ts) AS start, max(ts) AS \"end\", round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE, 4) AS dur, round(stddev_samp(ch0), 4) AS sd, max(abs(ch0)) AS absmax FROM p GROUP BY src, seg_id")
def segment_table(t: Tables) -> DataFrame:
    return seg.segment_table(segments(t)).select("src", "seg_id", "n", "start", "end", R("dur").alias("dur"), R("sd").alias("sd"), "absmax")


def _amp_sql(c: str) -> str:
    var = f"({c}_m2 - {c}_m1 * {c}_m1)"
    return f"""round({c}_rms, 4) AS {c}_rms, {c}_peak, round({c}_p2p, 4) AS {c}_p2p, round({c}_peak / nullif({c}_rms, 0), 4) AS {c}_crest,
  CASE WHEN {c}_hi > {c}_lo THEN round(({c}_m4 - 4 * {c}_m1 * {c}_m3 + 6 * {c}_m1 * {c}_m1 * {c}_m2 - 3 * pow({c}_m1, 4)) / pow({var}, 2) - 3, 3) END AS {c}_kurt,
  CASE WHEN {c}_hi > {c}_lo THEN round(({c}_m3 - 3 * {c}_m1 * {c}_m2 + 2 * pow({c}_m1, 3)) / pow({var}, 1.5), 3) END AS {c}_skew,
  CASE WHEN {c}_hi > {c}_lo THEN round(greatest({c}_hi - {c}_m1, {c}_m1 - {c}_lo) / sqrt({var}), 3) END AS {c}_shape_crest"""


@query(f"WITH {WINDOWS} SELECT src, seg_id, pos, {_amp_sql('ch0')}, {_amp_sql('ch1')} FROM w")
def hop_window_features(t: Tables) -> DataFrame:
    out = windows(t)
    cols = [x for c in ("ch0", "ch1") for x in (R(f"{c}_rms").alias(f"{c}_rms"), f"{c}_peak", R(f"{c}_p2p").alias(f"{c}_p2p"), R(f"{c}_crest").alias(f"{c}_crest"), R(f"{c}_kurt", 3).alias(f"{c}_kurt"), R(f"{c}_skew", 3).alias(f"{c}_skew"), R(f"{c}_shape_crest", 3).alias(f"{c}_shape_crest"))]
    return out.select("src", "seg_id", "pos", *cols)


@query(f"WITH {SEGMENTS} SELECT src, event_id, CASE WHEN pos >= 9 THEN round(sqrt(avg(ch0 * ch0) OVER (PARTITION BY src, seg_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), 4) END AS rolling_rms FROM p")
def rolling_rms(t: Tables) -> DataFrame:
    return seg.rolling_rms(segments(t), "ch0", WIN).select("src", "event_id", R("rolling_rms").alias("rolling_rms"))


@query(f"""WITH {KEYS} SELECT win, count(*) AS n_seg, count(*) FILTER (WHERE n >= win) AS n_valid, round(avg(CASE WHEN n >= win THEN 0.0 ELSE 1.0 END), 6) AS undetermined,
  CAST(sum(CASE WHEN n >= win THEN floor((n - win) / 5) + 1 ELSE 0 END) AS BIGINT) AS n_windows FROM k CROSS JOIN (SELECT unnest([10, 20, 30]) AS win) GROUP BY win""")
def segment_coverage(t: Tables) -> DataFrame:
    out = seg.coverage(segments(t), (10, 20, 30), STEP)
    return out.withColumn("undetermined", R("undetermined", 6))


@query(f"""WITH {SAMPLES}, d AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src ORDER BY event_id)) / 1e6::DOUBLE AS dt FROM s)
SELECT src, count(*) AS n, count(*) FILTER (WHERE dt < 0) AS n_back, count(*) FILTER (WHERE dt = 0) AS n_zero, count(*) - count(DISTINCT ts) AS n_repeated,
  round(median(CASE WHEN dt BETWEEN 0 AND 172800 THEN dt END), 4) AS median_dt, round(avg(CASE WHEN dt BETWEEN 0 AND 172800 THEN dt END), 4) AS mean_dt FROM d GROUP BY src""")
def dt_profile(t: Tables) -> DataFrame:
    return seg.time_profile(samples(t), GAP).withColumns({"median_dt": R("median_dt"), "mean_dt": R("mean_dt")})


@query(f"""WITH {SAMPLES}, c AS (SELECT *, lag(event_type) OVER w AS before FROM s WINDOW w AS (PARTITION BY src ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(CASE WHEN before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c)
SELECT src, run, min(event_type) AS state, count(*) AS n, min(ts) AS start, max(ts) AS "end" FROM r GROUP BY src, run""")
def state_runs(t: Tables) -> DataFrame:
    return seg.state_runs(samples(t), "event_type")


@query(f"""WITH {SEGMENTS}, b AS (SELECT src, seg_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM p GROUP BY src, seg_id),
l AS (SELECT *, lead(a) OVER (PARTITION BY src ORDER BY seg_id) AS nxt FROM b)
SELECT src, seg_id, round((z - a) / 1e6::DOUBLE, 4) AS span, round((nxt - z) / 1e6::DOUBLE, 4) AS silence, round((z - a)::DOUBLE / nullif(nxt - a, 0), 6) AS duty FROM l""")
def burst_gaps(t: Tables) -> DataFrame:
    return seg.bursts(segments(t)).select("src", "seg_id", R("span").alias("span"), R("silence").alias("silence"), R("duty", 6).alias("duty"))


@query(f"WITH {SEGMENTS} SELECT src, event_id, n FROM p WHERE n = 12")
def fixed_length_cohort(t: Tables) -> DataFrame:
    return seg.fixed_length(segments(t), 12).select("src", "event_id", "n")


@query(f"""WITH {SEGMENTS} SELECT src, event_id, round_even(ch0, 1) AS ch0, round(round_even(ch1 / 1.19209, 0) * 1.19209, 4) AS ch1 FROM p""")
def unify_format(t: Tables) -> DataFrame:
    return clean.unify_format(segments(t), "ch0", "ch1", 1, 1.19209).select("src", "event_id", "ch0", R("ch1").alias("ch1"))


@query(f"WITH {SEGMENTS} SELECT src, event_id, round(ch0 - avg(ch0) OVER (PARTITION BY src, seg_id), 8) AS clean FROM p")
def dc_mean(t: Tables) -> DataFrame:
    return clean.remove_offset(segments(t), "ch0", "mean").select("src", "event_id", R("clean", 8).alias("clean"))


@query(f"WITH {SEGMENTS} SELECT src, event_id, round(ch0 - avg(ch0) OVER (PARTITION BY src, seg_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 8) AS clean FROM p")
def dc_expanding(t: Tables) -> DataFrame:
    return clean.remove_offset(segments(t), "ch0", "expanding").select("src", "event_id", R("clean", 8).alias("clean"))


@query(f"""WITH {SEGMENTS} SELECT src, event_id, round(CASE WHEN n >= 3 THEN ch0 - (regr_intercept(ch0, pos) OVER s + regr_slope(ch0,
  pos) OVER s * pos) ELSE ch0 - avg(ch0) OVER s END, 7) AS clean FROM p WINDOW s AS (PARTITION BY src, seg_id)""")
def dc_detrend(t: Tables) -> DataFrame:
    return clean.remove_offset(segments(t), "ch0", "detrend").select("src", "event_id", R("clean", 7).alias("clean"))


@query(f"""WITH {SEGMENTS}, m AS (SELECT avg(ch0) AS m FROM p GROUP BY src, seg_id HAVING count(*) >= 17), b AS (SELECT median(m) AS base FROM m)
SELECT src, event_id, round(ch0 - base, 8) AS clean FROM p CROSS JOIN b""")
def dc_baseline(t: Tables) -> DataFrame:
    own = segments(t)
    base = clean.fit_baseline(own, "ch0")
    return clean.remove_offset(own, "ch0", "baseline", base).select("src", "event_id", R("clean", 8).alias("clean"))


@query(f"WITH {SEGMENTS} SELECT src, event_id, round(coalesce(ch0 - lag(ch0) OVER w, 0), 4) AS ch0_diff, round(coalesce(ch1 - lag(ch1) OVER w, 0), 4) AS ch1_diff FROM p WINDOW w AS (PARTITION BY src, seg_id ORDER BY pos)")
def first_difference(t: Tables) -> DataFrame:
    return clean.first_difference(segments(t), "ch0", "ch1").select("src", "event_id", R("ch0_diff").alias("ch0_diff"), R("ch1_diff").alias("ch1_diff"))


@query(f"WITH {SEGMENTS} SELECT src, event_id, round(coalesce((ch0 - avg(ch0) OVER f) / nullif(stddev_pop(ch0) OVER f, 0), 0), 4) AS z FROM p WINDOW f AS (PARTITION BY src, seg_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)")
def window_zscore(t: Tables) -> DataFrame:
    return clean.window_z(segments(t), "ch0", WIN).select("src", "event_id", R("z").alias("z"))


@query(f"""WITH {SEGMENTS}, m AS (SELECT avg(ch0) AS m0, stddev_pop(ch0) AS s0, min(ch1) AS lo, max(ch1) AS hi FROM p WHERE (src + seg_id) % 7 <> 0)
SELECT src, event_id, round((ch0 - m0) / greatest(s0, 1e-6), 4) AS ch0_z, round((ch1 - lo) / (hi - lo + 1e-9), 4) AS ch1_scaled FROM p CROSS JOIN m""")
def train_scaling(t: Tables) -> DataFrame:
    own, train = segments(t), (F.col("src") + F.col("seg_id")) % 7 != 0
    out = clean.min_max_scaled(clean.standardised(own, train, "ch0"), train, "ch1")
    return out.select("src", "event_id", R("ch0_z").alias("ch0_z"), R("ch1_scaled").alias("ch1_scaled"))


@query(f"""WITH {SEGMENTS}, x AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE ch0 END AS v FROM p), m AS (SELECT median(v) AS f FROM x WHERE (src + seg_id) % 7 <> 0)
SELECT src, event_id, coalesce(v, f) AS v FROM x CROSS JOIN m""")
def median_imputation(t: Tables) -> DataFrame:
    own = segments(t).withColumn("v", F.when(F.col("event_type") != "error", F.col("ch0")))
    return clean.imputed(own, (F.col("src") + F.col("seg_id")) % 7 != 0, "v").select("src", "event_id", "v")


@query(f"""WITH {SAMPLES} SELECT src, event_id, round(sqrt(ch0 * ch0 + ch1 * ch1), 3) AS norm, round(ln(ch0), 4) AS ln0, round(ln(1 + ch1), 4) AS log1p1, round(ch0 / nullif(ch1, 0), 8) AS load,
  CASE WHEN ch0 > 0 AND ch0 <= 10 THEN 'low' WHEN ch0 > 10 AND ch0 <= 100 THEN 'mid' WHEN ch0 > 100 AND ch0 <= 1000 THEN 'high' END AS bin,
  concat_ws('+', CASE WHEN ch0 > 100 THEN 'value' END, CASE WHEN ch1 > 90 THEN 'k' END, CASE WHEN event_type = 'error' THEN 'type' END) AS criteria,
  ts + INTERVAL 90 SECOND AS later, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY src)) / 1e6::DOUBLE, 4) AS since FROM s""")
def scalar_transforms(t: Tables) -> DataFrame:
    ch0, ch1 = F.col("ch0"), F.col("ch1")
    us = micros("ts")
    ln = lambda x, log: F.when(x == 0, float("-inf")).otherwise(log)  # noqa: E731  as in the SQL; Spark's own has no logarithm of 0
    return samples(t).select(
        "src", "event_id", R(F.hypot(ch0, ch1), 3).alias("norm"), R(ln(ch0, F.log(ch0))).alias("ln0"), R(ln(1 + ch1, F.log1p(ch1))).alias("log1p1"), R(ratio(ch0, ch1), 8).alias("load"),
        clean.labelled_bins(ch0, [0, 10, 100, 1000], ["low", "mid", "high"]).alias("bin"),
        F.concat_ws("+", F.when(ch0 > 100, "value"), F.when(ch1 > 90, "k"), F.when(F.col("event_type") == "error", "type")).alias("criteria"),
        (F.col("ts") + F.expr("INTERVAL 90 SECOND")).alias("later"), (R((us - F.min(us).over(Window.partitionBy("src"))) / 1e6 * 1e4, 0) / 1e4).alias("since"),  # rounded in binary, as the SQL is
    )


@query(f"""WITH {SEGMENTS}, x AS (SELECT *, corr(ch0, ch1) OVER f AS c, max(ch0) OVER f > min(ch0) OVER f AND max(ch1) OVER f > min(ch1) OVER f AS ok FROM p
  WINDOW f AS (PARTITION BY src, seg_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT src, seg_id, pos, CASE WHEN ok THEN round(c, 3) END AS corr FROM x WHERE pos % 5 = 0 AND pos + 10 <= n""")
def relation_windows(t: Tables) -> DataFrame:
    return seg.relation_windows(segments(t), WIN, STEP).select("src", "seg_id", "pos", R("corr", 3).alias("corr"))


@query(f"""WITH {SEGMENTS}, x AS (SELECT *, corr(ch0, ch1) OVER f AS c FROM p WINDOW f AS (PARTITION BY src, seg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 9 FOLLOWING))
SELECT src, seg_id, pos, round(c, 3) AS corr FROM x WHERE pos % 5 = 0 AND pos + 10 <= n""")
def relation_cumulative(t: Tables) -> DataFrame:
    return seg.relation_windows(segments(t), WIN, STEP, cumulative=True).select("src", "seg_id", "pos", R("corr", 3).alias("corr"))


@query(f"""WITH {SEGMENTS}, m AS (SELECT *, avg(ch0) OVER (PARTITION BY src, seg_id) AS mu, lag(ch0) OVER (PARTITION BY src, seg_id ORDER BY pos) AS before FROM p)
SELECT src, seg_id, CASE WHEN count(*) >= 4 AND max(ch0) > min(ch0) THEN round(sum((ch0 - mu) * (before - mu)) / sum((ch0 - mu) * (ch0 - mu)), 4) END AS ac1,
  CASE WHEN count(*) >= 4 AND max(ch0) > min(ch0) AND max(ch1) > min(ch1) THEN round(corr(ch0, ch1), 4) END AS corr FROM m GROUP BY src, seg_id""")
def relation_segments(t: Tables) -> DataFrame:
    w = Window.partitionBy("src", "seg_id")
    own = segments(t).withColumn("mu", F.avg("ch0").over(w)).withColumn("before", F.lag("ch0").over(w.orderBy("pos")))
    top, bottom = F.sum((F.col("ch0") - F.col("mu")) * (F.col("before") - F.col("mu"))), F.sum((F.col("ch0") - F.col("mu")) * (F.col("ch0") - F.col("mu")))
    ok = (F.count("*") >= 4) & (F.max("ch0") > F.min("ch0"))
    return own.groupBy("src", "seg_id").agg(R(F.when(ok, ratio(top, bottom))).alias("ac1"), R(guarded_corr(F.col("ch0"), F.col("ch1"))).alias("corr"))


@query(f"""WITH {SEGMENTS}, m AS (SELECT *, ch0 - avg(ch0) OVER (PARTITION BY src, seg_id) AS x FROM p), l AS (SELECT *, lag(x) OVER (PARTITION BY src, seg_id ORDER BY pos) AS y FROM m)
SELECT src, seg_id, count(*) FILTER (WHERE sign(x) <> sign(y)) AS zc, 2.0 * count(*) / nullif(count(*) FILTER (WHERE sign(x) <> sign(y)), 0) AS period FROM l GROUP BY src, seg_id""")
def zero_crossings(t: Tables) -> DataFrame:
    w = Window.partitionBy("src", "seg_id")
    own = segments(t).withColumn("x", F.col("ch0") - F.avg("ch0").over(w))
    own = own.withColumn("y", F.lag("x").over(w.orderBy("pos")))
    zc = F.count_if(F.signum("x") != F.signum("y"))
    return own.groupBy("src", "seg_id").agg(zc.alias("zc"), ratio(2.0 * F.count("*"), zc).alias("period"))


@query(f"""WITH {SEGMENTS}, d1 AS (SELECT src, seg_id, ch0 - lag(ch0) OVER (PARTITION BY src, seg_id ORDER BY pos) AS x FROM p), m AS (SELECT src, seg_id, median(x) AS m FROM d1 GROUP BY src, seg_id)
SELECT src, seg_id, round(1.4826 * median(abs(x - m)) / sqrt(2), 4) AS noise FROM d1 JOIN m USING (src, seg_id) WHERE x IS NOT NULL GROUP BY src, seg_id""")
def noise_floor(t: Tables) -> DataFrame:
    w = Window.partitionBy("src", "seg_id")
    own = segments(t).withColumn("x", F.col("ch0") - F.lag("ch0").over(w.orderBy("pos"))).filter("x is not null")
    own = own.withColumn("m", F.median("x").over(w))
    return own.groupBy("src", "seg_id").agg(R(1.4826 * F.median(F.abs(F.col("x") - F.col("m"))) / 2**0.5).alias("noise"))


@query(f"""WITH {SEGMENTS}, q AS (SELECT src, seg_id, ch0, CASE WHEN abs(ch0 * 20 - round_even(ch0 * 20, 0)) < 1e-6 THEN 1.0 ELSE 0.0 END AS grid FROM p)
SELECT src, seg_id, round(count(DISTINCT ch0)::DOUBLE / count(*), 6) AS uniq, round(avg(grid), 6) AS grid_share, count(*) FILTER (WHERE ch0 >= 0.99 * hi) AS n_clip
FROM q JOIN (SELECT src, seg_id, max(ch0) AS hi FROM q GROUP BY src, seg_id) USING (src, seg_id) GROUP BY src, seg_id""")
def format_features(t: Tables) -> DataFrame:
    own = segments(t).withColumn("hi", F.max("ch0").over(Window.partitionBy("src", "seg_id")))
    q = F.col("ch0") * 20
    grid = F.when(F.abs(q - F.rint(q)) < 1e-6, 1.0).otherwise(0.0)
    return own.groupBy("src", "seg_id").agg(R(F.countDistinct("ch0") / F.count("*"), 6).alias("uniq"), R(F.avg(grid), 6).alias("grid_share"), F.count_if(F.col("ch0") >= 0.99 * F.col("hi")).alias("n_clip"))


@query(f"""WITH {KEYS}, f AS (SELECT unnest([0.6::DOUBLE, 2.4::DOUBLE, 7.3::DOUBLE]) AS f_true) SELECT f_true, fs, round(abs(f_true - fs * round_even(f_true / fs, 0)),
  6) AS f_alias FROM f CROSS JOIN (SELECT unnest([5.0::DOUBLE, 10.0::DOUBLE]) AS fs)""".replace(KEYS + ", ", ""))
def alias_table(t: Tables) -> DataFrame:
    own = t.spark.createDataFrame([(x,) for x in (0.6, 2.4, 7.3)], "f_true double").crossJoin(t.spark.createDataFrame([(5.0,), (10.0,)], "fs double"))
    return own.select("f_true", "fs", R(F.abs(F.col("f_true") - F.col("fs") * F.rint(F.col("f_true") / F.col("fs"))), 6).alias("f_alias"))


@query(f"""WITH {SEGMENTS}, m AS (SELECT avg(ch0) AS mu, stddev_samp(ch0) AS sd FROM p WHERE (src + seg_id) % 7 <> 0) SELECT src,
  round(avg(CASE WHEN abs((ch0 - mu) / sd) > 3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM p CROSS JOIN m GROUP BY src""")
def outlier_share(t: Tables) -> DataFrame:
    own = segments(t)
    ref = own.filter("(src + seg_id) % 7 != 0").agg(F.avg("ch0").alias("mu"), F.stddev_samp("ch0").alias("sd"))
    z = (F.col("ch0") - F.col("mu")) / F.col("sd")
    return own.crossJoin(F.broadcast(ref)).groupBy("src").agg(R(F.avg(F.when(F.abs(z) > 3, 1.0).otherwise(0.0)), 6).alias("share"))


_SPECTRUM = f"""WITH {SEGMENTS}, m AS (SELECT *, ch0 - avg(ch0) OVER (PARTITION BY src, seg_id) AS y FROM p), f AS (SELECT unnest(range(1, (SELECT max(n) // 2 + 1 FROM p))) AS k)
SELECT src, seg_id, k, round(2 * sqrt(pow(sum(y * cos(2 * pi() * k * pos / n)), 2) + pow(sum(y * sin(2 * pi() * k * pos / n)), 2)) / max(n), DIGITS) AS amplitude
FROM m JOIN f ON k <= n // 2 GROUP BY src, seg_id, k"""


@query(_SPECTRUM.replace("DIGITS", "3"))
def spectrum(t: Tables) -> DataFrame:
    """All segments and bins, by sums over samples and bins."""
    w = Window.partitionBy("src", "seg_id")
    own = segments(t).withColumn("y", F.col("ch0") - F.avg("ch0").over(w)).filter("n > 1")
    own = own.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / 2))))
    a = 2 * F.pi() * F.col("k") * F.col("pos") / F.col("n")
    made = own.groupBy("src", "seg_id", "k").agg((2 * F.sqrt(F.pow(F.sum(F.col("y") * F.cos(a)), 2) + F.pow(F.sum(F.col("y") * F.sin(a)), 2)) / F.max("n")).alias("a"))
    return made.select("src", "seg_id", "k", R("a", 3).alias("amplitude"))


@query(_SPECTRUM.replace("DIGITS", "6"))
def spectrum_full(t: Tables) -> DataFrame:
    """As spectrum, by a fast transform of each segment."""
    return seg.spectrum(segments(t), "ch0").select("src", "seg_id", "k", R("amplitude", 6).alias("amplitude"))


@query(f"WITH {KEYS} SELECT src, seg_id, 'src' || src || '_' || seg_id AS seg_uid, CAST(regexp_extract('src' || src || '_' || seg_id, '_(\\d+)$', 1) AS BIGINT) AS suffix, CASE state WHEN 0 THEN 'high' ELSE 'low' END AS state_name FROM k")
def segment_key(t: Tables) -> DataFrame:
    own = segment_keys(t).withColumn("seg_uid", F.concat_ws("_", F.concat(F.lit("src"), "src"), "seg_id"))
    names = F.create_map(F.lit(0), F.lit("high"), F.lit(1), F.lit("low"))
    return own.select("src", "seg_id", "seg_uid", F.regexp_extract("seg_uid", r"_(\d+)$", 1).cast("long").alias("suffix"), names[F.col("state")].alias("state_name"))


@query("SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 100")
def scan_filter(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error' and value > 100").select("event_id", "value")
