"""Queries of the relational core, statistics, models, early warning and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions import micros, ratio
from gapwise.operators import explain, models, pairs, stats, warning
from gapwise.operators.order import quantiles
from gapwise.plans.base import KEYS, SEGMENTS, segment_keys, segments
from gapwise.plans.registry import Tables, query

R = lambda c, d=4: F.round(F.col(c) if isinstance(c, str) else c, d)


@query("""SELECT n_name, r_name, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def attribute_join(t: Tables) -> DataFrame:
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return own.groupBy("n_name", "r_name", "c_mktsegment").agg(F.count("*").alias("n"), R(F.avg("c_acctbal")).alias("mean"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey AS key FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def intersect_keys(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("key")).intersect(t.lineitem.filter("l_quantity > 45").select("l_partkey"))


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_keys(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("key")).subtract(t.lineitem.filter("l_quantity > 45").select("l_partkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS margin FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("margin"))


@query("SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS \"F\", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS \"O\", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS \"P\" FROM orders GROUP BY 1")
def pivot_metrics(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(R(F.avg("o_totalprice")))


@query("""SELECT o_orderkey, flag, v FROM (SELECT o_orderkey, 'det_high' AS flag, o_totalprice > 300000 AS v FROM orders UNION ALL SELECT o_orderkey, 'det_open', o_orderstatus = 'O' FROM orders) WHERE v""")
def unpivot_flags(t: Tables) -> DataFrame:
    own = t.orders.select("o_orderkey", (F.col("o_totalprice") > 300000).alias("det_high"), (F.col("o_orderstatus") == "O").alias("det_open"))
    return own.unpivot("o_orderkey", ["det_high", "det_open"], "flag", "v").filter("v")


@query("SELECT o_orderstatus, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 8")
def topk_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_orderpriority", "o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rn", F.row_number().over(w).cast("long")).filter("rn <= 8").select("o_orderstatus", "o_orderkey", "o_totalprice", "rn")


@query("""SELECT event_type, user_id, round(share, 6) AS share, n FROM (SELECT event_type, user_id, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY event_type))::DOUBLE AS share FROM events GROUP BY 1, 2)""")
def value_counts(t: Tables) -> DataFrame:
    own = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return own.select("event_type", "user_id", R(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6).alias("share"), "n")


@query("""SELECT s_nationkey, count(DISTINCT s_suppkey) AS n, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS members, max(s_acctbal) AS top,
  bool_or(s_acctbal < 0) AS any_negative, bool_and(s_acctbal > 0) AS all_positive, arg_min(s_name, s_suppkey) AS "first",
  round(quantile_cont(s_acctbal, 0.25), 4) AS q25, round(median(s_acctbal), 4) AS med, round((quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25)) / 1.349, 4) AS scale FROM supplier GROUP BY 1""")
def grouped_aggregates(t: Tables) -> DataFrame:
    x = F.col("s_acctbal")
    return t.supplier.groupBy("s_nationkey").agg(
        F.countDistinct("s_suppkey").alias("n"), F.array_join(F.sort_array(F.collect_set("s_name")), ",").alias("members"), F.max(x).alias("top"), F.bool_or(x < 0).alias("any_negative"), F.bool_and(x > 0).alias("all_positive"),
        F.min_by("s_name", "s_suppkey").alias("first"), R(F.percentile(x, 0.25)).alias("q25"), R(F.median(x)).alias("med"), R((F.percentile(x, 0.75) - F.percentile(x, 0.25)) / 1.349).alias("scale"),
    )


@query("""SELECT a.p_brand AS a, b.p_brand AS b, round(abs(a.m - b.m), 4) AS diff FROM (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1) a JOIN (SELECT p_brand,
  avg(p_retailprice) AS m FROM part GROUP BY 1) b ON a.p_brand < b.p_brand""")
def theta_pairs(t: Tables) -> DataFrame:
    m = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    a, b = m.select(F.col("p_brand").alias("a"), F.col("m").alias("ma")), m.select(F.col("p_brand").alias("b"), F.col("m").alias("mb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", R(F.abs(F.col("ma") - F.col("mb"))).alias("diff"))


@query(f"""WITH {KEYS}, x AS (SELECT src, seg_id, round(rms0, 6) AS v, cume_dist() OVER (PARTITION BY src ORDER BY round(rms0, 6)) AS e FROM k)
SELECT src, seg_id, round(e, 6) AS ecdf, rank() OVER (PARTITION BY src ORDER BY v DESC) + (count(*) OVER (PARTITION BY src, v) - 1) / 2.0::DOUBLE AS avg_rank FROM x""")
def ranks(t: Tables) -> DataFrame:
    own = segment_keys(t).withColumn("v", F.round("rms0", 6))
    w = Window.partitionBy("src")
    return own.select("src", "seg_id", R(F.cume_dist().over(w.orderBy("v")), 6).alias("ecdf"), (F.rank().over(w.orderBy(F.desc("v"))) + (F.count("*").over(Window.partitionBy("src", "v")) - 1) / 2).alias("avg_rank"))


@query("""WITH x AS (SELECT p_brand, (p_partkey % 97) / 97.0::DOUBLE + p_size / 1e4::DOUBLE AS p, p_partkey FROM part), r AS (SELECT *,
  p * count(*) OVER () / row_number() OVER (ORDER BY p, b) AS q FROM (SELECT p_brand AS b, min(p) AS p FROM x GROUP BY 1))
SELECT b, round(least(1, min(q) OVER (ORDER BY p DESC)), 6) AS q FROM r""")
def bh_adjust(t: Tables) -> DataFrame:
    own = t.part.groupBy(F.col("p_brand").alias("b")).agg(F.min((F.col("p_partkey") % 97) / 97.0 + F.col("p_size") / 1e4).alias("p"))
    return stats.benjamini_hochberg(own).select("b", R("q", 6).alias("q"))


@query(f"""WITH {KEYS}, x AS (SELECT *, round(rms0, 6) AS v FROM k), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rk FROM x),
a AS (SELECT count(*) FILTER (WHERE label = 0)::DOUBLE AS na, count(*) FILTER (WHERE label = 1)::DOUBLE AS nb, avg(v) FILTER (WHERE label = 0) AS ma,
  avg(v) FILTER (WHERE label = 1) AS mb, var_samp(v) FILTER (WHERE label = 0) AS va, var_samp(v) FILTER (WHERE label = 1) AS vb, sum(rk) FILTER (WHERE label = 0) AS ra,
  median(v) FILTER (WHERE label = 1) AS med FROM r)
SELECT round((mb - ma) / sqrt(va / na + vb / nb), 4) AS t, round(ra - na * (na + 1) / 2, 4) AS u, round((mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)),
  4) AS cohen_d, round(1 - 2 * (ra - na * (na + 1) / 2) / (na * nb), 6) AS cliff, round(med, 4) AS median_b FROM a""")
def mwu_cliff(t: Tables) -> DataFrame:
    out = stats.two_sample(segment_keys(t).withColumn("v", F.round("rms0", 6)), "v", "label")
    return out.select(R("t").alias("t"), R("u").alias("u"), R("cohen_d").alias("cohen_d"), R("cliff", 6).alias("cliff"), R("median_b").alias("median_b"))


def _rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0::DOUBLE AS {c}"


@query(f"""WITH r AS (SELECT l_returnflag, {_rank('l_quantity')}, {_rank('l_extendedprice')}, {_rank('l_discount')} FROM lineitem),
c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS c1, corr(l_quantity, l_discount) AS c2, corr(l_extendedprice, l_discount) AS c3 FROM r GROUP BY 1)
SELECT l_returnflag, 'l_quantity' AS a, 'l_extendedprice' AS b, round(c1, 4) AS rho FROM c UNION ALL SELECT l_returnflag, 'l_quantity', 'l_discount', round(c2, 4) FROM c UNION ALL
  SELECT l_returnflag, 'l_extendedprice', 'l_discount', round(c3, 4) FROM c""")
def spearman_pairs(t: Tables) -> DataFrame:
    return stats.correlation_pairs(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "spearman", "l_returnflag").withColumn("rho", R("rho"))


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS x, corr(l_quantity, l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS y
  FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(abs(x - y), 6) AS gap FROM c""")
def corr_break(t: Tables) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice"]
    x, y = (stats.correlation_pairs(t.lineitem.filter(F.col("l_returnflag") == f), cols).withColumnRenamed("rho", f"rho_{f}") for f in ("A", "N"))
    return x.join(y, ["a", "b"]).select("a", "b", R(F.abs(F.col("rho_A") - F.col("rho_N")), 6).alias("gap"))


@query(f"""WITH {KEYS}, x AS (SELECT src, seg_id, round(mean0, 3) AS v FROM k), sg AS (SELECT a.src, sum(sign(b.v - a.v)) AS s FROM x a JOIN x b ON a.src = b.src AND a.seg_id < b.seg_id GROUP BY 1),
u AS (SELECT src, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tie FROM (SELECT src, v, count(*) AS c FROM x GROUP BY 1, 2) GROUP BY 1), v AS (SELECT src, n, s,
  (n * (n - 1) * (2 * n + 5) - tie) / 18.0::DOUBLE AS var FROM sg JOIN u USING (src))
SELECT src, CAST(n AS BIGINT) AS n, CAST(s AS DOUBLE) AS s, round(var, 4) AS var, round(CASE WHEN var > 0 THEN (s - sign(s)) / sqrt(var) END, 4) AS z FROM v""")
def mann_kendall(t: Tables) -> DataFrame:
    own = segment_keys(t).withColumn("v", F.round("mean0", 3))
    return pairs.mann_kendall(own, "src", "seg_id", "v").filter("n > 1").select("src", "n", F.col("s").cast("double").alias("s"), R("var").alias("var"), R("z").alias("z"))


@query(f"""WITH {KEYS} SELECT a.src, round(median((b.mean0 - a.mean0) / (b.seg_id - a.seg_id)), 4) AS slope FROM k a JOIN k b ON a.src = b.src AND a.seg_id < b.seg_id GROUP BY 1""")
def theil_sen(t: Tables) -> DataFrame:
    return pairs.theil_sen(segment_keys(t), "src", "seg_id", "mean0").filter("slope is not null").select("src", R("slope").alias("slope"))


@query("""WITH c AS (SELECT l_shipmode_proxy AS g, l_extendedprice AS v, count(*) FILTER (WHERE y = 0) AS a, count(*) FILTER (WHERE y = 1) AS b
  FROM (SELECT l_linestatus AS l_shipmode_proxy, l_extendedprice, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem) GROUP BY 1, 2),
e AS (SELECT g, abs(sum(a) OVER r / nullif(sum(a) OVER p, 0)::DOUBLE - sum(b) OVER r / nullif(sum(b) OVER p, 0)::DOUBLE) AS gap FROM c WINDOW p AS (PARTITION BY g),
  r AS (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING))
SELECT g, round(max(gap), 6) AS ks FROM e GROUP BY g""")
def ks_two_sample(t: Tables) -> DataFrame:
    own = t.lineitem.select(F.col("l_linestatus").alias("g"), F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return stats.ks_statistic(own, "v", "y", "g").select("g", R("ks", 6).alias("ks"))


@query("""SELECT l_returnflag, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round((g1 * sqrt(n * (n - 1.0))) / (n - 2), 4) AS skew,
  round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * g2 + 6), 4) AS kurt, round(q99, 4) AS q99
FROM (SELECT l_returnflag, n, mean, sd, q99, (m3 - 3 * mean * m2 + 2 * pow(mean, 3)) / pow(m2 - mean * mean, 1.5) AS g1, (m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * pow(mean, 4)) / pow(m2 - mean * mean, 2) - 3 AS g2
FROM (SELECT l_returnflag, count(*)::DOUBLE AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, quantile_cont(l_quantity, 0.99) AS q99, avg(pow(l_quantity, 2)) AS m2,
  avg(pow(l_quantity, 3)) AS m3, avg(pow(l_quantity, 4)) AS m4 FROM lineitem GROUP BY 1))""")
def distribution_summary(t: Tables) -> DataFrame:
    x = F.col("l_quantity")
    own = t.lineitem.groupBy("l_returnflag").agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    own = own.join(quantiles(t.lineitem, "l_quantity", [0.99], ["l_returnflag"], ["q99"]), "l_returnflag")
    n = F.col("n")
    skew, kurt = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return own.select("l_returnflag", "n", R("mean").alias("mean"), R("sd").alias("sd"), R(skew).alias("skew"), R(kurt).alias("kurt"), R("q99").alias("q99"))


@query("""SELECT src, round(sqrt(pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2)), 6) AS r, round(exp(-count(*) * (pow(avg(cos(a)), 2) + pow(avg(sin(a)), 2))), 6) AS p
  FROM (SELECT user_id AS src, 2 * pi() * (epoch_us(ts) % 86400000000) / 8.64e10::DOUBLE AS a FROM events) GROUP BY src""")
def rayleigh(t: Tables) -> DataFrame:
    own = t.events.select(F.col("user_id").alias("src"), (2 * F.pi() * (micros("ts") % 86400000000) / 8.64e10).alias("a"))
    c, s = F.avg(F.cos("a")), F.avg(F.sin("a"))
    return own.groupBy("src").agg(R(F.hypot(c, s), 6).alias("r"), R(F.exp(-F.count("*") * (c * c + s * s)), 6).alias("p"))


@query(f"""WITH {SEGMENTS}, d2 AS (SELECT src, event_id, seg_id, ch0 - lag(ch0) OVER (PARTITION BY src, seg_id ORDER BY pos) AS step FROM p),
  m AS (SELECT greatest(stddev_pop(step), 1e-6) AS sd FROM d2 WHERE (src + seg_id) % 7 <> 0)
SELECT src, event_id, round(pow(step / sd, 2), 4) AS score FROM d2 CROSS JOIN m""")
def naive_score(t: Tables) -> DataFrame:
    return models.naive_scores(segments(t), (F.col("src") + F.col("seg_id")) % 7 != 0, "ch0").select("src", "event_id", R("score").alias("score"))


def _bin(c: str) -> str:
    return f"CASE WHEN {c} = hi_{c} THEN 9 ELSE CAST(floor(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / 10)) AS INTEGER) END AS b_{c}"


@query(f"""WITH tr AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R'), m AS (SELECT min(l_quantity) AS lo_l_quantity, max(l_quantity) AS hi_l_quantity,
  min(l_discount) AS lo_l_discount, max(l_discount) AS hi_l_discount, count(*) AS n FROM tr),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, n, {_bin('l_quantity')}, {_bin('l_discount')} FROM lineitem CROSS JOIN m),
a AS (SELECT b_l_quantity, count(*) AS k FROM x WHERE l_returnflag <> 'R' GROUP BY 1), b AS (SELECT b_l_discount, count(*) AS k FROM x WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(-ln(coalesce(a.k, 0.1) / n) - ln(coalesce(b.k, 0.1) / n), 4) AS score FROM x LEFT JOIN a USING (b_l_quantity) LEFT JOIN b USING (b_l_discount)""")
def hbos_score(t: Tables) -> DataFrame:
    out = models.hbos(t.lineitem, F.col("l_returnflag") != "R", ["l_quantity", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", R("score").alias("score"))


def _tails(c: str) -> str:
    return f"-ln(cume_dist() OVER (ORDER BY {c})) AS l_{c}, -ln(cume_dist() OVER (ORDER BY {c} DESC)) AS r_{c}"


@query(f"""WITH k AS (SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), e AS (SELECT c_custkey, {_tails('x')}, {_tails('y')} FROM k),
m AS (SELECT (avg(pow(x, 3)) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3)) AS sx, (avg(pow(y, 3)) - 3 * avg(y) * avg(y * y) + 2 * pow(avg(y), 3)) AS sy FROM k)
SELECT c_custkey, round(greatest(l_x + l_y, r_x + r_y, CASE WHEN sx < 0 THEN l_x ELSE r_x END + CASE WHEN sy < 0 THEN l_y ELSE r_y END), 4) AS score FROM e CROSS JOIN m""")
def copod_score(t: Tables) -> DataFrame:
    own = t.customer.select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return models.copod(own, ["x", "y"]).select("c_custkey", R("score").alias("score"))


@query()
def ridge_var_score(t: Tables) -> DataFrame:
    train = (F.col("src") + F.col("seg_id")) % 7 != 0
    _, out = models.ridge_var(segments(t), ["ch0", "ch1"], 5, train, F.col("src") % 5 == 4)
    return out.select("src", "event_id", R("score", 6).alias("score"))


@query()
def mcd_score(t: Tables) -> DataFrame:
    _, out = models.robust_mcd(t.lineitem, F.col("l_returnflag") != "R", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", R("score", 6).alias("score"))


@query("""WITH tr AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R'), m AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, var_samp(l_quantity) AS a,
  covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS d FROM tr),
r AS (SELECT mx, my, a + 1e-6 * (a + d) / 2 AS a, b, d + 1e-6 * (a + d) / 2 AS d FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, round((d * pow(l_quantity - mx, 2) - 2 * b * (l_quantity - mx) * (l_discount - my) + a * pow(l_discount - my, 2)) / (a * d - b * b), 4) AS score FROM lineitem CROSS JOIN r""")
def mahalanobis_score(t: Tables) -> DataFrame:
    out = models.mahalanobis(t.lineitem, F.col("l_returnflag") != "R", ["l_quantity", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", R("score").alias("score"))


@query()
def pca_spe_t2(t: Tables) -> DataFrame:
    size = t.embeddings.agg(F.max(F.size("embedding"))).first()[0]
    cols = [f"x{i}" for i in range(size or 0)]
    own = t.embeddings.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)))
    return models.pca_error(own, F.col("label") != 0, cols, 4).select("vec_id", R("spe", 6).alias("spe"), R("t2", 6).alias("t2"))


@query()
def kalman_score(t: Tables) -> DataFrame:
    own, channels = segments(t), ["ch0", "ch1"]
    fit = models.kalman_fit(own, channels, (F.col("src") + F.col("seg_id")) % 7 != 0)
    return models.kalman_scores(own, channels, fit).select("src", "seg_id", "pos", R("score", 6).alias("score"))


@query()
def isolation_forest_score(t: Tables) -> DataFrame:
    out = models.isolation_forest(t.lineitem, F.col("l_returnflag") != "R", ["l_quantity", "l_extendedprice", "l_discount"], keys=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", R("score", 6).alias("score"))


@query(f"WITH {SEGMENTS} SELECT src, event_id, round(ch0 * 1.5, 4) AS amplitude, round(0.5 * ch0 - 0.5 * ch1, 4) AS antiphase FROM p")
def inject_faults(t: Tables) -> DataFrame:
    own = models.injected(segments(t), "amplitude", 0.5, "ch0", "ch1").withColumnRenamed("ch0_injected", "amplitude")
    return models.injected(own, "antiphase", 0.5, "ch0", "ch1").select("src", "event_id", R("amplitude").alias("amplitude"), R("ch0_injected").alias("antiphase"))


@query()
def bootstrap_rate(t: Tables) -> DataFrame:
    return stats.bootstrap(segment_keys(t), (F.col("rms0") > 70).cast("double"), 200, 7).select("rep", R("mean", 6).alias("mean"))


_BURSTS = KEYS + """, b AS (SELECT src, seg_id, CAST(epoch_us(start) AS DOUBLE) / 1e6::DOUBLE AS t, round(rms0, 6) AS z FROM k)"""


def burst_series(t: Tables) -> DataFrame:
    return segment_keys(t).select("src", "seg_id", (micros("start") / 1e6).alias("t"), F.round("rms0", 6).alias("z"))


@query(f"""WITH RECURSIVE {_BURSTS}, e AS (SELECT src, seg_id, 0.2 * z + 0.8 * 60 AS s FROM b WHERE seg_id = 0 UNION ALL SELECT b.src, b.seg_id, 0.2 * b.z + 0.8 * e.s FROM e
  JOIN b ON b.src = e.src AND b.seg_id = e.seg_id + 1)
SELECT src, seg_id, round(s, 4) AS ewma FROM e""")
def ewma_trend(t: Tables) -> DataFrame:
    return warning.ewma(burst_series(t), "src", "seg_id", "z", 0.2, 60.0).select("src", "seg_id", R("ewma").alias("ewma"))


_STARTS = f"""{_BURSTS}, i AS (SELECT *, z > 70 AS alert, row_number() OVER (PARTITION BY src ORDER BY seg_id) AS i FROM b),
l AS (SELECT *, max(CASE WHEN alert THEN i END) OVER (PARTITION BY src ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM i),
ep AS (SELECT *, alert AND (last IS NULL OR i - last - 1 >= 3) AS start FROM l)"""


def episodes(t: Tables) -> DataFrame:
    return warning.episode_starts(burst_series(t), "src", "seg_id", F.col("z") > 70)


@query(f"WITH {_STARTS} SELECT src, seg_id, alert, start FROM ep")
def episode_starts(t: Tables) -> DataFrame:
    return episodes(t).select("src", "seg_id", "alert", "start")


@query(f"WITH {_STARTS} SELECT src, CAST(sum(CAST(start AS INTEGER)) AS BIGINT) AS episodes, round(avg(CAST(alert AS DOUBLE)), 6) AS share, round(sum(CAST(start AS INTEGER)) / nullif((max(t) - min(t)) / 3600, 0), 6) AS per_hour FROM ep GROUP BY src")
def false_alert_rate(t: Tables) -> DataFrame:
    return warning.false_alert_rate(episodes(t), "src", "t").select("src", "episodes", R("share", 6).alias("share"), R("per_hour", 6).alias("per_hour"))


@query(f"""WITH {_STARTS}, m AS (SELECT src, min(t) + 86400 AS t0, max(t) AS crit FROM ep GROUP BY src), h AS (SELECT m.src, t0, crit,
  min(CASE WHEN alert AND t >= t0 THEN t END) AS hit FROM m JOIN ep USING (src) GROUP BY ALL)
SELECT src, round(hit, 3) AS hit, round(crit - hit, 3) AS lead, round(hit - t0, 3) AS since FROM h""")
def lead_time(t: Tables) -> DataFrame:
    w = Window.partitionBy("src")
    out = warning.lead_times(episodes(t), "src", "t", F.min("t").over(w) + 86400, F.max("t").over(w))
    return out.select("src", R("hit", 3).alias("hit"), R("lead", 3).alias("lead"), R("since", 3).alias("since"))


@query(f"""WITH {_BURSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t DESC) AS i FROM b WHERE z > 0), x AS (SELECT src, t - min(t) OVER (PARTITION BY src) AS x, ln(z) AS y FROM r WHERE i <= 10)
SELECT src, count(*) AS n, round(CASE WHEN var_pop(x) <> 0 THEN covar_pop(x, y) / var_pop(x) END * 1e6, 4) AS slope FROM x GROUP BY src""")
def eta_regression(t: Tables) -> DataFrame:
    return warning.eta(burst_series(t), "src", "t", "z", 200.0).select("src", "n", R(F.col("slope") * 1e6).alias("slope"))


@query("""WITH m AS (SELECT l_suppkey, avg(l_discount) AS a, avg(l_tax) AS b, avg(l_quantity / 1000) AS c FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(a / (a + b + c), 5) AS l_discount_share, round(b / (a + b + c), 5) AS l_tax_share, round(c / (a + b + c), 5) AS q_share,
  CASE WHEN a >= b AND a >= c THEN 'l_discount' WHEN b >= c THEN 'l_tax' ELSE 'q' END AS dominant FROM m""")
def channel_share(t: Tables) -> DataFrame:
    own = t.lineitem.withColumn("q", F.col("l_quantity") / 1000)
    out = explain.channel_shares(own, ["l_suppkey"], ["l_discount", "l_tax", "q"])
    return out.select("l_suppkey", *(R(f"{c}_share", 5).alias(f"{c}_share") for c in ("l_discount", "l_tax", "q")), "dominant")


@query(f"""WITH {KEYS}, m AS (SELECT avg(mean0) AS a, stddev_pop(mean0) AS b, avg(rms0) AS c, stddev_pop(rms0) AS d, avg(n) AS e, stddev_pop(n) AS f FROM k), z AS (SELECT src,
  seg_id, (mean0 - a) / b AS mean0, (rms0 - c) / d AS rms0, (n - e) / f AS n FROM k CROSS JOIN m),
u AS (SELECT src, seg_id, 'mean0' AS name, mean0 AS z FROM z UNION ALL SELECT src, seg_id, 'n', n FROM z UNION ALL SELECT src, seg_id, 'rms0', rms0 FROM z), r AS (SELECT *,
  row_number() OVER (PARTITION BY src, seg_id ORDER BY -abs(round(z, 6)), name) AS i FROM u)
SELECT src, seg_id, string_agg(name, ';' ORDER BY i) AS top FROM r WHERE i <= 2 GROUP BY 1, 2""")
def alarm_card_features(t: Tables) -> DataFrame:
    own, cols = segment_keys(t), ["mean0", "rms0", "n"]
    m = own.agg(*(f(c).alias(f"{p}_{c}") for c in cols for p, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = own.crossJoin(F.broadcast(m)).select("src", "seg_id", *(((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in cols))
    return explain.top_features(z, ["src", "seg_id"], cols, 2).select("src", "seg_id", F.regexp_replace("top", r":[+-]\d+\.\d", "").alias("top"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'english' WHEN contains(lower(text), 'der') OR contains(lower(text),
  'und') THEN 'german' WHEN contains(lower(text), 'que') THEN 'romance' ELSE 'unknown' END AS intent FROM conversations""")
def intent_route(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", explain.route(F.col("text"), {"english": ["the"], "german": ["der", "und"], "romance": ["que"]}).alias("intent"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'h[1-6]'))), ',') AS cited FROM pages""")
def citation_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", explain.citations(F.col("html"), "h[1-6]").alias("cited"))


@query("""WITH x AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(regexp_replace(a.text, '(\\d),(\\d{3})', '\\1\\2', 'g'), '\\d+(?:\\.\\d+)?')) AS f,
  regexp_extract_all(regexp_replace(b.text, '(\\d),(\\d{3})', '\\1\\2', 'g'), '\\d+(?:\\.\\d+)?') AS g FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)
SELECT conv_id, turn, array_to_string(list_sort(list_filter(f, lambda v: NOT list_contains(g, v))), ',') AS unsupported FROM x""")
def number_verify(t: Tables) -> DataFrame:
    a = t.conversations.select("conv_id", "turn", "text")
    b = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("facts"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", explain.unsupported_numbers(F.col("text"), F.col("facts")).alias("unsupported"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS line, 'email' AS rule FROM l WHERE regexp_matches(line, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') UNION ALL SELECT doc_id, CAST(i AS INTEGER), 'key'
  FROM l WHERE regexp_matches(line, 'AKIA[0-9A-Z]{16}')""")
def pii_line_scan(t: Tables) -> DataFrame:
    return explain.flagged_lines(t.documents, "doc_id", "text", {"email": "[A-Za-z0-9.]+@[A-Za-z0-9.]+", "key": "AKIA[0-9A-Z]{16}"})


@query("""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[0-9]')), chr(10))) AS kept FROM documents""")
def line_drop(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(explain.without_lines(F.col("text"), "[0-9]").cast("binary")).alias("kept"))


@query("""WITH a AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT o_custkey,
  sum(o_totalprice) * CASE WHEN o_custkey % 10 = 0 THEN 1.01 ELSE 1 END AS v FROM orders WHERE o_custkey % 50 <> 7 GROUP BY 1)
SELECT count(*) FILTER (WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL) AS n_unmatched, round(max(abs(a.v - b.v)), 2) AS max_diff,
  count(*) FILTER (WHERE abs(a.v - b.v) > 1e-6) AS n_over, 'shape' AS status FROM a FULL JOIN b USING (o_custkey)""")
def table_diff(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    b = a.filter("o_custkey % 50 != 7").withColumn("v", F.col("v") * F.when(F.col("o_custkey") % 10 == 0, 1.01).otherwise(1.0))
    return explain.table_difference(a, b, ["o_custkey"], ["v"], 1e-6).withColumn("max_diff", R("max_diff", 2))
