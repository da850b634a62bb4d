"""Blocks against all earlier ones, by counts of distinct values that blocks share; normality by weights of ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.functions import ratio
from gapwise.operators.order import cumulative
from gapwise.operators.stats import incomplete_beta


def kolmogorov_tail(x: float) -> float:
    """Chance that the Kolmogorov distribution exceeds x."""
    if x <= 0:
        return 1.0
    if x < 1.18:
        y = math.exp(-(math.pi**2) / (8 * x * x))
        return max(0.0, 1 - math.sqrt(2 * math.pi) / x * (y + y**9 + y**25 + y**49))
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 20)))


def f_tail(f: float, a: float, b: float) -> float:
    """Chance that an F variable of a and b degrees of freedom exceeds f."""
    return 1.0 if f <= 0 else incomplete_beta(b / 2, a / 2, b / (b + a * f))


def block_drift(frame: DataFrame, value: str, block: str, blocks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """by, block, n_ref, n_blk, ks, levene, median_ref, median_blk: each block against the rows of all earlier ones.

    ``blocks`` are in order of time; the first is a reference only. Rows are counted by distinct value and block, and
    one running sum over the values, a column a block, gives the distribution functions and medians of every block and
    of every union of earlier ones; a second aggregate over the distinct values gives Levene's sums about these medians.
    ks is the largest distance of the distribution functions, levene the statistic of the deviations from the medians.
    Null values and other blocks are left out; statistics are null where either side has fewer than two rows, and
    levene where no value departs from its median.
    """
    blocks, by = list(blocks), list(by)
    m = len(blocks)
    own = frame.filter(F.col(value).isNotNull() & F.col(block).isin(blocks)).groupBy(*by, F.col(value).cast("double").alias("_v"))
    counts = own.agg(*(F.count_if(F.col(block) == b).alias(f"_c{i}") for i, b in enumerate(blocks)))
    run = cumulative(counts, [F.asc("_v")], {f"_b{i}": F.col(f"_c{i}") for i in range(m)}, by)
    totals = counts.groupBy(*by).agg(*(F.sum(f"_c{i}").alias(f"_n{i}") for i in range(m)))
    both = run.join(totals, by) if by else run.crossJoin(F.broadcast(totals))

    def earlier(letter: str, i: int) -> Column:
        return sum((F.col(f"_{letter}{j}") for j in range(1, i)), F.col(f"_{letter}0"))

    def median(upto: Column, n: Column) -> Column:
        low = F.min(F.when(upto >= F.ceil(n / 2), F.col("_v")))
        return (low + F.min(F.when(upto >= F.floor(n / 2) + 1, F.col("_v")))) / 2

    aggs = []
    for i in range(1, m):
        upto_ref, upto_blk = earlier("b", i) + earlier("c", i), F.col(f"_b{i}") + F.col(f"_c{i}")
        n_ref, n_blk = earlier("n", i), F.col(f"_n{i}")
        aggs.append(F.struct(
            F.max(n_ref).alias("n_ref"), F.max(n_blk).alias("n_blk"), F.max(F.abs(ratio(upto_ref, n_ref) - ratio(upto_blk, n_blk))).alias("ks"),
            median(upto_ref, n_ref).alias("median_ref"), median(upto_blk, n_blk).alias("median_blk"),
        ).alias(f"_s{i}"))
    first = both.groupBy(*by).agg(*aggs)
    away = run.join(first, by) if by else run.crossJoin(F.broadcast(first))
    sums = []
    for i in range(1, m):
        d_ref, d_blk = F.abs(F.col("_v") - F.col(f"_s{i}.median_ref")), F.abs(F.col("_v") - F.col(f"_s{i}.median_blk"))
        k_ref, k_blk = earlier("c", i), F.col(f"_c{i}")
        sums.append(F.struct(F.sum(k_ref * d_ref).alias("a1"), F.sum(k_ref * d_ref * d_ref).alias("a2"), F.sum(k_blk * d_blk).alias("b1"), F.sum(k_blk * d_blk * d_blk).alias("b2"), F.first(f"_s{i}").alias("s"), F.lit(blocks[i]).alias("block")).alias(f"_z{i}"))
    made = away.groupBy(*by).agg(*sums).select(*by, F.explode(F.array(*(F.col(f"_z{i}") for i in range(1, m)))).alias("z")) if m > 1 else None
    if made is None:
        raise ValueError("there must be two blocks at least")
    z, s = F.col("z"), F.col("z")["s"]
    n, k = s["n_ref"], s["n_blk"]
    a, b = z["a1"] / n, z["b1"] / k
    mean = (z["a1"] + z["b1"]) / (n + k)
    within = (z["a2"] - n * a * a) + (z["b2"] - k * b * b)
    among = n * (a - mean) * (a - mean) + k * (b - mean) * (b - mean)
    ok = (n >= 2) & (k >= 2)
    return made.select(
        *by, z["block"].alias("block"), n.alias("n_ref"), k.alias("n_blk"), F.when(ok, s["ks"]).alias("ks"),
        F.when(ok & (within > 1e-12 * (z["a2"] + z["b2"])), among * (n + k - 2) / within).alias("levene"), s["median_ref"].alias("median_ref"), s["median_blk"].alias("median_blk"),
    )


@F.pandas_udf(T.StructType([T.StructField("ks_p", T.DoubleType()), T.StructField("levene_p", T.DoubleType())]))
def _p_values(ks: pd.Series, levene: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
    out = [(math.nan if math.isnan(d) else kolmogorov_tail(math.sqrt(a * b / (a + b)) * d), math.nan if math.isnan(w) else f_tail(w, 1, a + b - 2)) for d, w, a, b in zip(ks, levene, n, k, strict=True)]
    return pd.DataFrame(out, columns=["ks_p", "levene_p"])


def drift_p_values(table: DataFrame) -> DataFrame:
    """block_drift() with ks_p (by the limiting distribution) and levene_p, null where their statistics are; a row a block."""
    none = F.lit(math.nan)
    made = table.withColumn("_p", _p_values(F.coalesce("ks", none), F.coalesce("levene", none), "n_ref", "n_blk"))
    return made.select(*table.columns, *(F.when(~F.isnan(f"_p.{c}"), F.col(f"_p.{c}")).alias(c) for c in ("ks_p", "levene_p")))


#: Rational approximations of the normal quantile function (Wichura, algorithm AS 241): numerators and denominators, lowest power first. Fixed values.
CENTRAL = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
           (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
MIDDLE = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
          (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324))
FAR = ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 0.000000201033439929228813265),
       (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 0.0000184631831751005468180, 0.000000142151175831644588870, 0.00000000000000204426310338993978564))
#: Coefficients of Shapiro and Wilk's test (Royston, algorithm AS R94), lowest power first: corrections of the two outer weights, mean and log deviation up to 11 values and beyond. Fixed values.
OUTER = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
FEW = (-2.273, 0.459), (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
MANY = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _poly(c: Sequence[float], x):
    out = c[-1]
    for a in reversed(c[:-1]):
        out = out * x + a
    return out


def normal_quantile(p: Column) -> Column:
    """Normal deviate below which a share p lies, 0 < p < 1."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    inner = 0.180625 - q * q
    tail = F.when(r <= 5, _poly(MIDDLE[0], r - 1.6) / _poly(MIDDLE[1], r - 1.6)).otherwise(_poly(FAR[0], r - 5) / _poly(FAR[1], r - 5))
    return F.when(F.abs(q) <= 0.425, q * _poly(CENTRAL[0], inner) / _poly(CENTRAL[1], inner)).otherwise(F.signum(q) * tail)


def shapiro_wilk(frame: DataFrame, value: str, key: Sequence[str], by: Sequence[str] = (), most: int = 5000, seed: int = 0) -> DataFrame:
    """by, n, w, z, p: whether values are normal, of up to ``most`` of them.

    The test holds up to 5,000 values; of a larger group the ``most`` rows of lowest seeded hash of ``key`` are tested,
    and n is what is tested. Ranks come from a running count over ranges of values; expected normal order statistics
    are an expression of the rank, and w is one weighted aggregate. Nulls are left out; w is null below 3 values or
    without spread, and p is that of the upper normal tail of z (for three values of w itself).
    """
    if most > 5000:
        raise ValueError("the test holds up to 5,000 values")
    by = list(by)
    own = frame.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.xxhash64(*key, F.lit(seed)).alias("_h"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
    draw = [F.asc("_h"), *(F.asc(f"_k{i}") for i in range(len(key)))]
    own = cumulative(own, draw, {"_d": F.lit(1)}, by).filter(F.col("_d") < most)
    own = cumulative(own, [F.asc("_v"), *draw], {"_i": F.lit(1)}, by)
    sizes = own.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_v").alias("_mean"))
    both = own.join(sizes, by) if by else own.crossJoin(F.broadcast(sizes))
    n, i = F.col("_n"), F.col("_i") + 1
    both = both.withColumn("_m", normal_quantile((i - 0.375) / (n + 0.25)))
    outer = both.groupBy(*by).agg(F.sum(F.col("_m") * F.col("_m")).alias("_mm"), F.max(F.when(i == n, F.col("_m"))).alias("_m1"), F.max(F.when(i == n - 1, F.col("_m"))).alias("_m2"))
    both = both.join(outer, by) if by else both.crossJoin(F.broadcast(outer))
    root, mm, m1, m2 = F.sqrt("_mm"), F.col("_mm"), F.col("_m1"), F.col("_m2")
    u = 1 / F.sqrt(n)
    a1 = F.when(n == 3, math.sqrt(0.5)).otherwise(m1 / root + _poly(OUTER, u))
    a2 = m2 / root + _poly(NEXT, u)
    phi = F.when(n > 5, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)).otherwise((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1))
    rank = F.greatest(i, n + 1 - i)
    weight = F.signum(2 * i - n - 1) * F.when(rank == n, a1).when((rank == n - 1) & (n > 5), a2).when(n == 3, 0.0).otherwise(F.abs(F.col("_m")) / F.sqrt(phi))
    y = F.col("_v") - F.col("_mean")
    made = both.groupBy(*by).agg(F.max("_n").alias("n"), F.sum(weight * y).alias("_ay"), F.sum(y * y).alias("_ss"))
    n, logn = F.col("n"), F.ln("n")
    w = F.when((n >= 3) & (F.col("_ss") > 0), F.least(F.lit(1.0), F.col("_ay") * F.col("_ay") / F.col("_ss")))
    made = made.select(*by, "n", w.alias("w"))
    rest = F.ln(F.greatest(1 - F.col("w"), F.lit(1e-300)))
    gamma = _poly(FEW[0], n)
    few = (-F.ln(F.greatest(gamma - rest, F.lit(1e-300))) - _poly(FEW[1], n)) / F.exp(_poly(FEW[2], n))
    many = (rest - _poly(MANY[0], logn)) / F.exp(_poly(MANY[1], logn))
    z = F.when(F.col("w").isNotNull() & (n > 3), F.when(n <= 11, few).otherwise(many))
    made = made.withColumn("z", z)
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    return made.withColumn("p", F.when(F.col("w").isNull(), None).when(n == 3, three).otherwise(normal_upper(F.col("z"))))


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    """Upper tail of the normal distribution; a row a group."""
    return z.map(lambda x: math.erfc(x / math.sqrt(2)) / 2, na_action="ignore")
