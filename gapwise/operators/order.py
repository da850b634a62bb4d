"""Order statistics and running sums over whole tables, without a task that holds or sorts all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions.storage import checkpoint

#: Ranks that a quantile's bracket is off by at most, as a share of all rows.
BRACKET = 100_000
#: Groups whose bounds are broadcast.
FEW = 10_000


def quantiles(frame: DataFrame, value: str | Column, qs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles (linear interpolation) of the values that aren't null: by, and a column for each of ``qs`` (q0, q1 ..., or names).

    A sketch of bounded size gives bounds of each quantile first. A second pass counts the rows below them and at them,
    and gathers those strictly between, about one in 15,000 of a group however many values are equal.
    """
    names = list(names) or [f"q{i}" for i in range(len(qs))]
    x = F.col(value) if isinstance(value, str) else value
    own = frame.select(*by, x.cast("double").alias("_x")).filter("_x is not null")
    edges = [min(1.0, max(0.0, q + side * 2.5 / BRACKET)) for q in qs for side in (-1, 1)]
    probe = own.groupBy(*by).agg(F.percentile_approx("_x", edges, BRACKET).alias("_e"), F.count("*").alias("_n"))
    if by:
        probe = checkpoint(probe)
        # to join a few large groups by their key would take each of them to one task
        both = own.join(F.broadcast(probe) if probe.count() <= FEW else probe, list(by))
    else:
        both = own.crossJoin(F.broadcast(probe))
    made = both.groupBy(*by).agg(F.max("_n").alias("_n"), *(_around(i).alias(f"_b{i}") for i in range(len(qs))))
    out = []
    for i, (q, name) in enumerate(zip(qs, names, strict=True)):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = _ranked(f"_b{i}", F.floor(at)), _ranked(f"_b{i}", F.ceil(at))
        # as percentile() interpolates
        out.append(F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    return made.select(*by, *out)


def _around(i: int) -> Column:
    """Of the bounds of quantile i: rows below, at the lower one and at the upper one, the values strictly between, and the next ones outside."""
    x, lo, hi = F.col("_x"), F.col("_e")[2 * i], F.col("_e")[2 * i + 1]
    return F.struct(
        F.count_if(x < lo).alias("below"), F.count_if(x == lo).alias("at_lo"), F.count_if((x == hi) & (hi > lo)).alias("at_hi"), F.max(lo).alias("lo"), F.max(hi).alias("hi"),
        F.collect_list(F.when((x > lo) & (x < hi), x)).alias("inside"), F.max(F.when(x < lo, x)).alias("before"), F.min(F.when(x > hi, x)).alias("after"),
    )


def _ranked(name: str, rank: Column) -> Column:
    """Value of a rank from 0 that lies between the bounds, or next to them."""
    b = F.col(name)
    i = rank - b["below"]
    j = i - b["at_lo"]
    k = j - F.size(b["inside"])
    inside = F.get(F.sort_array(b["inside"]), j.cast("int"))
    return F.when(i < 0, b["before"]).when(j < 0, b["lo"]).when(k < 0, inside).when(k < b["at_hi"], b["hi"]).otherwise(b["after"])


def following(name: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """The next value of a column that isn't null, of the rows after this one, found by one walk: a frame up to the group's end would be read anew for each row."""
    return F.expr(f"lead({name}) IGNORE NULLS OVER (PARTITION BY {', '.join(by)} ORDER BY {', '.join(order)})")


def cumulative(frame: DataFrame, order: Sequence[Column], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds each of ``sums`` taken over the rows of the group that come earlier in ``order`` (0 for the first), which must tell rows apart.

    Rows are parted by ranges of group and order; each part adds the totals of those before it, one row a part and
    group, to its own running sum.
    """
    own = frame.withColumns({f"_s_{k}": v for k, v in sums.items()}).repartitionByRange(*by, *order)
    own = checkpoint(own.withColumn("_p", F.spark_partition_id()))
    totals = own.groupBy("_p", *by).agg(*(F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", *by, *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    inside = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = own.join(offsets if by else F.broadcast(offsets), ["_p", *by])  # a row a part, and group
    return made.select(*frame.columns, *((F.coalesce(F.sum(f"_s_{k}").over(inside), F.lit(0)) + F.col(f"_o_{k}")).alias(k) for k in sums))


def lagged(frame: DataFrame, order: Sequence[str], value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``value`` of the row before in ascending ``order`` of the group (null for the first), which must tell rows apart; by ranges, with the last row of each part carried over."""
    own = checkpoint(frame.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    ends = own.groupBy("_p", *by).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_p")
    ends = ends.select("_p", *by, F.lag("_end").over(before)["v"].alias("_carried"))  # a row a part, and group
    inside = Window.partitionBy("_p", *by).orderBy(*order)
    made = own.join(ends if by else F.broadcast(ends), ["_p", *by])
    previous = F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(F.lag(value).over(inside))
    return made.select(*frame.columns, previous.alias(name))


def running_min(frame: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """The frame with ``value`` replaced by the least of it over this row and all earlier ones in ``order``, which must tell rows apart; by ranges, as in cumulative()."""
    own = checkpoint(frame.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    lows = own.groupBy("_p").agg(F.min(value).alias("_low"))
    before = lows.select("_p", F.min("_low").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_low"))  # a row a part
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = own.join(F.broadcast(before), "_p").withColumn("_m", F.least(F.min(value).over(inside), F.col("_low")))
    return made.select(*(F.col("_m").alias(c) if c == value else F.col(c) for c in frame.columns))


def ranked_counts(frame: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False, more: dict[str, Column] | None = None) -> DataFrame:
    """by, value, n and ``more`` (aggregates) of each distinct value that isn't null, with how many rows come before it, and all of the group (total).

    before and before_<name> are sums over the smaller values (greater, if descending).
    """
    more = more or {}
    counts = frame.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in more.items()))
    order = F.desc(value) if descending else F.asc(value)
    own = cumulative(counts, [order], {"before": F.col("n"), **{f"before_{k}": F.col(k) for k in more}}, by)
    totals = own.groupBy(*by).agg(F.sum("n").alias("total"), *(F.sum(k).alias(f"total_{k}") for k in more))
    return own.join(totals, list(by)) if by else own.crossJoin(F.broadcast(totals))
