"""What is summed over all pairs of a stream's points, without making pairs: Mann-Kendall's S and the median slope.

Points are numbered in order of time and in order of value. Of two points the later one is lower exactly if the two
numbers stand in opposite order, an inversion. Inversions are counted within cells of consecutive times, within cells
of consecutive values, and between cells by how many points each pair of cells holds, so that what a task holds is a
cell, of a fixed number of points, however long the stream is and however many values are equal.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.storage import checkpoint
from gapwise.operators.order import cumulative
from gapwise.operators.series import whole_groups

#: Points of a cell.
CELL = 1 << 17
#: Pairs that a task makes at once, of streams so short that this is cheaper than halving.
PAIRS = 1 << 18


def inversions_of(ranks: np.ndarray, owner: np.ndarray, group: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Of each owner (numbered from 0, in order), pairs of its distinct numbers that stand in falling order, of the same group; a pair counts the product of its weights. Bit by bit from the highest."""
    n = len(ranks)
    out = np.zeros(int(owner[-1]) + 1 if n else 0, np.int64)
    if n < 2:
        return out
    order = np.lexsort((ranks, owner))
    places = np.arange(n)
    dense = np.empty(n, np.int64)
    dense[order] = places - np.maximum.accumulate(np.where(np.diff(owner, prepend=-1) != 0, places, 0))
    groups = owner.astype(np.int64)
    if group is not None:
        kinds = np.unique(group, return_inverse=True)[1].astype(np.int64)
        groups = np.unique(groups * (int(kinds.max()) + 1) + kinds, return_inverse=True)[1].astype(np.int64)
    at = np.argsort(groups, kind="stable")
    key, value, whose = groups[at], dense[at], owner[at]
    w = np.ones(n, np.int64) if weight is None else weight[at].astype(np.int64)
    for bit in range(int(dense.max()).bit_length() - 1, -1, -1):
        # rows lie by group and higher bits, in their order
        one = (value >> bit) & 1
        before = np.cumsum(one * w) - one * w
        start = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(start, places, 0))
        falls = np.cumsum(np.where(one == 0, w * (before - before[first]), 0))  # owners lie together
        ends = np.flatnonzero(np.concatenate([whose[1:] != whose[:-1], [True]]))
        out[whose[ends]] += np.diff(falls[ends], prepend=0)
        key = key * 2 + one
        at = np.argsort(key, kind="stable")
        key, value, whose, w = key[at], value[at], whose[at], w[at]
        key = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    return out


def inversions(ranks: np.ndarray, group: np.ndarray | None = None) -> int:
    """Pairs of a sequence of distinct numbers that stand in falling order, of the same group."""
    return int(inversions_of(ranks, np.zeros(len(ranks), np.int64), group).sum())


def _owners(starts: np.ndarray, n: int) -> np.ndarray:
    """Number of the group that each row is in."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def _placed(points: DataFrame, order: list, place: str, held: str, cell: int) -> DataFrame:
    """The points in parts by ranges of ``order``, which tells them apart, each sorted: place rises along all parts, held is the first place of the cell that a point is in."""
    own = points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    return own.withColumn(held, F.col(place) - F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) % cell)  # the lower 33 bits number a part's rows


def signed_pairs(points: DataFrame, by: list[str], cell: int = CELL) -> DataFrame:
    """by, n, n_pairs, s: points, pairs of different times, and over these the number that rise less the number that fall.

    ``points`` has t and x; rows with a null among them are left out, and equal points count each. Points go to parts
    by their order of value, then by their order of time; a part counts the pairs of each of its cells. The counts of
    pairs of cells, at most (n / cell + 2) ** 2 of a stream, pass through one task.
    """
    own = checkpoint(points.filter("t is not null and x is not null").select(*by, "t", "x", F.monotonically_increasing_id().alias("_id")))
    # pairs of equal time come out as falling unless their values are equal, pairs of equal value as falling
    at_time = own.groupBy(*by, "t", "x").agg(F.count("*").alias("k")).groupBy(*by, "t").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    same_time = at_time.groupBy(*by).agg(F.sum("m").alias("n"), (F.sum(F.col("m") * F.col("m") - F.col("kk")) / 2).cast("long").alias("same_t"), (F.sum(F.col("m") * (F.col("m") - 1)) / 2).cast("long").alias("all_t"))
    same_value = own.groupBy(*by, "x").agg(F.count("*").alias("k")).groupBy(*by).agg((F.sum(F.col("k") * (F.col("k") - 1)) / 2).cast("long").alias("same_x"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select(*by).schema.fields)
    by_value = checkpoint(_placed(own, [*by, F.asc("x"), F.desc("t"), F.desc("_id")], "r", "rc", cell).drop("_id"))

    def in_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, [*by, "rc"]):
            owner = _owners(starts, len(rows))
            order = np.lexsort((-np.arange(len(rows)), rows["t"].to_numpy(), owner))  # of equal times the higher value first
            yield rows.iloc[starts][by].assign(pc=-1, rc=-1, n=0, inv=inversions_of(order, owner))

    def in_times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, [*by, "pc"]):
            r, rc, owner = rows["r"].to_numpy(), rows["rc"].to_numpy(), _owners(starts, len(rows))
            order = np.lexsort((rc, owner))
            new = np.flatnonzero((np.diff(owner[order], prepend=-1) != 0) | (np.diff(rc[order], prepend=-1) != 0))
            cells = rows.iloc[order[new]][[*by, "pc", "rc"]].assign(n=np.diff(np.append(new, len(rows))), inv=0)
            # pairs of one cell of values are counted there
            cells.iloc[np.flatnonzero(np.diff(owner[order[new]], prepend=-1)), -1] = inversions_of(r, owner) - inversions_of(r, owner, rc)
            yield cells

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, by):
            # cells lie by time and value; those that share either don't fall
            owner, n = _owners(starts, len(rows)), rows["n"].to_numpy()
            order = np.lexsort((rows["pc"].to_numpy(), rows["rc"].to_numpy(), owner))
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows))
            yield rows.iloc[starts][by].assign(inv=np.add.reduceat(rows["inv"].to_numpy(), starts) + inversions_of(rank, owner, weight=n))

    by_time = _placed(by_value, [*by, F.asc("t"), F.desc("x"), F.desc("r")], "p", "pc", cell).select(*by, "pc", "r", "rc")
    schema = f"{kinds}, pc long, rc long, n long, inv long"
    # many streams a batch
    parts = by_value.select(*by, "t", "rc").mapInPandas(in_values, schema).unionByName(by_time.mapInPandas(in_times, schema))
    found = parts.repartition(*by).sortWithinPartitions(*by, "pc", "rc").mapInPandas(between, f"{kinds}, inv long")
    n = F.col("n")
    return found.join(same_time, by).join(same_value, by).select(
        *by, "n", ((n * (n - 1) / 2).cast("long") - F.col("all_t")).alias("n_pairs"), ((n * (n - 1) / 2).cast("long") - 2 * F.col("inv") + F.col("same_x") + F.col("same_t")).alias("s")
    )


def mann_kendall(series: DataFrame, by: str, t: str, value: str, cell: int = CELL) -> DataFrame:
    """n, s, variance with ties, and Z with continuity of each stream: whether its values rise over time.

    Pairs of equal time count neither way; rows with a null among time and value are left out; without spread Z is null.
    """
    own = checkpoint(series.filter(F.col(t).isNotNull() & F.col(value).isNotNull()).select(by, t, value))  # read by each of the counts
    made = signed_pairs(own.select(by, F.col(t).alias("t"), F.col(value).alias("x")), [by], cell)
    ties = own.groupBy(by, value).agg(F.count("*").alias("k")).groupBy(by).agg(F.sum(F.col("k") * (F.col("k") - 1) * (2 * F.col("k") + 5)).alias("tie"))
    n, s = F.col("n"), F.col("s").cast("double")
    both = made.join(ties, by).withColumn("var", (n * (n - 1) * (2 * n + 5) - F.col("tie")) / 18.0)
    return both.select(by, "n", s.alias("s"), "var", F.when(F.col("var") > 0, (s - F.signum(s)) / F.sqrt("var")).alias("z"))


def _key(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles (zeros of either sign alike)."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _double(k: int) -> float:
    bits = k if k >= 0 else -(2**63) - k
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def falling(t: np.ndarray, x: np.ndarray, slope: float) -> int:
    """Pairs of different times whose slope is at most this, of points in order of time."""
    z = x - slope * t
    order = np.lexsort((z, t))  # of equal times the lower first, so that none counts
    rank = np.empty(len(z), np.int64)
    rank[np.lexsort((-np.arange(len(z)), z[order]))] = np.arange(len(z))  # of equal ones the later first: counted
    same = np.unique(t, return_counts=True)[1]
    ties = 0
    if (same > 1).any():
        pairs = pd.DataFrame({"t": t, "z": z}).groupby(["t", "z"]).size().to_numpy()
        ties = int((pairs * (pairs - 1) // 2).sum())
    return inversions(rank) - ties


def median_slope(t: np.ndarray, x: np.ndarray) -> float:
    """Median of the slopes of all pairs of different times; nan without one. The slope is found by halving between bounds, counting the lower ones."""
    order = np.lexsort((x, t))
    t, x = t[order], x[order]
    same = np.unique(t, return_counts=True)[1]
    m = len(t) * (len(t) - 1) // 2 - int((same * (same - 1) // 2).sum())
    if m < 1:
        return float("nan")
    t, shift = t - t[0], x - x.mean()
    steps = np.diff(np.unique(t)).min()
    bound = float(_double(int(_key(np.array([(shift.max() - shift.min()) / steps]))[0]) + 4))
    found = []
    for k in sorted({(m - 1) // 2 + 1, m // 2 + 1}):
        lo, hi = int(_key(np.array([-bound]))[0]) - 1, int(_key(np.array([bound]))[0])
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if falling(t, shift, _double(mid)) >= k:
                hi = mid
            else:
                lo = mid
        found.append(_double(hi))
    return float(np.mean(found))


def median_slopes(t: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """median_slope() of many streams that follow one another, each in order of time: short ones of equal length side by side, by their pairs."""
    sizes = np.diff(np.append(starts, len(t)))
    out = np.full(len(starts), np.nan)
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        pairs = int(n) * (int(n) - 1) // 2
        if pairs > PAIRS:
            for i in same:
                out[i] = median_slope(t[starts[i] : starts[i] + n], x[starts[i] : starts[i] + n])
        elif pairs:
            a, b = np.triu_indices(n, 1)
            for some in np.array_split(same, -(-len(same) * pairs // PAIRS)):
                at = starts[some][:, None] + np.arange(n)
                later = t[at[:, b]] - t[at[:, a]]
                with np.errstate(all="ignore"):
                    slopes = np.sort(np.where(later > 0, (x[at[:, b]] - x[at[:, a]]) / later, np.nan), axis=1)  # nan comes last
                m, i = np.count_nonzero(later > 0, axis=1), np.arange(len(some))
                out[some] = np.where(m > 0, (slopes[i, np.maximum(m - 1, 0) // 2] + slopes[i, np.minimum(m // 2, pairs - 1)]) / 2, np.nan)
    return out


def theil_sen(series: DataFrame, by: str, t: str, value: str, cell: int = CELL, guesses: int = 15) -> DataFrame:
    """by, slope: the median slope over pairs of points of different times, null without one.

    Streams of up to ``cell`` points are solved in a task. Of longer ones the slopes below ``guesses`` values at a time
    are counted as falling pairs of what a guess leaves of the points, until the bounds meet in the last bit.
    """
    own = series.filter(F.col(t).isNotNull() & F.col(value).isNotNull()).select(by, F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("x"))
    sizes = own.groupBy(by).agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.avg("x").alias("x0"), (F.max("x") - F.min("x")).alias("range"))
    kind = own.schema[by].dataType.simpleString()

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, [by]):
            yield rows.iloc[starts][[by]].assign(slope=median_slopes(rows["t"].to_numpy(), rows["x"].to_numpy(), starts))

    short = own.join(sizes.filter(F.col("n") <= cell).select(by), by).repartition(by).sortWithinPartitions(by, "t").mapInPandas(small, f"{by} {kind}, slope double")
    out = short.withColumn("slope", F.when(~F.isnan("slope"), F.col("slope")))
    large = sizes.filter(F.col("n") > cell)
    if large.isEmpty():
        return out
    points = checkpoint(own.join(large, by).select(by, (F.col("t") - F.col("t0")).alias("t"), (F.col("x") - F.col("x0")).alias("x")))
    return out.unionByName(_long_slopes(points, by, large.select(by, "range"), cell, guesses))


def _long_slopes(points: DataFrame, by: str, ranges: DataFrame, cell: int, guesses: int) -> DataFrame:
    """Median slopes of long streams. Streams of over ``cell`` points are few enough for the driver to hold a row of each."""
    w = points.select(by, "t").distinct()
    steps = cumulative(w, [F.asc("t")], {"_i": F.lit(1)}, [by])
    after = steps.select(by, F.col("t").alias("u"), (F.col("_i") - 1).alias("_i"))
    least = steps.join(after, [by, "_i"]).groupBy(by).agg(F.min(F.col("u") - F.col("t")).alias("step"))
    bound = {r[by]: r["range"] / r["step"] for r in ranges.join(least, by).collect()}
    pairs = {r[by]: r["n_pairs"] for r in signed_pairs(points, [by], cell).collect() if r[by] in bound}
    wanted, bounds = {}, {}
    for stream, m in pairs.items():
        for k in sorted({(m - 1) // 2 + 1, m // 2 + 1}):
            wanted[stream, k] = k
            bounds[stream, k] = (int(_key(np.array([-bound[stream]]))[0]) - 8, int(_key(np.array([bound[stream]]))[0]) + 8)
    spark = points.sparkSession
    kind = points.schema[by].dataType.simpleString()
    while any(hi - lo > 1 for lo, hi in bounds.values()):
        tried = {}
        for (stream, _), (lo, hi) in bounds.items():
            for i in range(1, guesses + 1):
                g = lo + (hi - lo) * i // (guesses + 1)
                if lo < g < hi:
                    tried.setdefault(stream, set()).add(g)
        table = spark.createDataFrame([(s, g, _double(g)) for s, gs in tried.items() for g in sorted(gs)], f"{by} {kind}, _g long, _slope double")
        moved = points.join(F.broadcast(table), by).select(by, "_g", "t", (F.col("x") - F.col("_slope") * F.col("t")).alias("x"))
        # slopes at most a guess: pairs that fall or stay; s counts rising less falling ones
        level = moved.groupBy(by, "_g", "t", "x").agg(F.count("*").alias("k"))
        in_time = level.groupBy(by, "_g").agg((F.sum(F.col("k") * (F.col("k") - 1)) / 2).cast("long").alias("both"))
        flat = level.groupBy(by, "_g", "x").agg(F.sum("k").alias("k")).groupBy(by, "_g").agg((F.sum(F.col("k") * (F.col("k") - 1)) / 2).cast("long").alias("flat"))
        counted = signed_pairs(moved, [by, "_g"], cell).join(in_time, [by, "_g"]).join(flat, [by, "_g"])
        below = {(r[by], r["_g"]): (r["n_pairs"] - r["s"] + r["flat"] - r["both"]) // 2 for r in counted.collect()}
        for (stream, k), (lo, hi) in list(bounds.items()):
            for g in sorted(tried.get(stream, ())):
                if lo < g < hi and below[stream, g] >= k:
                    hi = g
                elif lo < g < hi:
                    lo = g
            bounds[stream, k] = (lo, hi)
    slopes = {s: float(np.mean([_double(hi) for (other, _), (_, hi) in bounds.items() if other == s])) for s in pairs}
    return spark.createDataFrame([(s, x) for s, x in slopes.items()], f"{by} {kind}, slope double")
