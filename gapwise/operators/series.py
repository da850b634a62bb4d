"""Work along whole segments in Arrow batches: many segments side by side in numpy, and filters whose segments may span tasks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.storage import written

#: Samples of padded segments that are held at once.
CELLS = 1 << 20


def _shares(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of segments of like length, so that what is padded to the longest stays within CELLS, one segment at least."""
    order = np.argsort(-sizes, kind="stable")
    start = 0
    while start < len(order):
        most = max(1, CELLS // max(1, int(sizes[order[start]])))
        yield order[start : start + most]
        start += most


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of a partition that is sorted by keys, in pieces of whole groups, and where each group of a piece begins."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        parts = [x for x in (rest, batch) if x is not None and len(x)]
        if not parts:
            continue
        rows = pd.concat(parts, ignore_index=True)
        new = np.zeros(len(rows), bool)
        new[0] = True
        for k in keys:
            x = rows[k].to_numpy()
            same = (x[1:] == x[:-1]) | (pd.isna(x[1:]) & pd.isna(x[:-1]))
            new[1:] |= ~same
        starts = np.flatnonzero(new)
        end = len(rows) if batch is None else int(starts[-1])  # the last group may go on
        rest = rows.iloc[end:] if batch is not None else None
        starts = starts[starts < end]
        if len(starts):
            yield rows.iloc[:end], starts


def side_by_side(segments: DataFrame, inputs: dict[str, Column], run: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], outputs: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """src, seg_id, pos, ``keep`` and outputs: what ``run`` makes of the inputs of many segments at a time.

    It gets arrays (segments, longest) with NaN for nulls and after a segment's end, and sizes, and gives such arrays;
    NaN comes out as null. A segment must fit a task, and as many lie side by side as an Arrow batch holds.
    """
    names = list(inputs)
    extra = [c for c in keep if c not in ("src", "seg_id", "pos")]

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, ["src", "seg_id"]):
            end = len(rows)
            sizes = np.diff(np.append(starts, end))
            made = {c: np.full(end, np.nan) for c in outputs}
            values = {c: rows[c].to_numpy(float) for c in names}
            for some in _shares(sizes):
                n = sizes[some]
                owner, at = np.repeat(np.arange(len(some)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(starts[some], n) + at
                padded = {}
                for c in names:
                    padded[c] = np.full((len(some), n.max()), np.nan)
                    padded[c][owner, at] = values[c][place]
                for c, x in run(padded, n).items():
                    made[c][place] = x[owner, at]
            yield rows[["src", "seg_id", "pos", *extra]].assign(**made)

    own = segments.select("src", "seg_id", "pos", *extra, *(c.cast("double").alias(k) for k, c in inputs.items()))
    own = own.repartition("src", "seg_id").sortWithinPartitions("src", "seg_id", "pos")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in own.select("src", "seg_id", "pos", *extra).schema.fields] + [f"{c} double" for c in outputs]
    made = own.mapInPandas(one, ", ".join(fields))
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in outputs})


# Cubic splines


def tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Solutions of systems (rows, longest) of given sizes with lower, main and upper diagonals and right sides, by elimination forth and back."""
    c, d = c.copy(), d.copy()
    m = d.shape[1]
    with np.errstate(all="ignore"):
        for i in range(m):
            low = a[:, i] if i else 0.0
            pivot = b[:, i] - (low * c[:, i - 1] if i else 0.0)
            c[:, i] = c[:, i] / pivot
            d[:, i] = (d[:, i] - (low * d[:, i - 1] if i else 0.0)) / pivot
        for i in range(m - 2, -1, -1):
            more = i + 1 < sizes
            d[more, i] -= c[more, i] * d[more, i + 1]
    return d


def second_derivatives(t: np.ndarray, y: np.ndarray, sizes: np.ndarray, ends: str) -> np.ndarray:
    """Second derivatives at the knots (rows, longest) of cubic splines; ``ends`` is not-a-knot or natural.

    Two knots make a line; three without end conditions of their own a parabola.
    """
    rows, m = t.shape
    out = np.zeros((rows, m))
    if m < 3:
        return out
    h = np.diff(t, axis=1)
    slope = np.diff(y, axis=1) / h
    a, b, c = h[:, :-1].copy(), 2 * (h[:, :-1] + h[:, 1:]), h[:, 1:].copy()
    d = 6 * np.diff(slope, axis=1)
    inner = sizes - 2
    last = np.maximum(inner - 1, 0)
    i = np.arange(rows)
    if ends == "not-a-knot":
        h0, h1 = h[:, 0].copy(), h[:, 1].copy()
        e1, e0 = h[i, last].copy(), h[i, last + 1].copy()  # the last but one and the last interval
        single, several = inner == 1, inner > 1
        b[several, 0] = ((h0 + h1) * (h0 + 2 * h1) / h1)[several]
        c[several, 0] = ((h1 * h1 - h0 * h0) / h1)[several]
        b[i[several], last[several]] = ((e0 + e1) * (e0 + 2 * e1) / e1)[several]
        a[i[several], last[several]] = ((e1 * e1 - e0 * e0) / e1)[several]
        b[single, 0] = 3 * (h0 + h1)[single]
    solved = tridiagonal(a, b, c, d, np.maximum(inner, 0))
    inside = np.arange(m - 2) < inner[:, None]
    out[:, 1:-1] = np.where(inside, solved, 0.0)
    if ends == "not-a-knot":
        one = inner == 1
        out[one, 0] = out[one, 2] = out[one, 1]
        many = np.flatnonzero(inner > 1)
        out[many, 0] = out[many, 1] + (out[many, 1] - out[many, 2]) * h0[many] / h1[many]
        k = sizes[many] - 1
        out[many, k] = out[many, k - 1] + (out[many, k - 1] - out[many, k - 2]) * e0[many] / e1[many]
    return out


def spline_through(t: np.ndarray, x: np.ndarray, ends: str) -> np.ndarray:
    """Values (rows, longest) of the cubic splines through the known samples, at all times; NaN without a known sample or a time."""
    known = ~np.isnan(x) & ~np.isnan(t)
    known[:, 1:] &= ~((t[:, 1:] == t[:, :-1]) & known[:, :-1])  # of samples of one time the first is a knot
    sizes = known.sum(axis=1)
    m = max(int(sizes.max()), 1)
    owner, _ = np.nonzero(known)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kt, ky = np.tile(np.arange(m, dtype=float), (len(t), 1)), np.zeros((len(t), m))
    for r in np.flatnonzero(sizes):
        kt[r, sizes[r] :] = np.inf
    kt[owner, at], ky[owner, at] = t[known], x[known]
    finite = np.where(np.isinf(kt), 0.0, kt)
    steps = np.maximum.accumulate(finite, axis=1) + np.where(np.isinf(kt), np.arange(m), 0.0)  # distinct fillers behind the end
    curve = second_derivatives(steps, ky, sizes, ends)
    # the interval of each time: knots at or before it, the first and the last one go on beyond the ends
    before = np.cumsum(known, axis=1)
    i = np.clip(before - 1, 0, np.maximum(sizes - 2, 0)[:, None])
    r = np.arange(len(t))[:, None]
    j = np.minimum(i + 1, m - 1)
    t0, t1, y0, y1, c0, c1 = steps[r, i], steps[r, j], ky[r, i], ky[r, j], curve[r, i], curve[r, j]
    h = np.where(t1 > t0, t1 - t0, 1.0)
    a, b = (t1 - t) / h, (t - t0) / h
    value = a * y0 + b * y1 + ((a**3 - a) * c0 + (b**3 - b) * c1) * h * h / 6
    value = np.where(sizes[:, None] == 1, ky[:, :1], value)
    return np.where((sizes[:, None] > 0) & ~np.isnan(t), value, np.nan)


def cubic_filled(segments: DataFrame, x: str, seconds: Column | None = None, ends: str = "not-a-knot") -> DataFrame:
    """``segments`` with filled: null samples of ``x`` taken from the cubic spline through the segment's known ones.

    Knots lie at ``seconds`` (pos, if there is none). Samples before the first knot and after the last go on with its
    polynomial. Two known samples make a line, one a constant; without any, or without a time, the result is null. Of
    samples of one time the first is the knot. Nulls of other columns stay; an empty table gives an empty result.
    """
    if ends not in ("not-a-knot", "natural"):
        raise ValueError(f"unknown ends {ends}")

    def run(v: dict[str, np.ndarray], _sizes: np.ndarray) -> dict[str, np.ndarray]:
        return {"_spline": spline_through(v["_t"], v["_x"], ends)}

    made = side_by_side(segments, {"_t": F.col("pos") if seconds is None else seconds, "_x": F.col(x)}, run, ["_spline"])
    own = segments.join(made, ["src", "seg_id", "pos"], "left")
    return own.select(*segments.columns, F.coalesce(F.col(x), F.col("_spline")).alias("filled"))


# Recursive filters


def butterworth_highpass(cut: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a second-order Butterworth high-pass, by the bilinear transform."""
    w = math.tan(math.pi * cut / rate)
    k = 1 + math.sqrt(2) * w + w * w
    return np.array([1.0, -2.0, 1.0]) / k, np.array([1.0, 2 * (w * w - 1) / k, (1 - math.sqrt(2) * w + w * w) / k])


def state_space(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition and input of the transposed form: state' = transition @ state + into * x, y = state[0] + b[0] * x."""
    k = len(a) - 1
    step = np.zeros((k, k))
    step[:, 0] = -a[1:]
    step[np.arange(k - 1), np.arange(1, k)] = 1.0
    return step, b[1:] - a[1:] * b[0]


def _powers(step: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n + 1, *step.shape))
    out[0] = np.eye(len(step))
    for i in range(n):
        out[i + 1] = step @ out[i]
    return out


class FromZero:
    """What comes out of a recursion, and the state at the end, from a state of zeros. Blocks of samples go through matrices; states pass from block to block."""

    def __init__(self, direct: float, step: np.ndarray, into: np.ndarray, block: int = 64):
        self.direct, self.step, self.into, self.block = direct, step, into, block
        powers = _powers(step, block)
        reply = np.concatenate([[direct], powers[:-1, 0, :] @ into])[:block]  # to a single 1
        lag = np.subtract.outer(np.arange(block), np.arange(block))
        self.inside = np.where(lag >= 0, reply[np.maximum(lag, 0)], 0.0)
        self.kept = powers[np.arange(block - 1, -1, -1)] @ into  # what a sample leaves in the state at the block's end
        self.shown, self.over = powers[:block, 0, :], powers[block]

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = len(v) // self.block
        x = v[: whole * self.block].reshape(whole, self.block)
        y, left, s = x @ self.inside.T, x @ self.kept, np.zeros(len(self.into))
        for i in range(whole):
            y[i] += self.shown @ s
            s = self.over @ s + left[i]
        rest = np.empty(len(v) - whole * self.block)
        for i, u in enumerate(v[whole * self.block :]):
            rest[i] = s[0] + self.direct * u
            s = self.step @ s + self.into * u
        return np.concatenate([y.ravel(), rest]), s


def filtered_from_zero(v: np.ndarray, direct: float, step: np.ndarray, into: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    return FromZero(direct, step, into, block)(v)


def recursive_filter(samples: DataFrame, x: str, b: Sequence[float], a: Sequence[float], by: Sequence[str], order: str, part: int = 4096, reverse: bool = False, first: str | None = None) -> DataFrame:
    """``samples`` with filtered: the recursion a[0] y[i] = sum b[j] x[i-j] - sum a[j] y[i-j] along each group, from a state of zeros.

    ``order`` numbers the rows of a group from 0 without a gap. A group is cut into parts of ``part`` rows. A part's
    rows turn the state that enters it into the one that leaves it by an affine map, which all parts make side by side
    from a state of zeros; the maps of a group, a row each, are composed in order, and what each part's entering state
    adds to its rows is the transition's powers times it. So a group may span any number of tasks, and results don't
    depend on ``part``. Null samples count as 0 and give null. With ``reverse`` rows are taken from the last one back.
    With ``first`` (a column) the state begins as if the input had always been that column's value of the first row.
    """
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    step, into = state_space(b, a)
    k, powers = len(a) - 1, _powers(step, part)
    rest = np.linalg.solve(np.eye(k) - step, into)  # the state of a constant input of 1
    begin = F.col(first) if first else F.lit(0.0)
    at, rows = F.col(order), samples
    if reverse:
        rows = samples.join(samples.groupBy(*by).agg(F.max(order).alias("_last")), list(by))
        at = F.col("_last") - at
    own = rows.select(*by, F.col(order).alias("_order"), at.cast("long").alias("_at"), F.col(x).cast("double").alias("_x"), begin.cast("double").alias("_first"))
    own = own.withColumn("_part", F.floor(F.col("_at") / part).cast("long"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select(*by).schema.fields)
    states = [f"_s{i}" for i in range(k)]

    from_zero = FromZero(b[0], step, into)

    def zero_state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, [*by, "_part"]):
            x = rows["_x"].to_numpy(float)
            v, ends = np.nan_to_num(x), np.append(starts[1:], len(rows))
            y, left = np.empty(len(v)), np.empty((len(starts), k))
            for i, (lo, hi) in enumerate(zip(starts, ends, strict=True)):
                y[lo:hi], left[i] = from_zero(v[lo:hi])
            y[np.isnan(x)] = np.nan
            sizes = ends - starts
            out = rows[[*by, "_order", "_at", "_part", "_first"]].assign(_y=y, _n=np.repeat(sizes, sizes))
            yield out.assign(**dict(zip(states, np.repeat(left, sizes, axis=0).T, strict=True)))

    schema = f"{kinds}, _order {own.schema['_order'].dataType.simpleString()}, _at long, _part long, _first double, _y double, _n long, " + ", ".join(f"{c} double" for c in states)
    made = written(own.repartition(*by, "_part").sortWithinPartitions(*by, "_part", "_at").mapInPandas(zero_state, schema))
    ends = made.groupBy(*by, "_part").agg(F.max("_n").alias("_n"), F.max_by("_first", -F.col("_at")).alias("_first"), *(F.max(c).alias(c) for c in states))

    def entering(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, by):
            first, left, sizes = rows["_first"].to_numpy(float), rows[states].to_numpy(float), rows["_n"].to_numpy()
            out = np.empty((len(rows), k))
            for lo, hi in zip(starts, np.append(starts[1:], len(rows)), strict=True):
                s = rest * (0.0 if np.isnan(first[lo]) else first[lo])
                for i in range(lo, hi):
                    out[i] = s
                    s = powers[sizes[i]] @ s + left[i]
            yield rows[[*by, "_part"]].assign(**{f"_e{i}": out[:, i] for i in range(k)})

    ordered = ends.repartition(*by).sortWithinPartitions(*by, "_part")  # a row a part
    enter = ordered.mapInPandas(entering, f"{kinds}, _part long, " + ", ".join(f"_e{i} double" for i in range(k)))
    both = made.join(enter, [*by, "_part"])
    first_rows = powers[:part, 0, :]  # what a state adds to the rows after it

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            more = np.einsum("ni,ni->n", first_rows[rows["_at"].to_numpy() % part], rows[[f"_e{i}" for i in range(k)]].to_numpy(float))
            yield rows[[*by, "_order"]].assign(filtered=rows["_y"] + more)

    done = both.select(*by, "_order", "_at", "_y", *(f"_e{i}" for i in range(k))).mapInPandas(add, f"{kinds}, _order {own.schema['_order'].dataType.simpleString()}, filtered double")
    done = done.withColumnRenamed("_order", order).withColumn("filtered", F.when(~F.isnan("filtered"), F.col("filtered")))
    return samples.join(done, [*by, order], "left")


def zero_phase_filter(segments: DataFrame, x: str, b: Sequence[float], a: Sequence[float], part: int = 4096) -> DataFrame:
    """``segments`` with filtered: the recursion forth and back along each segment, which leaves no shift of phase.

    Each end is continued by 3 * len(a) samples that mirror the segment about its end sample, and each direction begins
    as if its first value had always been there. Null samples count as 0 and give null; a segment that isn't longer
    than its continuation has null results.
    """
    pad = 3 * max(len(a), len(b))
    keys = ("src", "seg_id")
    sizes = segments.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > pad)
    own = segments.select(*keys, "pos", F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x")).join(sizes, list(keys))
    tips = own.groupBy(*keys).agg(F.max_by("x", -F.col("pos")).alias("_head"), F.max_by("x", "pos").alias("_tail"))
    near = own.join(tips, list(keys))
    head = near.filter((F.col("pos") >= 1) & (F.col("pos") <= pad)).select(*keys, (F.lit(pad) - F.col("pos")).alias("at"), (2 * F.col("_head") - F.col("x")).alias("x"))
    tail = near.filter((F.col("pos") >= F.col("n") - 1 - pad) & (F.col("pos") < F.col("n") - 1)).select(*keys, (F.lit(pad) + 2 * (F.col("n") - 1) - F.col("pos")).alias("at"), (2 * F.col("_tail") - F.col("x")).alias("x"))
    longer = own.select(*keys, (F.col("pos") + pad).alias("at"), "x").unionByName(head).unionByName(tail)
    forth = recursive_filter(longer, "x", b, a, keys, "at", part, first="x").select(*keys, "at", F.col("filtered").alias("x"))
    back = recursive_filter(forth, "x", b, a, keys, "at", part, reverse=True, first="x")
    done = back.select(*keys, (F.col("at") - pad).alias("pos"), "filtered").filter("pos >= 0")
    out = segments.join(done, [*keys, "pos"], "left")
    return out.select(*segments.columns, F.when(F.col(x).isNotNull(), F.col("filtered")).alias("filtered"))
