"""Tables that detection is reported by: windows and delays, pooled counts, states, resampled intervals, exports and checks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions import ratio
from gapwise.operators.evaluate import SEGMENT, auc, operating_point, rates, segment_alarms, segment_statistic, with_threshold
from gapwise.operators.order import quantiles, ranked_counts


def window_length_auc(windows: DataFrame, score: str) -> DataFrame:
    """Per window length (win): qualifying segments of each class, windows, and AUC of a score and its symmetric value."""
    areas = auc(windows.withColumn("score", F.col(score)), ["win"])
    counts = windows.groupBy("win", *SEGMENT).agg(F.max("label").alias("label"), F.count("*").alias("k")).groupBy("win")
    own = counts.agg(F.count_if(F.col("label") == 0).alias("n_normal"), F.count_if(F.col("label") == 1).alias("n_abnormal"), F.sum("k").alias("n_windows"))
    return own.join(areas.select("win", "auc"), "win").select("win", "n_normal", "n_abnormal", "n_windows", "auc", F.greatest("auc", 1 - F.col("auc")).alias("symmetric"))


def leak_free_rates(scores: DataFrame, fractions: Sequence[float], q: float) -> DataFrame:
    """Per fraction: the q quantile of the earliest normal segments of each stream as threshold, and false positive rates of the later ones."""
    keys = scores.filter("label = 0").select(*SEGMENT).distinct()
    w = Window.partitionBy("src")
    place = ((F.row_number().over(w.orderBy("seg_id")) - 1) / F.count("*").over(w)).alias("place")
    own = scores.filter("label = 0").join(keys.select(*SEGMENT, place), list(SEGMENT))
    own = own.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    thr = quantiles(own.filter("place < fraction"), "score", [q], ["fraction"], ["thr"])
    late = with_threshold(own.filter("place >= fraction"), thr, ["fraction"])
    hit = F.coalesce(F.col("score") > F.col("thr"), F.lit(False))
    seg = late.groupBy("fraction", *SEGMENT).agg(F.max("thr").alias("thr"), F.bool_or(hit).alias("any"), F.count("*").alias("n"), F.count_if(hit).alias("k"))
    return seg.groupBy("fraction").agg(
        F.max("thr").alias("thr"), (F.sum("k") / F.sum("n")).alias("fpr_sample"), F.avg(F.col("any").cast("double")).alias("fpr_segment"), F.count("*").alias("n_segments")
    )


def delay_table(segments: DataFrame, alarms: DataFrame, win: int) -> DataFrame:
    """One row per abnormal segment: n, delay, and why there is none: too-short for a window, or no-alarm."""
    own = segments.filter("label = 1").join(alarms.select(*SEGMENT, "alarm", "delay"), list(SEGMENT), "left")
    reason = F.when(F.col("n") < win, "too-short").when(F.coalesce("alarm", F.lit(False)), "detected").otherwise("no-alarm")
    return own.select(*SEGMENT, "n", "delay", reason.alias("reason"))


def pooled(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of a confusion summed over folds, and the rates of the sums."""
    return rates(counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))))


def with_undetermined(confusion: DataFrame, n_missing: Column) -> DataFrame:
    """The confusion in which abnormal segments without a window count as missed (fn_all), and its recall and F1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn") + n_missing
    return confusion.withColumns({"fn_all": fn, "recall_all": ratio(tp, tp + fn), "f1_all": ratio(2 * tp, 2 * tp + fp + fn)})


def state_rates(scores: DataFrame) -> DataFrame:
    """Per state: false positive rates of rows and segments, from scores with thr."""
    hit = F.coalesce(F.col("score") > F.col("thr"), F.lit(False))
    seg = scores.filter("label = 0").groupBy("state", *SEGMENT).agg(F.bool_or(hit).alias("any"), F.count("*").alias("n"), F.count_if(hit).alias("k"))
    return seg.groupBy("state").agg((F.sum("k") / F.sum("n")).alias("fpr_sample"), F.avg(F.col("any").cast("double")).alias("fpr_segment"), F.count("*").alias("n_segments"))


def state_operating_points(scores: DataFrame, targets: Sequence[float], states: Sequence[int]) -> DataFrame:
    """The operating point of each state taken alone."""
    out = None
    for s in states:
        own = operating_point(scores.filter(F.col("state") == s), targets).select(F.lit(s).alias("state"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def state_accuracy(table: DataFrame, value: str, limit: float) -> DataFrame:
    """Per state how often value > limit says state 0 and otherwise state 1."""
    guess = F.when(F.col(value) > limit, 0).otherwise(1)
    return table.groupBy("state").agg(F.count("*").alias("n"), F.avg((guess == F.col("state")).cast("double")).alias("accuracy"))


def rule_metrics(scores: DataFrame, rules: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Per rule (name -> rule, k, n of segment_alarms): counts and rates of segments, and the mean delay of those found."""
    from gapwise.operators.evaluate import confusion

    out = None
    for name, (rule, k, n) in rules.items():
        alarms = segment_alarms(scores, rule, k, n)
        own = confusion(alarms).crossJoin(alarms.filter("label = 1").agg(F.avg("delay").alias("mean_delay"))).withColumn("rule", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def aggregated_scores(scores: DataFrame, q: float) -> DataFrame:
    """Per way of one score a segment (max, mean, the largest second of three): the q quantile of normal segments, and segments above it by label."""
    own = scores.groupBy(*SEGMENT).agg(F.max("label").alias("label"), F.max("score").alias("max"), F.avg("score").alias("mean"))
    own = own.join(segment_statistic(scores, 2, 3).select(*SEGMENT, F.col("stat").alias("kofn")), list(SEGMENT))
    long = own.unpivot([*SEGMENT, "label"], ["max", "mean", "kofn"], "way", "score")
    thr = quantiles(long.filter("label = 0"), "score", [q], ["way"], ["thr"])
    hit = F.col("score") > F.col("thr")
    own = long.join(F.broadcast(thr), "way").groupBy("way")
    return own.agg(F.max("thr").alias("thr"), F.count_if((F.col("label") == 1) & hit).alias("tp"), F.count_if((F.col("label") == 0) & hit).alias("fp"))


def equal_error_threshold(scores: DataFrame) -> DataFrame:
    """thr, precision, recall where they are equal or nearest to it; of ties the highest threshold."""
    own = ranked_counts(scores, "score", descending=True, more={"pos": F.sum(F.col("label").cast("long"))})
    tp = F.col("before_pos") + F.col("pos")
    points = own.select(F.col("score").alias("thr"), ratio(tp, F.col("before") + F.col("n")).alias("precision"), ratio(tp, F.col("total_pos")).alias("recall"))
    best = F.max_by(F.struct("thr", "precision", "recall"), F.struct(-F.round(F.abs(F.col("precision") - F.col("recall")), 9), "thr"))
    return points.filter("recall is not null").agg(best.alias("z")).select("z.*")


#: A uniform number is above so many of these bounds as a Poisson(1) number is large.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def _uniform(rep: Column | str, seed: int) -> Column:
    """53 bits of a hash of segment and rep."""
    return F.xxhash64(*SEGMENT, rep, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))


def poisson_draws(keys: DataFrame, reps: int, seed: int) -> DataFrame:
    """The rows of ``keys`` (src, seg_id and more) once for each rep with times, a Poisson(1) number from a hash of key and rep."""
    own = keys.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    u = _uniform("rep", seed) / float(1 << 53)
    return own.withColumn("times", sum((F.when(u > c, 1).otherwise(0) for c in POISSON), F.lit(0))).filter("times > 0")


class _Areas:
    """Of the rows of a part that have one column's scores, in their order: what each rep counts at the first and at the last score, and what it has strictly between."""

    def __init__(self, reps: int):
        self.edges, self.low = [], None
        self.open = None
        self.u, self.p, self.m = np.zeros(reps), np.zeros(reps, np.int64), np.zeros(reps, np.int64)

    def add(self, s: np.ndarray, label: np.ndarray, times: np.ndarray) -> None:
        """Rows in order of their score; times by rows and reps."""
        same = (s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1]))
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        p, m = (np.add.reduceat(times * y[:, None], starts) for y in (label, 1 - label))
        s = s[starts]
        if self.open:
            x, before_p, before_m = self.open
            if x == s[0] or (np.isnan(x) and np.isnan(s[0])):
                p[0] += before_p
                m[0] += before_m
            else:
                s, p, m = np.append(x, s), np.vstack([before_p, p]), np.vstack([before_m, m])
        self.open = (float(s[-1]), p[-1], m[-1])  # the last score may go on
        s, p, m = s[:-1], p[:-1], m[:-1]
        if len(s) and not self.edges:
            self.edges.append((float(s[0]), p[0], m[0]))
            s, p, m = s[1:], p[1:], m[1:]
        if len(s):
            self.low = float(s[0]) if self.low is None else self.low
            self.u += (p * (self.m + np.cumsum(m, axis=0) - m / 2)).sum(axis=0)
            self.p += p.sum(axis=0)
            self.m += m.sum(axis=0)

    def rows(self, column: str) -> pa.RecordBatch:
        own = [(s, p, m, np.zeros(len(p)), True) for s, p, m in [*self.edges, self.open]] + ([(self.low, self.p, self.m, self.u, False)] if self.low is not None else [])
        n, reps = len(own), len(self.p)
        parts = [np.concatenate([x[i] for x in own]) for i in (1, 2, 3)]
        flat = [pa.array([column] * (n * reps)), pa.array(np.tile(np.arange(reps, dtype=np.int32), n)), *(pa.array(np.repeat([x[0] for x in own], reps)),), *map(pa.array, parts), pa.array(np.repeat([x[4] for x in own], reps))]
        return pa.RecordBatch.from_arrays(flat, ["column", "rep", "s", "p", "m", "u", "edge"])


def resampled_auc(scores: DataFrame, columns: Sequence[str], reps: int, seed: int) -> DataFrame:
    """rep and the AUC of each of ``columns`` over a resample of segments with all their rows; null if there is one class only.

    Rows aren't repeated by rep: they are dealt by ranges of score, a part counts all reps side by side, and what it
    had at its first and last score and between them is put together, three rows a part, column and rep.
    """
    own = scores.filter(" and ".join(f"{c} is not null" for c in (*SEGMENT, "label"))).select(*SEGMENT, F.col("label").cast("long").alias("label"), *(F.col(c).cast("double").alias(c) for c in columns))
    own = own.unpivot([*SEGMENT, "label"], list(columns), "column", "s").filter("s is not null")
    order = ["column", "s", *SEGMENT]  # rows of one score may be many
    drawn = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda i: _uniform(i, seed))
    own = own.repartitionByRange(*order).sortWithinPartitions(*order).select("column", "s", "label", drawn.alias("drawn"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, areas = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names, s, label = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            u = batch.column(3).flatten().to_numpy().reshape(n, reps) / float(1 << 53)
            times = np.zeros((n, reps), np.int64)
            for c in POISSON:
                times += u > c
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), n]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if names[lo] != column:
                    if areas:
                        yield areas.rows(column)
                    column, areas = str(names[lo]), _Areas(reps)
                areas.add(s[lo:hi], label[lo:hi], times[lo:hi])
        if areas:
            yield areas.rows(column)

    parts = own.mapInArrow(count, "column string, rep int, s double, p long, m long, u double, edge boolean")
    parts = parts.groupBy("column", "rep", "s").agg(*(F.sum(c).alias(c) for c in "pmu"), F.bool_or("edge").alias("edge"))
    below = Window.partitionBy("column", "rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    less, p, m = F.coalesce(F.sum("m").over(below), F.lit(0)), F.col("p"), F.col("m")
    parts = parts.withColumn("u", F.col("u") + p * (less + F.when(F.col("edge"), m / 2).otherwise(0.0)))
    made = parts.groupBy("column", "rep").agg(ratio(F.sum("u"), F.sum("p") * F.sum("m")).alias("auc"))
    return made.groupBy("rep").agg(*(F.max(F.when(F.col("column") == c, F.col("auc"))).alias(c) for c in columns))


def interval(draws: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """One row: mean, lo, hi of a statistic over its resamples, and p, two-sided, of its being 0."""
    side = (1 - level) / 2
    below, above = F.avg((F.col(value) <= 0).cast("double")), F.avg((F.col(value) >= 0).cast("double"))
    return draws.filter(F.col(value).isNotNull()).agg(F.avg(value).alias("mean"), F.percentile(value, side).alias("lo"), F.percentile(value, 1 - side).alias("hi"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"))


def bootstrap_auc(scores: DataFrame, reps: int, seed: int, a: str = "score", b: str | None = None) -> DataFrame:
    """Resamples segments with all their rows: interval of the AUC of score a, or of its difference to that of b."""
    made = resampled_auc(scores, [a, b] if b else [a], reps, seed)
    return interval(made.select((F.col(a) - F.col(b) if b else F.col(a)).alias("auc")), "auc")


def bootstrap_rate_difference(alarms: DataFrame, reps: int, seed: int, a: str, b: str) -> DataFrame:
    """Interval of the difference of two rules' false alarm rates over the same resampled normal segments."""
    drawn = poisson_draws(alarms.filter("label = 0").select(*SEGMENT, a, b), reps, seed)
    k = F.col("times")
    made = drawn.groupBy("rep").agg(ratio(F.sum(k * (F.col(a).cast("int") - F.col(b).cast("int"))), F.sum(k)).alias("difference"))
    return interval(made, "difference")


def predictions(windows: DataFrame, segments: DataFrame, win: int) -> DataFrame:
    """One row per segment: windows, whether it is judgable, caution and alarm of any window (z1 or z2 above 1; both), first times, and a note where it isn't judgable."""
    caution, alarm = (F.col("z1") > 1) | (F.col("z2") > 1), (F.col("z1") > 1) & (F.col("z2") > 1)
    own = windows.groupBy(*SEGMENT).agg(
        F.count("*").alias("n_windows"), F.bool_or(caution).alias("caution"), F.bool_or(alarm).alias("alarm"), F.min(F.when(caution, F.col("t"))).alias("first_caution"), F.min(F.when(alarm, F.col("t"))).alias("first_alarm")
    )
    made = segments.select(*SEGMENT, "n").join(own, list(SEGMENT), "left")
    ok = F.col("n_windows").isNotNull()
    return made.select(
        *SEGMENT, "n", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), ok.alias("judgable"), F.col("caution").cast("int").alias("caution"), F.col("alarm").cast("int").alias("alarm"),
        "first_caution", "first_alarm", F.when(~ok, F.lit(f"shorter than {win} samples")).alias("note"),
    )


def contract_checks(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, n_bad, ok of each condition that all rows must meet (null doesn't)."""
    made = table.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    return made.unpivot([], list(checks), "check", "n_bad").withColumn("ok", F.col("n_bad") == 0)


def margins(scores: DataFrame, by: Sequence[str], qs: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Per group the quantiles of score over threshold."""
    own = scores.withColumn("margin", ratio(F.col("score"), F.col("thr")))
    return quantiles(own, "margin", qs, by, [f"p{round(100 * q)}" for q in qs]).join(own.groupBy(*by).agg(F.count("margin").alias("n")), list(by))
