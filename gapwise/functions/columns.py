"""Column expressions. Undefined results are NULL, never NaN, as NaN compares as the largest value."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b)


def rms(x: Column | str, over: WindowSpec | None = None) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    mean = F.avg(x * x)
    return F.sqrt(mean.over(over) if over is not None else mean)


def shape_stats(x: Column, over: WindowSpec | None = None) -> tuple[Column, Column]:
    """Population excess kurtosis and skewness, null without spread."""
    put = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    spread = put(F.max(x)) > put(F.min(x))
    return F.when(spread, put(F.kurtosis(x))), F.when(spread, put(F.skewness(x)))


def guarded_corr(a: Column, b: Column, least: int = 4, over: WindowSpec | None = None) -> Column:
    """Pearson correlation; null below ``least`` rows or if either has no spread (corr() raises on it in ANSI mode)."""
    put = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    ok = (put(F.count(F.when(a.isNotNull() & b.isNotNull(), 1))) >= least) & (put(F.max(a)) > put(F.min(a))) & (put(F.max(b)) > put(F.min(b)))
    top = put(F.avg(a * b)) - put(F.avg(a)) * put(F.avg(b))
    bottom = put(F.stddev_pop(a)) * put(F.stddev_pop(b))
    return F.when(ok & (bottom != 0), top / bottom)


def autocorrelation(x: str, mean: Column, lag: Column) -> Column:
    """Biased autocorrelation from a lagged copy: an aggregate; null without spread."""
    top = F.sum((F.col(x) - mean) * (lag - mean))
    return ratio(top, F.sum((F.col(x) - mean) * (F.col(x) - mean)))


def mad(x: Column, center: Column) -> Column:
    """Median absolute deviation from a center that another pass has found: an aggregate."""
    return F.median(F.abs(x - center))


def robust_scale(x: Column) -> Column:
    """Interquartile range over 1.349: an aggregate."""
    return (F.percentile(x, 0.75) - F.percentile(x, 0.25)) / 1.349


def average_rank(rank: Column, ties: Column) -> Column:
    """Rank with ties shared, from the lowest rank of a tie and its size."""
    return rank + (ties - 1) / 2


def micros(ts: Column | str) -> Column:
    """Microseconds of a time; one without a zone counts in the session's, of which only differences should be used."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
