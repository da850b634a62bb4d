"""Models of whole windows: principal components of the samples of a window, of all channels together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.operators.segments import in_segment
from gapwise.operators.stats import gram


class WindowPca(NamedTuple):
    """Of windows as vectors (samples by channels, channel by channel): scale, mean and components of the scaled ones, deviation of what is left by channel, explained shares."""

    channels: list[str]
    win: int
    scale: np.ndarray
    mean: np.ndarray
    components: np.ndarray
    sigma: np.ndarray
    explained: np.ndarray


def stacked(segments: DataFrame, channels: Sequence[str], win: int, step: int) -> tuple[DataFrame, list[str]]:
    """A row per window with the samples of all channels as columns, in the plan only, and the names of these."""
    w = in_segment()
    columns = {f"_{c}_{i}": F.lead(F.col(c).cast("double"), i).over(w) for c in channels for i in range(win)}
    own = segments.withColumns(columns).filter((F.col("pos") % step == 0) & (F.col("pos") + win <= F.col("n")))
    return own, list(columns)


def fit_windows(segments: DataFrame, channels: Sequence[str], win: int, step: int, d: int, train: Column) -> WindowPca:
    """PCA of the training windows (those whose first sample has ``train``), by the covariance of their shifted samples, from one pass of sums.

    Channels are scaled by their population deviation over all samples of the windows, each as often as a window holds
    it. What is left of the training windows by channel follows from the same covariance. Windows with a null sample
    are left out; with fewer than two windows the fit is all nan.
    """
    own, names = stacked(segments, channels, win, step)
    n, mean, cov = gram(own.filter(train), names)
    cov = cov * (n - 1) / n if n > 1 else np.full((len(names), len(names)), np.nan)
    c = len(channels)
    mean_by, var_by = mean.reshape(c, win), np.diag(cov).reshape(c, win)
    sd = np.sqrt((var_by + (mean_by - mean_by.mean(axis=1, keepdims=True)) ** 2).mean(axis=1)) + 1e-9
    scale = np.repeat(sd, win)
    scaled = cov / np.outer(scale, scale)
    if not np.isfinite(scaled).all():
        return WindowPca(list(channels), win, scale, mean, np.full((len(names), d), np.nan), np.full(c, np.nan), np.full(len(names), np.nan))
    values, vectors = np.linalg.eigh(scaled)
    order = np.argsort(-values)
    vectors = vectors[:, order[:d]]
    rest = np.eye(len(names)) - vectors @ vectors.T
    left = np.diag(rest @ scaled @ rest).clip(min=0).reshape(c, win)
    return WindowPca(list(channels), win, scale, mean, vectors, np.sqrt(left.mean(axis=1)) + 1e-6, values[order] / values.sum())


def window_errors(segments: DataFrame, fit: WindowPca, step: int) -> DataFrame:
    """src, seg_id, pos, e_<channel>, score of each window: what the components leave, squared, in units of the training windows' deviation; score is the mean over channels. Null for windows with a null sample."""
    own, names = stacked(segments, fit.channels, fit.win, step)
    outputs = [f"e_{c}" for c in fit.channels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = (rows[names].to_numpy(float) - fit.mean) / fit.scale
            left = x - (x @ fit.components) @ fit.components.T
            e = ((left.reshape(len(x), len(fit.channels), fit.win) / fit.sigma[:, None]) ** 2).mean(axis=2)
            yield rows[["src", "seg_id", "pos"]].assign(**dict(zip(outputs, e.T, strict=True)), score=e.mean(axis=1))

    made = own.select("src", "seg_id", "pos", *names).mapInPandas(run, "src long, seg_id long, pos long, " + ", ".join(f"{c} double" for c in [*outputs, "score"]))
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in [*outputs, "score"]})
