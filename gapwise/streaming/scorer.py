"""Scores of samples as they come, with state by stream.

The batch twin is a query over lags: ridge_scores() on gap segments gives the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gapwise.operators.models import lag_pairs

OUTPUT = "src long, event_id long, pos long, score double"
#: The state store that stateful processors need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def ridge_scores(segments: DataFrame, channels: list[str], p: int, fits: dict[str, tuple], sd: list[float]) -> DataFrame:
    """Batch scores of samples from fitted autoregressions; null for a segment's first p samples."""
    inputs = [f"{c}_l{i}" for i in range(1, p + 1) for c in channels]
    score = F.lit(0.0)
    for c, s in zip(channels, sd, strict=True):
        coef, intercept = fits[c]
        predicted = sum((F.col(x) * float(w) for x, w in zip(inputs, coef, strict=True)), F.lit(float(intercept)))
        score = score + F.pow((F.col(c) - predicted) / float(s), 2) / len(channels)
    made = lag_pairs(segments, channels, p).select("src", "event_id", "pos", score.alias("score"))
    return made.unionByName(segments.filter(F.col("pos") < p).select("src", "event_id", "pos", F.lit(None).cast("double").alias("score")))


class Scorer(StatefulProcessor):
    """Keeps, by stream, the time of the last sample, its place in the segment, and the last p samples."""

    def __init__(self, channels: list[str], p: int, fits: dict[str, tuple], sd: list[float], gap: float):
        self.channels, self.p, self.gap = channels, p, gap
        self.coef = np.array([fits[c][0] for c in channels], float)
        self.intercept = np.array([fits[c][1] for c in channels], float)
        self.sd = np.array(sd, float)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long, pos long, history array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["us", "event_id"])
        us, pos, history = self.last.get() if self.last.exists() else (None, -1, [])
        history, out = [float(x) for x in history], []
        k = len(self.channels)
        for row in frame.itertuples(index=False):
            if us is not None and row.us < us:
                continue  # late: its segment has gone on
            if us is None or (row.us - us) / 1e6 > self.gap:
                pos, history = -1, []
            us, pos = row.us, pos + 1
            x = np.array([getattr(row, c) for c in self.channels], float)
            score = None
            if len(history) == self.p * k:
                score = float((((x - self.intercept - self.coef @ np.array(history)) / self.sd) ** 2).mean())
            history = [*x.tolist(), *history][: self.p * k]
            out.append((key[0], row.event_id, pos, score))
        self.last.update((us, pos, history))
        yield pd.DataFrame(out, columns=["src", "event_id", "pos", "score"]).astype({"score": "float64"})

    def close(self) -> None:
        pass


def stream_scores(samples: DataFrame, channels: list[str], p: int, fits: dict[str, tuple], sd: list[float], gap: float) -> DataFrame:
    """Scores of a streaming frame of samples (src, event_id, ts, channels).

    A silence of more than ``gap`` seconds clears a stream's history. Rows of a batch are sorted by time; a row older
    than the last of an earlier batch is left out.
    """
    own = samples.select("src", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *(F.col(c).cast("double").alias(c) for c in channels))
    made = own.groupBy("src").transformWithStateInPandas(Scorer(channels, p, fits, sd, gap), OUTPUT, "Append", "None")
    return made.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def burst_summaries(samples: DataFrame, gap: str, delay: str, channel: str) -> DataFrame:
    """Closed bursts of a streaming frame: count, mean and largest magnitude by session of the gap."""
    own = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    made = own.groupBy("src", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.avg(channel).alias("mean"), F.max(F.abs(channel)).alias("peak"))
    return made.select("src", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "peak")
