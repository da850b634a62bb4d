"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should have. The whole part is
given; the fractional part is rounded dependently: two fractional documents exchange mass, so that their expected
copies stay and the words taken stay, until one of them is whole. Blocks of documents of a source do so in parallel
and each leaves one residual document at most; residuals meet in a tree until one per source is left, which is
rounded to the nearer side. What that rounding leaves open, half a document's words at most, is closed by flipping
one copy of smaller documents, a few of each size, so that a source of few and uneven documents comes near its target.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import checkpoint, n_words, packed, row_key, unpacked, without

STATE = "source string, block long, id string, size long, key long, whole int, p double"


def targets(sizes: Sequence[float], weights: Sequence[float], most: float) -> np.ndarray:
    """Shares of the sum of sizes by weight; targets stop at ``most`` times their size, and the excess is shared again by weight."""
    sizes, weights = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    out, left, rest = np.zeros(len(sizes)), sizes > 0, float(sizes.sum())
    while left.any():
        share = rest * weights / weights[left].sum()
        over = left & (share > most * sizes)
        if not over.any():
            out[left] = share[left]
            break
        out[over] = most * sizes[over]
        rest -= float(out[over].sum())
        left &= ~over
    return out


def _uniform(seed: int, *parts) -> float:
    return xxhash.xxh3_64_intdigest("|".join(map(str, parts)).encode(), seed) / 2.0**64


def pivot(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded copy probabilities, and which document is left fractional (-1: none). Keeps each expectation and the sum of size * p."""
    p, held = p.copy(), -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up = min((1 - p[held]) * a, p[i] * b)  # words that held may gain
        down = min(p[held] * a, (1 - p[i]) * b)  # words that held may lose
        gain = up if draws[i] * (up + down) < down else -down
        whole_held = (gain == (1 - p[held]) * a) if gain > 0 else (-gain == p[held] * a)
        whole_i = (gain == p[i] * b) if gain > 0 else (-gain == (1 - p[i]) * b)
        p[held] = float(gain > 0) if whole_held else p[held] + gain / a
        p[i] = float(gain < 0) if whole_i else p[i] - gain / b
        if whole_held or not 0.0 < p[held] < 1.0:
            p[held] = round(p[held]) if not whole_held else p[held]
            held = i if 0.0 < p[i] < 1.0 else -1
        elif not whole_i and not 0.0 < p[i] < 1.0:
            p[i] = round(p[i])
    return p, held


def _round_block(seed: int, level: int):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        # the largest first, so that it meets enough smaller ones to become whole and a small one is left
        rows = rows.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        key = _uniform(seed, level, rows["source"].iloc[0], rows["block"].iloc[0])
        draws = np.random.default_rng(int(key * 2**53)).random(len(rows))
        p, _ = pivot(rows["size"].to_numpy(np.float64), rows["p"].to_numpy(np.float64), draws)
        return rows.assign(p=p)

    return one


def flips(error: float, size: np.ndarray, copies: np.ndarray, most: int) -> np.ndarray:
    """Changes of copies, by one at most, that bring the words still wanted (negative: to be given up) near 0: the largest document that fits first."""
    out = np.zeros(len(size), np.int64)
    for i in np.argsort(-size, kind="stable"):
        step = 1 if error > 0 else -1
        if size[i] > 0 and 0 <= copies[i] + step <= most and abs(error - step * size[i]) < abs(error):
            out[i] = step
            error -= step * size[i]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """source (a null one apart from every text), id (as text), size, key of every row. Read once, as it takes all texts."""
    own = docs.select(_source_key().alias("source"), F.col("doc_id").cast("string").alias("id"), n_words(F.col("text")).alias("size"), row_key(docs).alias("key"))
    return checkpoint(own)


def plan(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> list[tuple[str, int, int, float]]:
    """(source, rows, size, target) of each source by code point, null last. Sources are what a mix is configured by, so they fit the driver."""
    got = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    got = sorted(((r["source"], r["n"], r["size"]) for r in got), key=lambda x: (x[0] == "0", x[0]))
    goal = targets([x[2] for x in got], [weights[i % len(weights)] for i in range(len(got))], most)
    return [(*x, float(t)) for x, t in zip(got, goal, strict=True)]


def _source_key() -> Column:
    """Marks null apart from every text."""
    return F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))


def closing(out: DataFrame, table: DataFrame, most: float, each: int) -> DataFrame:
    """key, flip: the rows that change by a copy, from rows (source, key, size, copies).

    Of each source, each power of two of size and each direction ``each`` rows may be flipped, those of lowest hash:
    a few hundred rows of a source, which are chosen before they are sent. Rows that are the same in all columns
    aren't flipped, as one couldn't be told from the other.
    """
    octave = F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    # where copies are as many as they may be nothing can be added
    free = out.filter("size > 0").withColumn("octave", octave).withColumn("full", F.col("copies") + 1 > most).withColumn("none", F.col("copies") == 0)
    order = Window.partitionBy("source", "octave", "full", "none").orderBy(F.xxhash64("key"), "key")
    few = checkpoint(free.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= each).select("source", "key", "size", "copies"))
    single = out.join(F.broadcast(few.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")).filter("n = 1").select("key")
    error = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(F.broadcast(table), "source").select("source", (F.col("target") - F.col("taken")).alias("error"))
    few = few.join(single, "key").join(F.broadcast(error), "source")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key"], kind="stable").reset_index(drop=True)
        return rows.assign(flip=flips(float(rows["error"].iloc[0]), rows["size"].to_numpy(), rows["copies"].to_numpy(), int(most)))[["key", "flip"]]

    return few.groupBy("source").applyInPandas(one, "key long, flip int").filter("flip != 0")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 20, block: int = 4096, fan_in: int = 16, each: int = 16) -> DataFrame:
    """One row per document: doc_id, key, source, size, source_size, target, copies, taken.

    key names a row by all its columns. Null and empty texts have size 0 and no copies; a null source is a source
    of its own; repeated rows are documents of their own that may get different copies, which of them is arbitrary
    as they are the same; texts of any length count whole; ids are of any type; an empty table gives an empty result;
    further columns count for key only. Reruns agree, as draws come from seed and content. No document gets over
    ceil(target / source size) copies, nor, where one copy of it is flipped at last, over ``most``. A source's taken
    words differ from its target by less than half of the smallest document that can be flipped, where its sizes are
    not too uneven for that.
    """
    spark = docs.sparkSession
    rows = sized(docs)
    sources = plan(rows, weights, most)
    table = spark.createDataFrame(
        [(s, n, t, min(most, t / n) if n else 0.0) for s, _, n, t in sources],
        "source string, source_size long, target double, copies double",
    )
    kind = docs.schema["doc_id"].dataType
    total = max(1, sum(k for _, k, _, _ in sources) // block)
    state = (
        rows.join(F.broadcast(table), "source")
        .withColumn("whole", F.when(F.col("size") > 0, F.floor("copies")).otherwise(0).cast("int"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("copies") - F.floor("copies")).otherwise(0.0))
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(total)))
        .select("source", "block", "id", "size", "key", "whole", "p")
    )
    done, level = [], 0
    while True:
        state = checkpoint(state.groupBy("source", "block").applyInPandas(_round_block(seed, level), STATE))
        done.append(state.filter("p <= 0 or p >= 1"))
        state = state.filter("p > 0 and p < 1")
        if total == 1:
            break
        total, level = -(-total // fan_in), level + 1
        state = state.withColumn("block", F.floor(F.col("block") / fan_in))
    out = state.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))  # one row per source at most
    for part in done:
        out = out.unionByName(part)
    out = out.withColumn("copies", F.col("whole") + F.round("p").cast("int"))
    flipped = closing(out, table.select("source", "target"), most, each)
    copies = F.col("copies") + F.coalesce("flip", F.lit(0))
    return out.join(F.broadcast(flipped), "key", "left").join(F.broadcast(table.drop("copies")), "source").select(
        F.col("id").cast(kind).alias("doc_id"), "key", F.when(F.col("source") != "0", F.substring("source", 2, 1 << 30)).alias("source"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its number among its copies.

    Rows that are the same in all columns share their copies, so that as many come out as all of them were given;
    rows of one id or text that differ elsewhere are apart. Rows without words are in no mix; an empty table gives an
    empty result. A column copy is replaced; columns of other names stay, whatever they are called.
    """
    docs = without(docs, "copy")
    got = mix(docs, **options).groupBy("key").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("times")).filter("copies > 0")
    both = packed(docs).join(got, "key")
    once, repeated = both.filter("times = 1"), both.filter("times > 1").dropDuplicates(["key"])
    return unpacked(once.unionByName(repeated), docs, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
