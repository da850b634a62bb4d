"""Comparisons within groups, in tiles of bounded size, so that no group is gathered in one task and no pair is emitted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(members: DataFrame, group: str, node: str, loose: Column, size: Column, most: int) -> DataFrame:
    """Deals the members of a group into chunks, and each chunk to the tiles in which it is compared.

    Every pair of members of which one at least is loose meets in exactly one tile (lo, hi), two chunks or one with
    itself; members that aren't loose are compared with loose ones only. ``size`` is what a member weighs; chunks
    weigh about ``most`` on average. Adds lo, hi, part (the chunk that the row is of) and sorts so that a tile's rows
    follow one another in a partition. Where no member of a group is loose, none of it is sent.
    """
    own = members.withColumn("_loose", loose)
    sums = own.groupBy(group).agg(F.sum(F.when(F.col("_loose"), size)).alias("_a"), F.sum(F.when(~F.col("_loose"), size)).alias("_b")).filter("_a is not null")
    chunks = [F.ceil(F.coalesce(F.col(c), F.lit(0)) / F.lit(most)).cast("long") for c in ("_a", "_b")]
    own = own.join(sums.select(group, F.greatest(chunks[0], F.lit(1)).alias("_a"), chunks[1].alias("_b")), group)
    part = F.when(F.col("_loose"), F.pmod(F.xxhash64(node), F.col("_a"))).otherwise(F.col("_a") + F.pmod(F.xxhash64(node), F.greatest("_b", F.lit(1))))
    last = F.when(F.col("_loose"), F.col("_a") + F.col("_b")).otherwise(F.col("_a")) - 1
    own = own.withColumn("part", part).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    own = own.select(*members.columns, "part", F.least("part", "_j").alias("lo"), F.greatest("part", "_j").alias("hi"))
    return own.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", node)


def by_tile(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], tile: Callable[[pa.Table], None]) -> Iterator[None]:
    """Calls ``tile`` with each run of rows of equal keys, also if it crosses batches; yields after each batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        ids = list(zip(*columns, strict=True))
        start = 0
        for i, x in enumerate(ids):
            if x != last:
                if start < i:
                    held.append(batch.slice(start, i - start))
                if held:
                    tile(pa.Table.from_batches(held))
                held, start, last = [], i, x
        if start < len(ids):
            held.append(batch.slice(start))
        yield
    if held:
        tile(pa.Table.from_batches(held))
    yield
