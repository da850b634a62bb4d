"""Shared helpers: checkpoints, Arrow text access, word hashes and shingles."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.functions.storage import checkpoint, written  # noqa: F401

#: Bytes of text that a task turns into numpy arrays at once.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch. Spark's own bound is 10,000 rows, which can be any number of bytes where texts are long.
BATCH_BYTES, _BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, one: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over batches of about BATCH_BYTES at most, or of what the session already says.

    The bound is an option of the session, read when the plan runs; it is set where it is unset, and stays.
    """
    conf = df.sparkSession.conf
    if _BATCH_KEY not in conf.getAll:
        conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    return df.mapInArrow(one, schema)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def without(df: DataFrame, *added: str) -> DataFrame:
    """The frame without columns that have the names of those an operator adds (its own replace them)."""
    names = {x.lower() for x in added}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in names))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def row_key(df: DataFrame) -> Column:
    """Names a row by all its columns, so that rows of one name are the same; nulls of different columns differ."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [c.isNull(), F.to_json(F.struct(c)) if _has_map(f.dataType) else c]
    return F.xxhash64(*parts)


def packed(df: DataFrame) -> DataFrame:
    """doc: the whole row; key: its name. Columns of a row's own can't clash with what an operator adds beside."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"), row_key(df).alias("key"))


def unpacked(df: DataFrame, like: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``like`` out of doc, and more."""
    return df.select(*(F.col(f"doc.`{c}`").alias(c) for c in like.columns), *more)


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the number of each row from 0 in ``order``; rows that it can't tell apart are numbered in any order.

    Rows are parted by ranges of order, where a further column keeps rows of equal order from lying in one part,
    numbered within their parts, written, and read with the numbers of the parts before, one row a part.
    """
    tie, at, part = fresh(rows, "_tie", "_at", "_part")
    own = checkpoint(rows.withColumn(tie, F.xxhash64(F.monotonically_increasing_id())))
    own = own.repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, tie)
    # its upper bits are the partition's number, the lower ones count rows
    own = written(own.withColumn(at, F.monotonically_increasing_id()).drop(tie))
    own = own.withColumn(part, F.shiftright(at, 33))
    sizes = own.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as parts
    number = F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    offsets = F.broadcast(sizes.select(part, before.alias("_before")))
    return own.join(offsets, part).select(*(f"`{c}`" for c in rows.columns), number.alias(name))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive items of about ``limit`` bytes, one item at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


class WordHash(dict):
    """Word as bytes -> 64-bit hash of it in lower case without punctuation and symbols; 0 if nothing is left."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        text = word.decode("utf-8", "replace").lower()
        if not text.isalnum():
            text = "".join(c for c in text if unicodedata.category(c)[0] not in "PSZC")
        h = self[word] = (xxhash.xxh3_64_intdigest(text.encode()) or 1) if text else 0
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_arrays(docs: list[bytes], cache: WordHash) -> list[np.ndarray]:
    """Hashes of each text's words, in order, without the empty ones."""
    out = []
    for text in docs:
        words = text.split()
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        out.append(h[h != 0] if len(h) and not h.all() else h)
    return out


def shingles(words: list[np.ndarray], n: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles of all texts, one after another, and where each text's begin (one offset more than texts).

    A text of fewer than n words, but not of none, has one shingle of all of them if ``short``, else none.
    """
    padded = [np.pad(w, (0, n - len(w))) if short and 0 < len(w) < n else w for w in words]
    sizes = np.array([len(w) for w in padded], np.int64)
    counts = np.maximum(sizes - (n - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if not offsets[-1]:
        return np.empty(0, np.uint64), offsets
    flat = np.concatenate(padded)
    m = len(flat) - n + 1
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0x100000001B3) + mix(flat[j : j + m] + np.uint64(j + 1))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keep = np.zeros(len(flat) + 1, np.int32)
    full = counts > 0
    np.add.at(keep, starts[full], 1)
    np.add.at(keep, starts[full] + counts[full], -1)
    return mix(acc[np.cumsum(keep)[:m] > 0]), offsets


def long_of(x: np.ndarray) -> np.ndarray:
    """uint64 as the signed long of the same bits."""
    return x.view(np.int64)
