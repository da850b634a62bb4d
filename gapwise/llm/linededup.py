"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import checkpoint, fresh, in_arrow, texts, without, written

_SPACES = b" \t\n\v\f\r"


def windows_of(text: bytes, n: int = 3) -> tuple[list[bytes], list[int]]:
    """Windows of n consecutive lines that hold more than white space, and where in the text each window's lines begin among all lines."""
    at = [(i, x.strip(_SPACES)) for i, x in enumerate(text.split(b"\n"))]
    at = [(i, x) for i, x in at if x]
    return [b"\n".join(x for _, x in at[k : k + n]) for k in range(len(at) - n + 1)], [i for i, _ in at]


def window_table(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row, pos, h, g: each window's place and 128-bit hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pos, low, high = [], [], [], []
            for k, text in enumerate(texts(batch.column(2))):
                found, _ = windows_of(text, n)
                for p, w in enumerate(found):
                    x = xxhash.xxh3_128_intdigest(w)
                    owner.append(k)
                    pos.append(p)
                    low.append(x & 0xFFFFFFFFFFFFFFFF)
                    high.append(x >> 64)
            at = pa.array(owner, pa.int64())
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), *longs], names=["doc_id", "row", "pos", "h", "g"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").transform(in_arrow, emit, f"doc_id {kind}, row long, pos int, h long, g long")


def later_windows(docs: DataFrame, n: int = 3, salted: int = 4096) -> DataFrame:
    """doc_id, row, starts: of each document with any, the windows that occur before, in a document of lower id or higher up.

    Windows that occur once are dropped early, by 64 bits of the hash; those of a repeated hash are then compared by
    all 128 bits. The places of a frequent window are dealt to as many parts as they fill with ``salted`` each, and its
    first place is sent to every part.
    """
    every = written(window_table(docs, n))
    repeated = every.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1")
    held = checkpoint(every.join(repeated, "h"))
    # a null id comes after all others
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row", "pos")
    parts = F.ceil(F.col("times") / F.lit(salted)).cast("long")
    first = held.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(parts).alias("parts"))
    first = first.select("h", "g", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    later = held.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), parts)).join(first, ["h", "g", "salt"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("starts"))  # as many as the document has lines


def covered(text: bytes, starts: list[int], n: int = 3) -> tuple[bytes, int]:
    """The text without the lines of the windows that start at ``starts``, merged, and how many lines that are."""
    _, at = windows_of(text, n)
    gone = {at[s + k] for s in starts for k in range(n)}
    lines = text.split(b"\n")
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


def dedup_lines(docs: DataFrame, n: int = 3) -> DataFrame:
    """Rows of ``docs``, all columns, with later occurrences of windows of n lines cut from text; plus n_removed.

    Lines are compared without white space around them; lines of nothing else belong to no window and stay. A text of
    fewer than n lines has no window and stays as it is; null stays null. Of equal windows the one in the document of
    lowest id (null last, then by a hash of id and text) and of the lowest place stays. Rows that repeat id and text
    count as one document and are all cut alike. Texts of any length are read whole. An empty table gives an empty
    result. A column n_removed is replaced; columns of other names stay, whatever they are called.
    """
    later = later_windows(docs, n)
    docs = without(docs, "n_removed")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", F.xxhash64("doc_id", "text").alias("row"))
    both = own.alias("a").join(later.alias("b"), (F.col("a.row") == F.col("b.row")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    at = docs.columns.index("text")
    names = [*docs.columns, "n_removed"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, gone = [], []
            column = batch.column(at)
            for text, ok, starts in zip(texts(column), column.is_valid().to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                body, k = covered(text, starts, n) if starts else (text, 0)
                bodies.append(body.decode("utf-8", "replace") if ok else None)
                gone.append(k)
            columns = [pa.array(bodies, column.type) if i == at else batch.column(i) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], names=names)

    return both.select("doc.*", F.col("starts").alias(*fresh(docs, "starts"))).transform(in_arrow, cut, T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType())]))


def line_dedup_digest(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed, kept: md5 of the text that stays (null for null)."""
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    own = docs.select("doc_id", "text", lines.cast("long").alias("n_lines"))
    return dedup_lines(own, n).select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept"))


#: DuckDB SQL for line_dedup_digest() of the documents, whose ids are set and unique.
LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, line_no, line, trim(line, E' \t\n\x0b\x0c\r') AS body
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
), filled AS (
  SELECT doc_id, line_no, body, row_number() OVER w - 1 AS pos,
    lead(body, 1) OVER w AS b2, lead(body, 2) OVER w AS b3, lead(line_no, 1) OVER w AS l2, lead(line_no, 2) OVER w AS l3
  FROM lines WHERE body <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body, b2, b3 ORDER BY doc_id, pos) AS rn FROM filled WHERE b3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest([line_no, l2, l3]) AS line_no FROM ranked WHERE rn > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
  md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '')) AS kept
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no
GROUP BY l.doc_id
"""
