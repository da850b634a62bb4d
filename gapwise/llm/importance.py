"""Importance resampling towards a target distribution, by hashed n-gram features.

A task maps the distinct words that it meets to integers. An n-gram is the pair of its first n - 1 words' number and
its last word's, and gets a number of its own, so that it is a tuple of integers however long its words are. The bytes
of each distinct tuple are put together and hashed once; texts hold numbers, and take buckets by them. Counts of
buckets are added up over all rows and joined back to each row's features, as gains in log probability, with a Gumbel
draw of the row's id on top; the rows of the highest sums are a sample without replacement by importance.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import checkpoint, chunks, in_arrow, numbered, texts, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of lower-cased UTF-8; bytes beyond ASCII belong to words
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Distinct tuples that a task keeps before it starts anew.
MOST_KEPT = 2_000_000


class Tuples:
    """Numbers of words and n-grams, and the bucket of each."""

    def __init__(self, orders: tuple[int, int], buckets: int, most: int = MOST_KEPT):
        self.first, self.last, self.buckets, self.most = *orders, buckets, most
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.held = 0
        #: For each order: sorted keys of known tuples, their numbers by key, their buckets by number.
        self.known = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)) for _ in range(self.last)]

    def numbers(self, n: int, keys: np.ndarray, spelled) -> np.ndarray:
        """Numbers of n-grams by their keys; new ones are hashed, from the bytes that spelled(place) gives."""
        own, numbers, buckets = self.known[n - 1]
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(own, distinct), max(len(own) - 1, 0))
        new = own[place] != distinct if len(own) else np.ones(len(distinct), bool)
        if new.any():
            more = [zlib.crc32(spelled(i)) % self.buckets for i in at[new].tolist()] if n >= self.first else [0] * int(new.sum())
            merged = np.concatenate([own, distinct[new]])
            order = np.argsort(merged, kind="stable")
            numbers = np.concatenate([numbers, len(numbers) + np.arange(len(more))])[order]
            own, buckets = merged[order], np.concatenate([buckets, np.array(more, np.int32)])
            self.known[n - 1] = own, numbers, buckets
            self.held += len(more)
            place = np.searchsorted(own, distinct)
        return numbers[place][inverse]

    def features(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text, and of all features the text that they are in and their bucket."""
        if self.held > self.most:
            self.forget()
        found = [WORD.findall(x.translate(LOWER)) for x in docs]
        sizes = np.array([len(x) for x in found], np.int64)
        words = [w for x in found for w in x]
        known = self.words
        for w in dict.fromkeys(words):
            known.setdefault(w, len(known))
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        owner = np.repeat(np.arange(len(docs)), sizes)
        owners, buckets, code = [], [], ids
        for n in range(1, self.last + 1):
            m = max(0, len(ids) - n + 1)
            inside = owner[:m] == owner[n - 1 :]
            key = ids if n == 1 else (code[:m] << np.uint64(32)) | ids[n - 1 :]
            place = np.flatnonzero(inside)
            numbers = self.numbers(n, key[place], lambda i, n=n, place=place: b" ".join(words[place[i] : place[i] + n]))
            if n >= self.first:
                owners.append(owner[place])
                buckets.append(self.known[n - 1][2][numbers])
            code = np.zeros(m, np.uint64)
            code[place] = numbers
        return sizes, np.concatenate(owners), np.concatenate(buckets)


def features(docs: DataFrame, keep: list[str], orders: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """The columns ``keep`` of ``docs``, n_words, n_features, and the distinct buckets of each row with their counts.

    Null and empty texts have none; texts of any length count whole; runs never reach from one text into the next.
    """
    fields = docs.select(*keep).schema.fields
    more = "n_words long, n_features long, buckets array<int>, counts array<int>"
    schema = T.StructType([*fields, *T._parse_datatype_string(more).fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tuples = Tuples(orders, buckets)
        for batch in batches:
            bodies = texts(batch.column(len(fields)))
            for part in chunks([len(x) for x in bodies]):
                k = part.stop - part.start
                sizes, owner, bucket = tuples.features(bodies[part])
                pair, n = np.unique(owner * buckets + bucket, return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(k + 1) * buckets), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pair % buckets, n)]
                kept = [batch.column(i).slice(part.start, k) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes), pa.array(np.bincount(owner, minlength=k)), *lists], names=schema.names)

    return docs.select(*keep, "text").transform(in_arrow, count, schema)


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Counts of each bucket over all rows of features(): one row a task and bucket is added up, and ``buckets`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(total, at, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    made = rows.select("buckets", "counts").transform(in_arrow, add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in made:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's probability in the target and in the raw rows, one added to each count; floors."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw by sha256 of seed and id, floor; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row: the sum of its features' gains, and that with its draw.

    Features are runs of orders[0] to orders[1] words, joined by a space. Null and empty texts have weight 0; a null
    id draws as empty text; rows of one id share their draw; further columns are ignored; an empty table gives an
    empty result, and an empty target leaves the raw counts' part of the gains. Texts are read once, their bucket
    counts are written.
    """
    rows = written(features(docs, ["doc_id"], orders, buckets))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(features(target, [], orders, buckets), buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
            total = np.concatenate([[0], np.cumsum(shared.value[at] * n)])
            ends = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total[ends[1:]] - total[ends[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    own = rows.transform(in_arrow, weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    return own.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: of the rows with least_words or more, ``percent`` of a hundred are drawn.

    rank counts the drawn ones from 1 by score, then by id (null first), and is null for others. Rows of equal score
    and id are numbered in any order. Rows are parted by ranges of score and id, so that no task sorts all of them.
    """
    rows = checkpoint(scored(docs, target, **options))
    fit = numbered(rows.filter(F.col("n_words") >= least_words), [F.desc("score"), F.asc("doc_id")], "rank")
    n = percent * fit.count() // 100
    fit = fit.withColumn("rank", F.when(F.col("rank") < n, F.col("rank") + 1))
    return fit.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The ids of the sample, by rank."""
    return resample(docs, target, **options).filter("rank is not null").select("doc_id", "rank")


#: DuckDB SQL for resample() with its defaults. crc32 is worked out for each distinct word, by a table of its 256 bytes.
RESAMPLE_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), doc_counts AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM doc_words) GROUP BY doc_id, word
), target_counts AS (
  SELECT word, count(*) AS n FROM target_words GROUP BY word
), distinct_words AS (
  SELECT word FROM doc_counts UNION SELECT word FROM target_counts
), bytes AS (
  SELECT word, hex(encode(word)) AS h FROM distinct_words
), hashed AS (
  SELECT word, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::BIGINT + 1]))) % 10000 AS bucket
  FROM bytes, crc_table
), s AS (
  SELECT bucket, sum(n) AS n FROM doc_counts JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS n FROM target_counts JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE)
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, sum(n * g)::BIGINT AS weight FROM doc_counts JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(d.words)::BIGINT AS n_features, coalesce(w.weight, 0) AS weight,
    coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM doc_words d LEFT JOIN weights w USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.rank <= floor(10 * r.fit / 100) THEN r.rank END AS rank
FROM scored s LEFT JOIN ranked r USING (doc_id)
"""
