"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to five bytes, learnt from the training rows. A symbol's probability
starts at the longest context seen; a symbol not seen there costs an escape (method D: half a count of each distinct
symbol) and is looked for one byte shorter, where the symbols of the longer context are excluded; at last come the
bytes never seen at all.

Neither the trie nor the vocabulary of words fits a task, and neither is broadcast. The trie is a table of grams (a
context of five bytes and a symbol) with their counts. Documents are dealt into blocks of bounded size; a block gives
its distinct grams and words, with training counts, which are added up by an aggregate. Grams that share the last
three context bytes, of which there are 2^24 at most however large the corpus is, follow one another in a partition,
and their probabilities are worked out together; contexts of two bytes, one and none are a table of 2^24 counts at
most, far fewer in text, which is broadcast. A join gives each block the probabilities of its grams, and it scores its
documents.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.storage import bucketed
from gapwise.llm.common import chunks, crc_mod, in_arrow, texts

END = 0xFF  # in no UTF-8 text: stands before each text and ends it
ORDER = 5  # bytes of the longest context; 7 at most, as a gram is held in 64 bits
PIECE = 1 << 20
#: Buckets of the table of grams, so that few blocks use many cores too; Spark's own bound is 100,000.
LEAST_BUCKETS, MOST_BUCKETS = 32, 50_000
#: Answers that are packed together before they are sent, by the block that they are for.
PACKED = "block long, keys binary, found binary, words binary"
PACKED_ROWS = 1_000_000


def gram_codes(docs: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Grams (context of ``order`` bytes, then the symbol) of each text and its end, and where each text's begin."""
    end = bytes([END])
    sizes = np.array([len(x) for x in docs], np.int64)
    flat = np.frombuffer(b"".join(x for text in docs for x in (end * order, text, end)), np.uint8).astype(np.uint64)
    m = len(flat) - order
    code = flat[:m].copy()
    for j in range(1, order + 1):
        np.left_shift(code, np.uint64(8), out=code)
        np.bitwise_or(code, flat[j : j + m], out=code)
    keep = np.ones(len(flat), bool)
    ends = np.cumsum(sizes + order + 1)
    for j in range(1, order + 1):
        keep[ends - j] = False
    return code[keep[:m]], np.concatenate([[0], np.cumsum(sizes + 1)])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of n of each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n, at)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key, 0 if it isn't there. keys: sorted."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def lowered(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column with A-Z in lower case."""
    return [x.lower() for x in texts(column)]


class Slots:
    """Where each of many keys is among sorted distinct ones, by a table of slots; the few that clash are searched for."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(wanted)]
        miss = np.flatnonzero(self.keys[at] != wanted)
        if len(miss):
            at[miss] = np.searchsorted(self.keys, wanted[miss])
        return at


class Low:
    """Grams of contexts of two bytes, one and none with their counts, and the contexts' totals: levels[k] and contexts[k] as in log_probabilities()."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.levels = {2: summed(keys[n > 0], n[n > 0])}
        for k in (1, 0):
            keys, n = self.levels[k + 1]
            self.levels[k] = summed(keys & np.uint64((1 << 8 * (k + 1)) - 1), n)
        self.contexts = {k: context_totals(self.levels, k) for k in (2, 1, 0)}


def context_totals(levels: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of k bytes; of each, the sum of its symbols' counts, how many symbols, and the sum of these symbols' counts one byte shorter."""
    keys, n = levels[k]
    below = lookup(*levels[k - 1], keys & np.uint64((1 << 8 * k) - 1)) if k else np.zeros(len(keys), np.int64)
    ctx = keys >> np.uint64(8)
    names, total = summed(ctx, n)
    return names, total, summed(ctx, np.ones(len(ctx), np.int64))[1], summed(ctx, below)[1]


def log_probabilities(grams: np.ndarray, count: np.ndarray, low: Low, order: int = ORDER) -> np.ndarray:
    """log10 of the PPM probability of each gram's symbol after its context.

    grams: distinct, with all grams of a context of three bytes or none; count: in the training rows, 0 if not there.
    """
    seen = count > 0
    levels, contexts = dict(low.levels), dict(low.contexts)
    levels[order] = summed(grams[seen], count[seen])
    for k in range(order - 1, 2, -1):
        keys, n = levels[k + 1]
        levels[k] = summed(keys & np.uint64((1 << 8 * (k + 1)) - 1), n)
    for k in range(order, 2, -1):
        contexts[k] = context_totals(levels, k)
    out = np.zeros(len(grams))
    todo = np.arange(len(grams))
    skipped_n = np.zeros(len(grams), np.int64)  # of the symbols that the longer context excludes: counts here, and how many
    skipped_d = np.zeros(len(grams), np.int64)
    for k in range(order, -1, -1):
        code = grams[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
        ctx = code >> np.uint64(8)
        names, total, distinct, below = contexts[k]
        n, d = lookup(names, total, ctx), lookup(names, distinct, ctx)
        c = lookup(*levels[k], code)
        left_n, left_d = n - skipped_n[todo], d - skipped_d[todo]
        known = n > 0
        hit = known & (c > 0)
        out[todo[hit]] += np.log10((2 * c[hit] - 1) / (2 * left_n[hit]))
        escape = known & ~hit & (left_d > 0)
        out[todo[escape]] += np.log10(left_d[escape] / (2 * left_n[escape]))
        skipped_n[todo[known]] = lookup(names, below, ctx)[known]
        skipped_d[todo[known]] = d[known]
        todo = todo[~hit]
    out[todo] -= np.log10(256 - len(levels[0][0])) if len(levels[0][0]) < 256 else 0.0
    return out


def distinct_grams(bodies: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of texts and their counts in those to learn from.

    Pieces are merged when they are as many as what has been merged, so that about twice the result is held.
    """
    keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    held, held_n, waiting = [], [], 0
    for flag in (True, False):
        own = [i for i, t in enumerate(train) if t is flag]
        for part in chunks([len(bodies[i]) for i in own], PIECE):
            code = np.sort(gram_codes([bodies[i] for i in own[part]])[0])
            at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            held.append(code[at])
            held_n.append(np.diff(np.append(at, len(code))) if flag else np.zeros(len(at), np.int64))
            waiting += len(at)
            if waiting >= max(len(keys), 2 * PIECE):
                keys, n = summed(np.concatenate([keys, *held]), np.concatenate([n, *held_n]))
                held, held_n, waiting = [], [], 0
    return summed(np.concatenate([keys, *held]), np.concatenate([n, *held_n])) if held else (keys, n)


def _packed(array: np.ndarray) -> bytes:
    return zstandard.compress(array.tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each block, of as many batches as fit PACKED_ROWS together."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if held and (batch is None or sum(x.num_rows for x in held) + batch.num_rows > PACKED_ROWS):
            table = pa.Table.from_batches(held)
            block = table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0]))
            table = table.take(pa.array(order))
            for i, j in itertools.pairwise([*at.tolist(), len(order)]):
                yield int(block[order[i]]), table.slice(i, j - i)
            held = []
        if batch is not None and batch.num_rows:
            held.append(batch)


def pack_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a block, in order, as differences, and their probabilities."""
    for block, rows in _by_block(batches):
        keys, p = rows.column("key").to_numpy().view(np.uint64), rows.column("p").to_numpy()
        order = np.argsort(keys)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "keys": [_packed(np.diff(keys[order], prepend=np.uint64(0)))], "found": [_packed(p[order])], "words": pa.array([None], pa.binary())})


def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a block, which hold no space, and their counts."""
    for block, rows in _by_block(batches):
        words = zstandard.compress(b" ".join(rows.column("word").to_pylist()), 1)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "keys": pa.array([None], pa.binary()), "found": [_packed(rows.column("c").to_numpy())], "words": [words]})


def ppm_score(docs: DataFrame, mod: int = 10, held_out: int = 0, block_bytes: int = 28 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id) modulo ``mod`` is not ``held_out`` (a null id counts as empty text there).
    score: log10 of the PPM probability of the bytes, A-Z in lower case, of the text and of its end; base_score:
    smoothed unigram words and an end. Null texts count as empty, of which the end alone is scored; repeated rows are
    learnt from and scored each; texts of any length count whole, though one must fit a task; without training rows
    all bytes are alike; an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", (crc_mod(F.col("doc_id"), mod) != held_out).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    size, rows = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    n_blocks = max(1, -(-size // block_bytes))
    buckets = min(max(n_blocks, LEAST_BUCKETS), MOST_BUCKETS)
    dealt = bucketed(own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))), min(n_blocks, MOST_BUCKETS), "block")

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        bodies, train = lowered(table.column("text")), table.column("train").to_pylist()
        grams, n = distinct_grams(bodies, train)
        words: Counter = Counter()
        for x, t in zip(bodies, train, strict=True):
            words.update(x.split() if t else dict.fromkeys(x.split(), 0))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        columns = [
            pa.array(np.concatenate([grams, hashes]).view(np.int64)), pa.array(np.full(len(grams) + len(words), key[0].as_py(), np.int64)),
            pa.concat_arrays([pa.array(n), pa.array(list(words.values()), pa.int64())]), pa.concat_arrays([pa.nulls(len(grams), pa.binary()), pa.array(list(words), pa.binary())]),
        ]
        return pa.Table.from_arrays(columns, names=["key", "block", "n", "word"])

    # a gram is there once a block at most, as is a word, whose key is a hash
    held = bucketed(dealt.groupBy("block").applyInArrow(gather, "key long, block long, n long, word binary"), buckets, "key")
    by_gram, by_word = held.filter("word is null").drop("word"), held.filter("word is not null")
    grams = by_gram.groupBy("key").agg(F.sum("n").alias("n"))
    words = by_word.groupBy("key", "word").agg(F.sum("n").alias("c"))
    tokens, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    train_tokens, vocabulary = tokens + rows, vocabulary + (rows > 0)
    cost = math.log10(train_tokens + 0.1 * (vocabulary + 1))

    few = by_gram.filter("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 24) - 1)).alias("g")).agg(F.sum("n").alias("n")).toPandas()  # 2^24 rows at most
    shared = spark.sparkContext.broadcast(Low(few["g"].to_numpy(np.int64).astype(np.uint64), few["n"].to_numpy(np.int64)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            p = log_probabilities(keys.view(np.uint64), n, shared.value).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p)], names=["key", "p"])

        keys, n, context = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys, n, context = (np.concatenate([x, np.array(batch.column(c))]) for x, c in ((keys, "key"), (n, "n"), (context, "context")))
            last = int(np.searchsorted(context, context[-1])) if len(context) else 0  # the last context may go on
            if last:
                yield made(keys[:last], n[:last])
                keys, n, context = keys[last:], n[last:], context[last:]
        if len(keys):
            yield made(keys, n)

    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 24) - 1))
    ordered = grams.withColumn("context", context).repartition("context").sortWithinPartitions("context")
    rated = ordered.transform(in_arrow, rate, "key long, p float")
    answers = by_gram.drop("n").join(rated, "key").transform(in_arrow, pack_grams, PACKED)
    answers = answers.unionByName(by_word.drop("n").join(words, ["key", "word"]).select("block", "word", "c").transform(in_arrow, pack_words, PACKED))

    def score(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        bodies = lowered(table.column("text"))
        codes, p, word_log = [], [], {}
        for k, v, w in zip(*(got.column(c).to_pylist() for c in ("keys", "found", "words")), strict=True):
            if w is None:
                codes.append(_unpacked(k, np.uint64).cumsum(dtype=np.uint64))
                p.append(_unpacked(v, np.float32).astype(np.float64))
            else:
                word_log.update(zip(zstandard.decompress(w).split(), np.log10(_unpacked(v, np.int64) + 0.1).tolist(), strict=True))
        codes, p = np.concatenate(codes), np.concatenate(p)
        order = np.argsort(codes)
        slots, p = Slots(codes[order]), p[order]
        end_log = math.log10(rows + 0.1)
        scores, base, n, n_known = [], [], [], []
        for part in chunks([len(x) for x in bodies], PIECE):
            code, at = gram_codes(bodies[part])
            scores.append(np.add.reduceat(p[slots.find(code)], at[:-1]))
            for text in bodies[part]:
                own_words = text.split()
                logs = np.fromiter(map(word_log.__getitem__, own_words), np.float64, len(own_words))
                base.append(float(logs.sum()) + end_log - (len(own_words) + 1) * cost)
                n.append(len(own_words) + 1)
                n_known.append(int((logs > -0.5).sum()) + (rows > 0))
        columns = [table.column("doc_id"), table.column("train"), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(scores), pa.float64())]
        return pa.Table.from_arrays(columns, names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
