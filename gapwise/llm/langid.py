"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import checkpoint, chunks, crc_mod, fresh, in_arrow, texts


@cache
def _alpha() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(docs: list[bytes], orders: int, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, hashes of the n-grams of all texts and where each text's begin; whether each text has a letter.

    Letters are in lower case; every other character counts as a space.
    """
    low = [x.decode("utf-8", "replace").lower() for x in docs]
    sizes = np.array([len(x) for x in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    alpha = _alpha()[points]
    ends = np.cumsum(sizes)
    before = np.concatenate([[0], np.cumsum(alpha)])
    letters = before[ends] > before[ends - sizes]
    points = np.where(alpha, points, np.uint32(32)).astype(np.uint64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    out, acc = [], np.zeros(len(points), np.uint64)
    for n in range(1, orders + 1):
        m = max(0, len(points) - n + 1)
        acc = acc[:m] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        keep = owner[:m] == owner[n - 1 :]
        h = ((acc[keep] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)
        out.append((h, np.concatenate([[0], np.cumsum(np.maximum(0, sizes - n + 1))])))
    return out, letters


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's part of ``values``."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class NaiveBayes:
    """languages, log prior, log probability of each bucket by language (float32, languages x 2 ** bits)."""

    def __init__(self, languages: list[str], prior: np.ndarray, table: np.ndarray, orders: int, bits: int):
        self.languages, self.prior, self.table, self.orders, self.bits = languages, prior, table, orders, bits

    def judge(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the best language's place, its log likelihood, the logarithm of the sum over all languages, and whether it has a letter."""
        if not docs or not self.languages:
            none = np.zeros(len(docs))
            return none.astype(np.int64), none - np.inf, none - np.inf, none.astype(bool)
        by_order, letters = grams(docs, self.orders, self.bits)
        ll = np.tile(self.prior, (len(docs), 1))
        for h, offsets in by_order:
            for k in range(len(self.languages)):
                ll[:, k] += sums(self.table[k][h], offsets)
        top = ll.max(axis=1)
        return ll.argmax(axis=1), top, top + np.log(np.exp(ll - top[:, None]).sum(axis=1)), letters

    def predict(self, docs: list[bytes]) -> tuple[list[str], np.ndarray]:
        best, top, total, letters = self.judge(docs)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], np.where(letters, np.exp(np.where(letters, top - total, 0.0)), 0.0)


def counted(docs: DataFrame, orders: int, bits: int) -> DataFrame:
    """lang, bucket (-1: rows with a letter), n of rows (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}

        def flush():
            for lang, n in table.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])
            table.clear()

        for batch in batches:
            langs, bodies = batch.column(0).to_pylist(), texts(batch.column(1))
            order = sorted(range(len(langs)), key=langs.__getitem__)
            langs, bodies = [langs[i] for i in order], [bodies[i] for i in order]
            for part in chunks([len(x) for x in bodies]):
                by_order, letters = grams(bodies[part], orders, bits)
                names = np.array(langs[part])
                for lang in dict.fromkeys(langs[part]):
                    own = np.flatnonzero(names == lang)
                    n = table.setdefault(lang, np.zeros(2**bits + 1, np.int64))
                    n[0] += letters[own].sum()
                    for h, offsets in by_order:  # sorted by language, so its texts follow one another
                        n[1:] += np.bincount(h[offsets[own[0]] : offsets[own[-1] + 1]], minlength=2**bits)
            if len(table) > 64:
                yield from flush()
        yield from flush()

    return docs.transform(in_arrow, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train: Column, orders: int = 3, bits: int = 16, smooth: float = 0.05, most_languages: int = 256) -> Iterator[NaiveBayes]:
    """Models of all languages, of about half of ``most_languages`` each, from all rows where ``train`` holds and lang is set.

    Languages are counted first. Up to most_languages there is one model, which is what the driver receives and what
    is broadcast: most_languages x 2 ** bits counts at most. More are parted by a hash, and one model follows another;
    a text's best language is the best of all models, and their sums add up.
    """
    own = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    n_languages = own.agg(F.countDistinct("lang")).first()[0]
    parts = 1 if n_languages <= most_languages else -(-2 * n_languages // most_languages)
    total = counted(own, orders, bits)
    if parts > 1:
        total = checkpoint(total)
    rows, kinds = None, n_languages
    for part in range(parts):
        mine = total if parts == 1 else total.filter(F.pmod(F.xxhash64("lang"), F.lit(parts)) == part)
        got = mine.toPandas()
        if rows is None:
            rows = int(got.loc[got["bucket"] < 0, "n"].sum()) if parts == 1 else total.filter("bucket < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        languages = sorted(got["lang"].unique())
        table, size = np.zeros((len(languages), 2**bits)), np.zeros(len(languages))
        for k, lang in enumerate(languages):
            one = got[got["lang"] == lang]
            at, n = one["bucket"].to_numpy(), one["n"].to_numpy()
            size[k] = n[at < 0].sum()
            table[k, at[at >= 0]] = n[at >= 0]
        table = np.log((table + smooth) / (table.sum(axis=1, keepdims=True) + smooth * 2**bits)) if languages else table
        prior = np.log((size + 1) / (rows + kinds)) if languages else size
        yield NaiveBayes(languages, prior, table.astype(np.float32), orders, bits)


def judged(docs: DataFrame, models: Iterator[NaiveBayes]) -> tuple[DataFrame, Column, Column]:
    """``docs`` with columns added, and from these the language and score of each row; no row is shuffled.

    Models beyond the first are applied to checkpoints, so that one is held at a time.
    """
    at, n = docs.columns.index("text"), len(docs.columns)
    names = fresh(docs, "lang", "top", "total")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, k) for x, k in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))])
    own, before = docs, None
    for number, model in enumerate(models):
        shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by most_languages in fit()

        def judge(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bodies, lang, top, total = texts(batch.column(at)), [], [np.empty(0)], [np.empty(0)]
                for part in chunks([len(x) for x in bodies]):
                    best, high, every, letters = shared.value.judge(bodies[part])
                    lang += [shared.value.languages[i] if ok else None for i, ok in zip(best, letters, strict=True)]
                    top.append(np.where(letters, high, -np.inf))
                    total.append(np.where(letters, every, -np.inf))
                top, total = np.concatenate(top), np.concatenate(total)
                if number:
                    old = list(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True))
                    new = list(zip(lang, top.tolist(), strict=True))
                    # the likelier one; of two alike the first by code point
                    lang = [min(((-y, x) for x, y in ((a, p), (b, q)) if x is not None), default=(0, None))[1] for (a, p, _), (b, q) in zip(old, new, strict=True)]
                    top, total = np.maximum(top, [x[1] for x in old]), np.logaddexp(total, [x[2] for x in old])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(lang, pa.string()), pa.array(top), pa.array(total)], names=schema.names)

        own = own.transform(in_arrow, judge, schema)
        if number:
            own = checkpoint(own)
            before.unpersist()
        before = shared
    lang, top, total = (F.col(f"`{x}`") for x in names)
    return own, F.coalesce(lang, F.lit("und")), F.when(lang.isNull(), 0.0).otherwise(F.exp(top - total))


def language_id(docs: DataFrame, mod: int = 4, held_out: int = 2, **options) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod ``mod`` is not ``held_out`` and predicts all rows.

    doc_id, held_out, lang_pred, score. A text that is null or has no letter is ``und`` with score 0, and so are all
    without any training row; of languages alike the first by code point is taken; texts of any length count whole; a
    null doc_id counts as empty text in the split; repeated rows are predicted each; an empty table gives an empty
    result; further columns are ignored.
    """
    own, lang, score = judged(docs.select("doc_id", "text"), fit(docs, crc_mod(F.col("doc_id"), mod) != held_out, **options))
    return own.select("doc_id", (crc_mod(F.col("doc_id"), mod) == held_out).alias("held_out"), lang.alias("lang_pred"), score.alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is identified with a posterior of ``least`` or more.

    The model learns from all rows with a language. Rows without letters go (null, empty and long texts as in
    language_id), all others are judged alike; repeated rows stay or go together; an empty table gives an empty
    result; columns of any name stay.
    """
    own, lang, score = judged(docs, fit(docs, F.lit(True), **options))
    return own.filter((lang != "und") & (score >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))
