"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Signatures are one-permutation MinHashes with a number of bins that is a power of two: the hash space is cut into
bins, and the least hash of each is kept. Items are parted by size, and so are documents: an item of 2^j to
2^(j+1) - 1 shingles is searched in a document of 2^i to 2^(i+1) - 1 with 2^(i - j + c) bins on both sides, as many as
make it all but certain that an item of which a share t is in the document has an equal least hash in one bin at
least. So long items are found by small signatures, and short items in long documents by large ones. A hash that is
the least of its bin stays so in smaller bins; that gives each hash a level, from which on it is in the signature,
and one sorted table serves all partitions. Pairs that meet are verified by all their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import WordHash, checkpoint, chunks, in_arrow, long_of, shingles, texts, word_arrays

#: Bins to an item's least number of shingles in its share of the document, as a power of two. With t = 0.8 an item
#: and a document agree in over 10 bins on average then, at the sizes that are worst for it.
BINS = 5


def levels(values: np.ndarray) -> np.ndarray:
    """For sorted distinct hashes, the least m at which each is the least of its bin among 2^m bins of equal width."""
    if not len(values):
        return np.empty(0, np.int64)
    # a hash is the least of its bin once its bin and that of the hash before it differ
    change = values[1:] ^ values[:-1]
    top = np.minimum(np.frexp(change.astype(np.float64))[1].astype(np.int64), 64)  # bits up to the highest that differs, or one more
    top = np.where(change >> (top - 1).astype(np.uint64) == 0, top - 1, top)
    return np.concatenate([[0], 65 - top])


def size_part(n: np.ndarray | int) -> np.ndarray:
    """k of sizes from 2^k to 2^(k + 1) - 1."""
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


class Sketches:
    """Signatures and whole shingle sets of a block of items."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], least: float):
        self.ids, self.least = np.array(ids, np.int64), least
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.parts = size_part(self.sizes)
        self.smallest = int(self.parts.min()) if len(sets) else 0
        sets = [np.sort(s) for s in sets]
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        level = np.concatenate([levels(s) for s in sets]) if sets else np.empty(0, np.int64)
        item = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.full, self.item, self.level = flat[order], item[order], level[order]
        #: Bit table by the low bits of the hashes, to look up the few shingles that may be an item's only.
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.full & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def _hits(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table of every hash that is among ``wanted`` (distinct), and which of them it is."""
        lo, hi = np.searchsorted(self.full, wanted, "left"), np.searchsorted(self.full, wanted, "right")
        n = hi - lo
        return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), np.repeat(np.arange(len(wanted)), n)

    def search(self, doc: np.ndarray) -> list[tuple[int, float]]:
        """(item, containment) of the items that a document's shingles contain to the least share."""
        if not len(self.full) or not len(doc):
            return []
        may = self.bits[(doc & np.uint64((1 << 22) - 1)).astype(np.int64)]
        if not may.any() or not len(self._hits(np.unique(doc[may]))[0]):
            return []
        doc = np.unique(doc)
        bins = int(size_part(len(doc))) + BINS
        level = levels(doc)
        # the signature for the smallest items holds those for all others
        kept = np.flatnonzero((level <= bins - self.smallest) & self.bits[(doc & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at, which = self._hits(doc[kept])
        own = bins - self.parts[self.item[at]]
        met = (self.level[at] <= own) & (level[kept[which]] <= own)
        candidates = np.unique(self.item[at[met]])
        if not len(candidates):
            return []
        found = np.bincount(self.item[self._hits(doc)[0]], minlength=len(self.ids))
        share = found[candidates] / self.sizes[candidates]
        return [(int(self.ids[i]), float(x)) for i, x in zip(candidates, share, strict=True) if x >= self.least - 1e-12]


def item_shingles(items: DataFrame, id_column: str = "item_id", n: int = 5) -> DataFrame:
    """item, shingles: the distinct shingles of each item with any."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            flat, at = shingles(word_arrays(texts(batch.column(1)), cache), n, short=False)
            sets = [long_of(np.unique(flat[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["item", "shingles"])

    own = items.filter(F.col("text").isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), "text")
    return own.transform(in_arrow, emit, "item long, shingles array<long>").filter("size(shingles) > 0")


def blocks(items: DataFrame, least: float, n: int, most: int, id_column: str = "item_id") -> tuple[int, Iterator[Broadcast]]:
    """Number of blocks of about ``most`` shingles of items each, and a broadcast of each, which is there until the next one is asked for."""
    own = item_shingles(items, id_column, n)
    total = own.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    k = max(1, -(-total // most))

    def each() -> Iterator[Broadcast]:
        for b in range(k):
            # by the identifier alone, so that repeated items are searched together
            rows = own.filter(F.pmod(F.xxhash64("item"), F.lit(k)) == b).collect()
            made = Sketches([r["item"] for r in rows], [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows], least)
            shared = items.sparkSession.sparkContext.broadcast(made)
            yield shared
            if k > 1:
                shared.unpersist()

    return k, each()


def contamination(docs: DataFrame, items: DataFrame, least: float = 0.8, n: int = 5, most: int = 4_000_000, id_column: str = "item_id") -> DataFrame:
    """doc_id, item_id, containment: every pair of a document and an item of which it holds the share ``least`` or more.

    Words are compared in lower case without punctuation. Items of fewer than n words are no evidence and match
    nothing; null and empty texts hold nothing; items of a null id are left out; ids of items are whole numbers, those
    of documents of any type; repeated documents are reported each, repeated items as one pair of the higher share;
    texts of any length are searched whole; empty tables give an empty result; further columns are ignored. Items are
    searched in blocks that fit a broadcast, each against all documents, one after another.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    k, each = blocks(items, least, n, most, id_column)
    out = None
    for shared in each:

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache = WordHash()
            for batch in batches:
                bodies, owner, item, share = texts(batch.column(1)), [], [], []
                for part in chunks([len(x) for x in bodies]):
                    flat, at = shingles(word_arrays(bodies[part], cache), n, short=False)
                    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True), part.start):
                        best: dict[int, float] = {}
                        for found, x in shared.value.search(flat[a:b]):
                            best[found] = max(x, best.get(found, 0.0))
                        owner += [i] * len(best)
                        item += best.keys()
                        share += best.values()
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(item, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "containment"])

        own = docs.select("doc_id", "text").transform(in_arrow, search, f"doc_id {kind}, item_id long, containment double")
        own = checkpoint(own) if k > 1 else own
        out = own if out is None else out.unionByName(own)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, least: float = 0.8, n: int = 5, most: int = 4_000_000) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no item; nulls, empty, short and long texts as in contamination().

    Searched block by block where they lie; no row is shuffled. Repeated rows are judged alike, and columns of any
    name stay. With more than one block what is left is checkpointed after each, so that one block is held at a time.
    """
    at = docs.columns.index("text")
    k, each = blocks(items, least, n, most)
    for shared in each:

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache = WordHash()
            for batch in batches:
                bodies, clean = texts(batch.column(at)), []
                for part in chunks([len(x) for x in bodies]):
                    flat, offsets = shingles(word_arrays(bodies[part], cache), n, short=False)
                    clean += [not shared.value.search(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.transform(in_arrow, keep, T.StructType(docs.schema.fields))
        docs = checkpoint(docs) if k > 1 else docs
    return docs
