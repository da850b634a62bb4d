"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

Texts of the same words are one node. Each node's MinHash signature is cut into trees of values; a tree sorted by
its values is a prefix trie, and nodes that share a prefix of some depth stand under one trie node. The depth begins
at the full length. What is found there tells how similar linked texts are, and so which share of all links prefixes
of that depth find; the prefixes are shortened until that share reaches the target recall.

Under a trie node every member is compared with one of them, the leader, and those like it are linked to it; only
members unlike the leader are compared with the others, in tiles. So a group of near copies costs as many comparisons
as it has members. Components of these links are candidate clusters.

Their exact verification works on what differs. Let P be the shingles that more than half of a cluster's members
hold, D(A) the shingles that are in A or in P but not in both, and z(A) = |A| (1 - t) / (1 + t) - |D(A)|. Then A and B
have similarity t or more exactly if z(A) + z(B) + 2 |D(A) & D(B)| >= 0. Where z(A) + z(B) >= 0 this holds whatever
they share, and links are counted by rank of z; only other pairs are compared, in tiles that emit counts and spanning
edges. In small clusters P is empty, and all pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import WordHash, checkpoint, chunks, in_arrow, long_of, mix, packed, row_key, shingles, texts, unpacked, word_arrays
from gapwise.llm.graph import components
from gapwise.llm.tiles import by_tile, tiled

#: z is held in millionths, as a long. Sums of two that differ from 0 at all differ by far more than this.
_UNIT, _NIL = 1_000_000, -10


def signature(flat: np.ndarray, offsets: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """uint16 hashes of the minima under ``size`` hash functions of each text's shingles (texts without any give zeros)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1 << 62, size=size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1 << 63, size=size, dtype=np.uint64)
    out = np.zeros((len(offsets) - 1, size), np.uint16)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if not len(full):
        return out
    starts, work = offsets[full], np.empty_like(flat)
    for k in range(size):
        np.multiply(flat, a[k], out=work)
        np.add(work, b[k], out=work)
        out[full, k] = (mix(np.minimum.reduceat(work, starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n members' component, given edges."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    return label


def common_counts(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[cols]. Values of one set only are left out; the rest is multiplied in blocks."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = n[code] > 1
    owner, code = owner[keep], (np.cumsum(n > 1) - 1)[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        i, j = np.searchsorted(code, [lo, lo + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[i:j], code[i:j] - lo] = 1
        out += x[rows] @ x[cols].T
    return out


def linked_pairs(sets: list[np.ndarray], z: np.ndarray, part: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that are linked, though z doesn't tell: within the chunk if lo == hi, else across."""
    rows = np.flatnonzero(part == lo)
    cols = rows if lo == hi else np.flatnonzero(part == hi)
    if not len(rows) or not len(cols):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(sets) <= 4:
        pairs = [(i, j) for i in rows for j in cols if (i < j if lo == hi else True) and z[i] + z[j] < _NIL]
        pairs = [(i, j) for i, j in pairs if z[i] + z[j] + 2 * _UNIT * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= _NIL]
        return np.array([i for i, _ in pairs], np.int64), np.array([j for _, j in pairs], np.int64)
    least = z[rows][:, None] + z[cols][None, :]
    ok = (least < _NIL) & (least + 2 * _UNIT * common_counts(sets, rows, cols).astype(np.int64) >= _NIL)
    if lo == hi:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    return rows[i], cols[j]


def signed(docs: DataFrame, n: int, size: int) -> DataFrame:
    """doc_id, key, node (128-bit hash of the words; null without words), sig of every document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            bodies = texts(batch.column(2))
            for part in chunks([len(x) for x in bodies], 2 << 20):
                words = word_arrays(bodies[part], cache)
                flat, offsets = shingles(words, n)
                sig = signature(flat, offsets, size)
                node = [xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words]
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(node, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "key", "node", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key(docs).alias("key"), "text").transform(in_arrow, emit, f"doc_id {kind}, key long, node binary, sig binary")


class Forest:
    """How signatures are cut into trees, and what prefixes of a depth find."""

    def __init__(self, trees: int, length: int, least: float, slack: float):
        self.trees, self.length, self.least = trees, length, least
        self.size = trees * length
        #: Equal values from which a pair is a candidate.
        self.likely = int(np.ceil((least - slack) * self.size))

    def prefixes(self, depth: int) -> Column:
        return F.array(*(F.xxhash64(F.lit(t), F.substring("sig", 2 * self.length * t + 1, 2 * depth)) for t in range(self.trees)))

    def found(self, similarity: np.ndarray, depth: int) -> np.ndarray:
        """Chance that two sets share a prefix of the depth in one of the trees."""
        return 1 - (1 - np.asarray(similarity, np.float64) ** depth) ** self.trees

    def recall(self, counts: dict[int, float], now: int, depth: int) -> float:
        """Share of all links that prefixes of ``depth`` find, by the number of pairs of each count of equal values found at depth ``now``.

        A pair found with chance p stands for 1 / p pairs. One more at the least similarity keeps the share from
        resting on few pairs.
        """
        same = np.array([k for k in counts if k >= self.least * self.size] + [self.least * self.size])
        n = np.array([counts[k] for k in counts if k >= self.least * self.size] + [self.found(self.least, now)])
        every = n / self.found(same / self.size, now)
        return float((every * self.found(same / self.size, depth)).sum() / every.sum())

    def shorter(self, counts: dict[int, float], now: int, target: float) -> int:
        """The longest prefix, of those shorter than ``now``, that reaches the target recall."""
        depth = now - 1
        while depth > 1 and self.recall(counts, now, depth) < target:
            depth -= 1
        return depth


def trie_edges(sigs: DataFrame, forest: Forest, depth: int, deeper: int | None, most: int) -> DataFrame:
    """a, b: links of a spanning forest, by trie node, of the pairs of nodes that are likely similar; same, weight: how many pairs with how many equal values.

    ``deeper``: a depth whose trie nodes are done. A trie node that is one of them, with no other branch, is left out.
    A pair that meets in k trees weighs 1 / k in each.
    """
    under = sigs.select("node", F.posexplode(forest.prefixes(depth)).alias("tree", "trie"), forest.prefixes(deeper or depth).alias("_d"))
    under = under.select("node", "trie", F.col("_d")[F.col("tree")].alias("below"))
    shared = under.groupBy("trie").agg(F.count("*").alias("n"), (F.min("below") != F.max("below")).alias("branches")).filter("n > 1" if deeper is None else "n > 1 and branches")
    shared = checkpoint(shared.select("trie", "n"))
    members = under.select("node", "trie").join(shared, "trie").join(sigs, "node")
    size, trees, likely = forest.size, forest.trees, forest.likely

    def weights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """1 / number of trees in which the rows of a share the prefix with those of b."""
        met = (a.reshape(len(a), trees, -1)[:, :, :depth] == b.reshape(len(b), trees, -1)[:, :, :depth]).all(axis=2).sum(axis=1)
        return 1 / np.maximum(met, 1)

    def batch_of(a: list, b: list, counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        none, rest = [None] * len(at), [None] * len(a)
        columns = [pa.array(a + none, pa.binary()), pa.array(b + none, pa.binary()), pa.array([*rest, *at.tolist()], pa.int32()), pa.array([*rest, *counts[at].tolist()], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "same", "weight"])

    schema = "a binary, b binary, same int, weight double"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, counts = [], [], np.zeros(size + 1)

        def tile(rows: pa.Table) -> None:
            if rows.num_rows < 2:
                return
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(rows.num_rows, -1)
            names, part = rows.column("node").to_pylist(), np.array(rows.column("part"))
            lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
            first, second = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
            left, right = [], []
            for k, i in enumerate(first.tolist()):
                rest = first[k + 1 :] if lo == hi else second
                same = (sig[rest] == sig[i]).sum(axis=1)
                near = rest[same >= likely]
                left.append(np.full(len(near), i))
                right.append(near)
                if len(near):
                    np.add.at(counts, same[same >= likely], weights(sig[near], np.broadcast_to(sig[i], (len(near), size))))
            if not left:
                return
            label = local_components(len(sig), np.concatenate(left), np.concatenate(right))
            for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                a.append(names[i])
                b.append(names[label[i]])

        for _ in by_tile(batches, ("trie", "lo", "hi"), tile):
            yield batch_of(a, b, counts)
            a.clear(), b.clear()
            counts[:] = 0

    small = tiled(members.filter(F.col("n") <= most), "trie", "node", F.lit(True), F.lit(1), most)
    if shared.filter(F.col("n") > most).isEmpty():
        return small.transform(in_arrow, link, schema)

    big = members.filter(F.col("n") > most)
    leads = big.groupBy("trie").agg(F.min(F.struct("node", "sig")).alias("lead"))
    big = big.join(leads, "trie").select("trie", "node", "sig", F.col("lead.node").alias("lead"), F.col("lead.sig").alias("lead_sig"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, size) for c in ("sig", "lead_sig"))
            columns = [*(batch.column(c) for c in ("trie", "node", "sig", "lead")), pa.array((x == y).sum(axis=1).astype(np.int32)), pa.array(weights(x, y))]
            yield pa.RecordBatch.from_arrays(columns, names=["trie", "node", "sig", "lead", "same", "weight"])

    big = checkpoint(big.transform(in_arrow, compare, "trie long, node binary, sig binary, lead binary, same int, weight double"))
    star = big.filter((F.col("same") >= likely) & (F.col("node") != F.col("lead"))).select(F.col("node").alias("a"), F.col("lead").alias("b"), "same", "weight")
    # a member at distance h from the leader and one at distance g are at least |h - g| from each other
    far = big.filter(F.col("same") < likely).groupBy("trie").agg(F.max("same").alias("_near"))
    rest = big.join(far, "trie").filter((F.col("same") < likely) | (F.col("same") <= F.col("_near") + (size - likely))).drop("_near")
    rest = tiled(rest, "trie", "node", F.col("same") < likely, F.lit(1), most)
    return small.transform(in_arrow, link, schema).unionByName(star).unionByName(rest.transform(in_arrow, link, schema))


def candidate_edges(sigs: DataFrame, forest: Forest, target: float, most: int) -> tuple[DataFrame, list[tuple[int, float]]]:
    """a, b of all trie levels that the target recall needs; and the depths with the recall estimated at each."""
    depth, deeper, out, seen = forest.length, None, None, []
    while True:
        made = checkpoint(trie_edges(sigs, forest, depth, deeper, most))
        own = made.filter("a is not null").select("a", "b")
        out = own if out is None else out.unionByName(own)
        # at most as many rows as a signature has values; what deeper levels counted is counted again where a trie node branches
        got = made.filter("same is not null").groupBy("same").agg(F.sum("weight").alias("n")).collect()
        counts = {r["same"]: r["n"] for r in got}
        recall = forest.recall(counts, depth, depth)
        seen.append((depth, recall))
        if recall >= target or depth == 1:
            return out, seen
        depth, deeper = forest.shorter(counts, depth, target), depth


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which of 2 ** bits slots the values of a long column fall in; 2 ** bits / 8 bytes however many rows there are."""
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    got = rows.select(slot.alias("s")).groupBy(F.shiftright("s", 15).alias("k")).agg(F.bitmap_construct_agg(F.pmod("s", F.lit(1 << 15))).alias("m")).collect()
    out = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    for r in got:
        at = r["k"] * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def slots_set(values: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    """Whether each value's slot is set in a bitmap()."""
    s = values.view(np.uint64) & np.uint64((1 << bits) - 1)
    s = s.astype(np.int64)
    return (slots[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def shingle_sets(docs: DataFrame, keys: DataFrame, n: int, bits: int) -> DataFrame:
    """key, node, shingles of the documents whose key may be in ``keys``; a bitmap of fixed size keeps most others from being sent."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(keys, "key", bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            ok = slots_set(np.array(batch.column(0), np.int64), shared.value, bits)
            own = batch.filter(pa.array(ok))
            bodies = texts(own.column(1))
            for part in chunks([len(x) for x in bodies]):
                words = word_arrays(bodies[part], cache)
                flat, offsets = shingles(words, n)
                sets = [long_of(np.unique(flat[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                node = [xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words]
                yield pa.RecordBatch.from_arrays([own.column(0).slice(part.start, part.stop - part.start), pa.array(node, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "node", "shingles"])

    return docs.select(row_key(docs).alias("key"), "text").transform(in_arrow, emit, "key long, node binary, shingles array<long>")


def tile_links(members: DataFrame, most: int) -> DataFrame:
    """node, links, other of the pairs of members (cluster, node, weight, z, diff) that z doesn't decide."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, links, other = [], [], []

        def tile(rows: pa.Table) -> None:
            names = rows.column("node").to_pylist()
            if len(names) < 2:
                return
            column = rows.column("diff").combine_chunks()
            sets = [np.sort(np.asarray(column[i].values)) for i in range(len(names))]
            z, part, weight = (np.array(rows.column(c)) for c in ("z", "part", "weight"))
            i, j = linked_pairs(sets, z, part, rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py())
            total = np.bincount(i, weight[j], len(names)) + np.bincount(j, weight[i], len(names))
            label = local_components(len(names), i, j)
            for k in np.flatnonzero(total > 0).tolist():
                node.append(names[k])
                links.append(int(total[k]))
                other.append(names[label[k]] if label[k] != k else None)

        for _ in by_tile(batches, ("cluster", "lo", "hi"), tile):
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(links, pa.int64()), pa.array(other, pa.binary())], names=["node", "links", "other"])
            node.clear(), links.clear(), other.clear()

    made = tiled(members, "cluster", "node", F.col("z") < 0, 64 + F.size("diff"), most)
    return made.transform(in_arrow, verify, "node binary, links long, other binary")


def verified(members: DataFrame, least: float, small: int, most: int) -> DataFrame:
    """node, links, other: documents of nodes linked to a node, and a node it is linked to (null in some rows), from members (cluster, n, node, weight, shingles).

    small: members up to which all pairs of a cluster are compared; most: shingles (and 64 a member) of a chunk.
    """
    share = (1 - least) / (1 + least)

    def measured(diff: Column) -> Column:
        return F.round((F.size("shingles") * F.lit(share) - F.size(diff)) * _UNIT).cast("long")

    few = members.filter(F.col("n") <= small).select("cluster", "node", "weight", measured(F.col("shingles")).alias("z"), F.col("shingles").alias("diff"))
    out = tile_links(few, most)
    many = members.filter(F.col("n") > small)
    if many.select("cluster").isEmpty():
        return out

    # P: as long as two texts at most; its members' shares of its shingles are counted before they are gathered
    held = many.select("cluster", "n", F.explode("shingles").alias("s")).groupBy("cluster", "s").agg(F.count("*").alias("k"), F.min("n").alias("n")).filter("2 * k > n")
    common = held.groupBy("cluster").agg(F.collect_list("s").alias("p"))
    none = F.array().cast("array<long>")
    own = many.join(common, "cluster", "left").withColumn("p", F.coalesce("p", none))
    own = own.withColumn("diff", F.concat(F.array_except("shingles", "p"), F.array_except("p", "shingles")))
    own = checkpoint(own.select("cluster", "node", "weight", measured(F.col("diff")).alias("z"), "diff"))

    bound = own.groupBy("cluster").agg(F.min("z").alias("z_low"), F.max(F.struct("z", "node")).alias("best"))
    near = own.join(bound, "cluster").select("cluster", "node", "weight", "z", "diff", "z_low", F.col("best.z").alias("z_top"), F.col("best.node").alias("top"))
    # what z alone links: members in order of z, counted by its values (no more than a text has shingles)
    points = own.groupBy("cluster", F.col("z").alias("at")).agg(F.sum("weight").alias("w")).withColumn("z", F.lit(None).cast("long"))
    asked = points.select("cluster", (_NIL - F.col("at")).alias("at"), F.lit(0).cast("long").alias("w"), F.col("at").alias("z"))
    order = Window.partitionBy("cluster").orderBy(F.desc("at"), F.col("z").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    sure = points.unionByName(asked).withColumn("sure", F.sum("w").over(order)).filter("z is not null").select("cluster", "z", "sure")
    certain = near.drop("diff").join(sure, ["cluster", "z"]).select(
        "node", (F.col("sure") - F.when(2 * F.col("z") >= _NIL, F.col("weight")).otherwise(0)).alias("links"),
        F.when((F.col("z") + F.col("z_top") >= _NIL) & (F.col("node") != F.col("top")), F.col("top")).alias("other"),
    )
    open_ = near.filter((F.col("z") < 0) | (F.col("z") + F.col("z_low") < _NIL)).select("cluster", "node", "weight", "z", "diff")
    return out.unionByName(certain).unionByName(tile_links(open_, most))


def classes(
    docs: DataFrame, least: float = 0.8, n: int = 5, recall: float = 0.9995, trees: int = 16, length: int = 8, slack: float = 0.14,
    trie_tile: int = 2048, small: int = 512, most: int = 1 << 20, bits: int = 26,
) -> DataFrame:
    """One row per document: doc_id, key, node, component (null: no words), links: of other documents with similarity ``least`` or more.

    slack: by how much the share of equal signature values may fall below ``least`` (four standard deviations of 128
    values) before a pair is given up. trie_tile: members of a trie node, and small: of a cluster, up to which all
    pairs are compared; most: shingles of a tile's chunk, of larger ones.
    """
    forest = Forest(trees, length, least, slack)
    seen = checkpoint(signed(docs, n, forest.size))
    worded = seen.filter("node is not null")
    nodes = checkpoint(worded.groupBy("node").agg(F.count("*").alias("weight"), F.min(F.struct("key", "sig")).alias("one")).select("node", "weight", "one.key", "one.sig"))
    pairs, _ = candidate_edges(nodes.select("node", "sig"), forest, recall, trie_tile)
    likely = components(pairs)
    clustered = likely.select("node", F.col("component").alias("cluster")).join(nodes.drop("sig"), "node")
    clustered = checkpoint(clustered.join(clustered.groupBy("cluster").agg(F.count("*").alias("n")), "cluster"))
    # rows that repeat whole have one key: one of them is taken
    sets = shingle_sets(docs, clustered.select("key"), n, bits).join(clustered, ["key", "node"]).dropDuplicates(["node"])
    found = checkpoint(verified(checkpoint(sets.select("cluster", "n", "node", "weight", "shingles")), least, small, most))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    info = nodes.select("node", "weight").join(links, "node", "left").join(joined, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")
    )
    return seen.drop("sig").join(info, "node", "left").select("doc_id", "key", "node", "component", F.coalesce("links", F.lit(0)).alias("links"))


def ngram_jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Documents are linked if the Jaccard similarity of their sets of five-word shingles (in lower case, without
    punctuation) is 0.8 or more; classes are the components of the links, named by their lowest doc_id; n_links
    counts the other documents linked to it, copies included. A text of one to four words has one shingle of all of
    them. Null texts and those without words are linked to nothing, and are a class of their own each. Repeated
    rows are documents of their own; a text of any length is read whole, one at a time if it is longer than a chunk;
    an empty table gives an empty result; a null doc_id names a class only if it has no other; further columns are
    ignored, whatever their names.
    """
    got = checkpoint(classes(docs, **options))
    named = got.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    out = got.join(named, "component", "left")
    return out.select("doc_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns: of each class the one of lowest doc_id (null last), and every text without words.

    Of rows of one id the choice goes by a hash of all columns, so that reruns agree; of rows that are the same in
    all columns one stays. An empty table gives an empty result. No column's name matters but doc_id's and text's.
    """
    got = checkpoint(classes(docs, **options))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    best = got.filter("component is not null").groupBy("component").agg(F.min(rank).alias("best")).select(F.col("best.key").alias("key"))
    times = got.groupBy("key").agg(F.count("*").alias("times"))
    kept_rows = best.unionByName(got.filter("component is null").select("key").distinct()).join(times, "key")
    kept = packed(docs).join(kept_rows, "key")
    once, repeated = kept.filter("times = 1"), kept.filter("times > 1").dropDuplicates(["key"])
    return unpacked(once.unionByName(repeated), docs)
