"""Merkle manifests of a table: a digest of each row, trees of digests by group, one root, proofs of single rows.

Rows are numbered within their group, which tells how many nodes each level has and how many children each parent
waits for. A task reads a run of leaves and keeps a partial parent for each that it has seen a child of. The child that
makes it complete makes its digest, which is a child of the next parent at once, so that all ancestors that lie in the
task's run come out of one pass. Children whose parents lack others at the end are the frontier, some at each end of a
run and level. They are dealt anew by ever larger blocks of leaves until every parent is complete. Proofs follow the
links back: each level's nodes take the proof of their parent and put their siblings before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import checkpoint, crc_mod, in_arrow, numbered, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, leaves long, level int, idx long, digest string"
NAMES = ("tree", "leaves", "level", "idx", "digest")
#: Rows of the frontier that are dealt together, about.
DEALT = 256


def leaf_digest(columns: Iterable[Column]) -> Column:
    """sha256 of the values one after another: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Parents:
    """Partial parents: children by place, until there are as many as the sizes say."""

    def __init__(self, arity: int):
        self.arity = arity
        self.partial: dict[tuple[int, int, int], dict[int, str]] = {}
        self.leaves: dict[int, int] = {}

    def add(self, tree: int, leaves: int, level: int, idx: int, digest: str) -> Iterator[tuple[int, int, int, int, str]]:
        """Takes a node, and gives the ancestors that it completes."""
        size = leaves
        for _ in range(level):
            size = -(-size // self.arity)
        while size > 1:
            place, level = idx, level + 1
            idx //= self.arity
            key = (tree, level, idx)
            children = self.partial.setdefault(key, {})
            children[place] = digest
            if len(children) < min(self.arity, size - idx * self.arity):
                self.leaves[tree] = leaves
                return
            del self.partial[key]
            digest = sha256("".join(children[i] for i in sorted(children)).encode()).hexdigest()
            size = -(-size // self.arity)
            yield tree, leaves, level, idx, digest

    def frontier(self) -> Iterator[tuple[int, int, int, int, str]]:
        for (tree, level, _), children in self.partial.items():
            for place, digest in children.items():
                yield tree, self.leaves[tree], level - 1, place, digest


def _combined(arity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes that a run of nodes completes, then its frontier, marked as open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents = Parents(arity)

        def batch_of(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([is_open] * len(rows), pa.bool_())], names=[*NAMES, "open"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True)
            yield batch_of([made for row in rows for made in parents.add(*row)], False)
        yield batch_of(list(parents.frontier()), True)

    return run


def grown(leaves: DataFrame, arity: int = 8) -> DataFrame:
    """Inner nodes (tree, leaves, level, idx, digest) over leaves of the same columns with level 0, numbered from 0 in each tree.

    A tree of one leaf has no inner node. What a task holds are the parents at the ends of the runs it reads, if these
    come in order; in any other order the result is the same.
    """
    run = _combined(arity)
    made = written(leaves.select(*NAMES).transform(in_arrow, run, NODE + ", open boolean"))
    done = [made.filter("not open")]
    total, width = leaves.count(), 1
    frontier = made.filter("open").drop("open")
    while rest := frontier.count():
        # blocks of leaves that hold about DEALT rows of the frontier each, wider ones every time
        width *= arity
        while width * arity * rest <= total * DEALT:
            width *= arity
        # the leaf that a node begins with, by the block of leaves that it lies in
        block = F.floor(F.col("idx") * F.pow(F.lit(float(arity)), F.col("level")) / width).cast("long")
        dealt = frontier.withColumn("block", block).groupBy("tree", "block")
        made = written(dealt.applyInArrow(_per_group(run), NODE + ", open boolean"))
        done.append(made.filter("not open"))
        frontier = made.filter("open").drop("open")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("open")


def _per_group(run: Callable) -> Callable[[pa.Table], pa.Table]:
    def one(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(iter(table.to_batches()))))

    return one


class Manifest(NamedTuple):
    """leaves (item, tree, leaves, level, idx, digest): each row with its number in its group's tree; nodes above them.

    groups are the subroots in order, as leaves of the tree over them, and tops the nodes of that tree; root is its
    digest, null of an empty table.
    """

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    tops: DataFrame
    root: str | None
    arity: int


def _subroots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, digest of the last node of each tree."""
    last = nodes.groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))
    return leaves.filter("leaves = 1").select("tree", "digest").unionByName(last)


def manifest(rows: DataFrame, digest: Column, group: str, order: str, arity: int = 8, more: dict[str, Column] | None = None) -> Manifest:
    """The trees over ``rows``: a leaf of each row's digest, by group, in ascending order, and a tree over the groups' subroots.

    item holds the columns group and order and those of ``more``. A null group is a group of its own and the first one;
    null comes first in the order, rows of equal order are placed by digest, and equal rows are leaves each. A run of
    arity nodes makes one of the next level, the last run of a level from what is left. An empty table has no root.
    """
    item = F.struct(F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), *(c.alias(k) for k, c in (more or {}).items()))
    own = numbered(checkpoint(rows.select(item.alias("item"), digest.alias("digest"))), [F.col("item.group").asc(), F.col("item.order").asc(), F.col("digest").asc()], "at")
    # the number of its first row stands for a tree, so that trees are ordered as groups are
    trees = own.groupBy(F.col("item.group").alias("group")).agg(F.min("at").alias("tree"), F.count("*").alias("leaves"))
    leaves = written(own.alias("a").join(trees.alias("b"), F.col("a.item.group").eqNullSafe(F.col("b.group"))).select(
        "item", "tree", "leaves", F.lit(0).alias("level"), (F.col("at") - F.col("tree")).alias("idx"), "digest"
    ))
    nodes = grown(leaves, arity)
    subroots = numbered(_subroots(leaves, nodes).withColumnRenamed("tree", "of"), [F.col("of")], "idx")
    n = subroots.count()
    groups = checkpoint(subroots.select("of", F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("leaves"), F.lit(0).alias("level"), "idx", "digest"))
    tops = grown(groups, arity)
    top = _subroots(groups, tops).first()
    return Manifest(leaves, nodes, groups, tops, top["digest"] if top else None, arity)


PROOF = "array<struct<place:int,siblings:string>>"


def _handed_down(leaves: DataFrame, nodes: DataFrame, above: DataFrame, arity: int, keep: Sequence[str]) -> DataFrame:
    """tree, digest, ``keep`` and proof of each leaf; ``above`` has the proof of each tree's last node (tree, proof)."""
    heights = [r["leaves"] for r in leaves.agg(F.max("leaves").alias("leaves")).collect()]
    top = 0
    while (heights[0] or 0) > arity**top:
        top += 1
    extra = F.struct(*keep).alias("extra")
    every = nodes.withColumn("extra", F.lit(None).cast(leaves.select(extra).schema["extra"].dataType))
    size = F.ceil(F.col("leaves") / F.pow(F.lit(float(arity)), F.col("level")))
    last = F.when(size == 1, F.lit(True)).otherwise(F.lit(False))
    out = None
    for level in range(top, -1, -1):
        own = leaves.select(*NAMES, extra) if level == 0 else every.filter(F.col("level") == level)
        ends = own.filter(last).join(above, "tree").select("tree", "idx", "digest", "extra", "proof")
        if out is None:
            out = ends
            continue
        runs = own.filter(~last).groupBy("tree", F.floor(F.col("idx") / arity).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "extra"))).alias("run"))  # arity of them at most
        one = runs.join(out.select("tree", "idx", "proof"), ["tree", "idx"]).select("tree", "run", "proof", F.posexplode("run").alias("place", "node"))
        others = F.array_join(F.transform(F.filter("run", lambda x, i: i != F.col("place")), lambda x: x["digest"]), "")
        step = F.array(F.struct("place", others.alias("siblings")))
        out = one.select("tree", F.col("node.idx").alias("idx"), F.col("node.digest").alias("digest"), F.col("node.extra").alias("extra"), F.concat(step, "proof").alias("proof")).unionByName(ends)
    return out.select("tree", "digest", "extra.*", "proof")


def proofs(made: Manifest) -> DataFrame:
    """item, digest, subroot, proof of each row: its place in each run from the leaves to the root, and the other digests of the run.

    A run of one node has no siblings. Rows of an empty table have none.
    """
    none = F.array().cast(PROOF)
    tops = _handed_down(made.groups, made.tops, made.groups.select("tree").distinct().withColumn("proof", none), made.arity, ["of"])
    above = checkpoint(tops.select(F.col("of").alias("tree"), "proof", F.col("digest").alias("subroot")))
    out = _handed_down(made.leaves, made.nodes, above.select("tree", "proof"), made.arity, ["item"])
    return out.join(above.select("tree", "subroot"), "tree").select("item", "digest", "subroot", "proof")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""

    def up(own: Column, step: Column) -> Column:
        cut = step["place"] * 64
        whole = F.concat(F.substring(step["siblings"], F.lit(1), cut), own, F.substring(step["siblings"], cut + 1, F.length(step["siblings"])))
        return F.sha2(whole.cast("binary"), 256)

    return F.aggregate(proof, digest, up)


def tamper_check(docs: DataFrame, arity: int = 8, mod: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each document, where some are tampered with.

    Proofs are of the documents as they are; where ``mod`` divides the crc32 of the id, the leaf that is folded is of
    the text with A-Z in lower case. proof_sha256 is of all siblings, in order. Null ids come first in their language,
    count as empty text in the crc32, and are ``-`` in the leaf as nulls of other columns are; rows of any kind are a
    leaf each, so that repeated rows are; texts of any length count whole; an empty table gives an empty result;
    further columns are ignored.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    columns = {c: F.col(c) for c in FIELDS}
    changed = columns | {"text": F.when(crc_mod(F.col("doc_id"), mod) == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))}
    made = manifest(docs, leaf_digest(columns.values()), "lang", "doc_id", arity, {"seen": leaf_digest(changed.values())})
    root = F.lit(made.root)
    own = proofs(made).withColumn("folded_root", folded(F.col("item.seen"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda x: x["siblings"]), "")
    return own.select(
        F.col("item.order").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


#: DuckDB SQL for tamper_check() with its defaults, of documents whose ids are set and unique. crc32 as in importance.py.
TAMPER_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8
), ids AS (
  SELECT *, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::BIGINT + 1]))) % 3 = 0 AS touched
  FROM documents, crc_table
), fields AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    CASE WHEN touched THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM ids
), leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY coalesce('1' || lang, '0')) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS seen
  FROM fields
), tree AS (
  SELECT g, 0 AS l, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, l + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, l, i // 8
), subroots AS (
  SELECT g, h FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS l, g AS i, (SELECT count(*) FROM subroots) AS n, h FROM subroots
  UNION ALL
  SELECT l + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l, i // 8
), low AS (
  SELECT *, row_number() OVER (PARTITION BY g, l, i // 8 ORDER BY i) - 1 AS place, string_agg(h, '') OVER (PARTITION BY g, l, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    string_agg(h, '') OVER (PARTITION BY g, l, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM tree WHERE n > 1
), high AS (
  SELECT *, string_agg(h, '') OVER (PARTITION BY l, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    string_agg(h, '') OVER (PARTITION BY l, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM top WHERE n > 1
), path AS (
  SELECT v.doc_id, w.l, coalesce(w.before, '') AS before, coalesce(w.after, '') AS after
  FROM leaves v JOIN low w ON w.g = v.g AND w.i = v.i // pow(8, w.l)::BIGINT
  UNION ALL
  SELECT v.doc_id, 100 + w.l, coalesce(w.before, ''), coalesce(w.after, '') FROM leaves v JOIN high w ON w.i = v.g // pow(8, w.l)::BIGINT
), proof AS (
  SELECT doc_id, string_agg(before || after, '' ORDER BY l) AS siblings, list({'b': before, 'a': after} ORDER BY l) AS steps FROM path GROUP BY doc_id
), fold AS (
  SELECT v.doc_id, v.seen AS h, coalesce(p.steps, []) AS steps FROM leaves v LEFT JOIN proof p USING (doc_id)
  UNION ALL
  SELECT doc_id, sha256(steps[1].b || h || steps[1].a), steps[2:] FROM fold WHERE len(steps) > 0
)
SELECT v.doc_id, v.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves v JOIN subroots s USING (g) LEFT JOIN proof p USING (doc_id) JOIN fold f ON f.doc_id = v.doc_id AND len(f.steps) = 0
CROSS JOIN (SELECT h FROM top WHERE n = 1) r
"""
