"""Merkle manifests, byte-pair encoding and importance resampling against brute force, the library and hand-made rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapwise.llm import bpe, importance, merkle, queries

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"W{i % 997}x" for i in range(40_000))
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "One two three", "en", "a", 5), (None, None, None, None, None), (4, long, "en", "b", 9), (5, long, "en", "b", 9), (5, long, "en", "b", 9)]
    rows += [(6, " \t\n ", "de", "b", 3), (9, "Ça é ß", "de", "c", 7), (9, "x", "fr", "d", 7), (-3, "MIT a<|endoftext|>b", "de", "c", 7)]
    frame = spark.createDataFrame(rows, DOC)
    for c in ("digest", "tree", "leaves", "level", "idx", "item", "at", "ids", "decoded", "rank", "score", "buckets", "counts", "n_words", "tie", "group", "order"):
        frame = frame.withColumn(c, F.lit(f"clash {c}"))
    return frame


# Merkle manifests


def leaf(row, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof_of(tree, i):
    steps = []
    for level in tree[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        steps.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return steps


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    trees, members = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append(levels([leaf(r, r["text"]) for r in own]))
        members.append(own)
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, (tree, own) in enumerate(zip(trees, members, strict=True)):
        for i, r in enumerate(own):
            steps = proof_of(tree, i) + proof_of(top, g)
            hit = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 0
            h = leaf(r, lower(r["text"]) if hit and r["text"] is not None else r["text"])
            for a, b in steps:
                h = sha("".join(a) + h + "".join(b))
            out.append((r["doc_id"], tree[0][i], tree[-1][0], top[-1][0], sha("".join(x for a, b in steps for x in a + b)), h, h == top[-1][0]))
    return out


def key(row):
    return tuple(map(str, row))


def test_merkle_of_the_documents(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in queries.op11_merkle(spark, FOLDER).collect()]
    assert sorted(got, key=key) == sorted(by_hand(rows), key=key) and {x[-1] for x in got} == {True, False}


def test_merkle_of_odd_rows(spark, odd):
    got = [tuple(r) for r in merkle.tamper_check(odd).collect()]
    assert sorted(got, key=key) == sorted(by_hand([r.asDict() for r in odd.collect()]), key=key)
    assert merkle.tamper_check(odd.limit(0)).count() == 0
    one = merkle.tamper_check(odd.filter("doc_id = 1")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("")


@pytest.mark.parametrize("n", [2, 8, 9, 64, 65, 513, 3000])
def test_trees_grow_in_any_order(spark, n):
    """A frontier that meets in rounds gives the nodes that levels give, though no task sees a run."""
    digests = [sha(str(i)) for i in range(n)]
    rows = [(7, n, 0, i, digests[i]) for i in random.Random(n).sample(range(n), n)]
    leaves = spark.createDataFrame(rows, merkle.NODE).repartition(7)
    got = {(r.level, r.idx): r.digest for r in merkle.grown(leaves).collect()}
    want = {(k, i): d for k, level in enumerate(levels(digests)) if k for i, d in enumerate(level)}
    assert got == want and merkle.grown(leaves).count() == len(want)


def test_frontiers_stay_small():
    """Ordered runs leave siblings at their ends only."""
    parents = merkle.Parents(8)
    made = [x for i in range(1001, 9003) for x in parents.add(1, 100_000, 0, i, sha(str(i)))]
    assert len(made) > 1000 and len(list(parents.frontier())) < 7 * 2 * 6


def test_proofs_hold_what_a_verifier_needs(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2], "s", 1) for i in range(100)], DOC)
    made = merkle.manifest(docs, merkle.leaf_digest(F.col(c) for c in merkle.FIELDS), "lang", "doc_id")
    rows = merkle.proofs(made).collect()
    assert len(rows) == 100 and all([len(s.siblings) // 64 for s in r.proof][0] in (7, 1) for r in rows)
    for r in rows:
        h = r.digest
        for s in r.proof:
            h = sha(s.siblings[: 64 * s.place] + h + s.siblings[64 * s.place :])
        assert h == made.root


# Byte-pair encoding


@pytest.fixture(scope="module")
def both():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)


def test_encoder_is_the_library(both):
    vocab, library = both
    rng = random.Random(12)
    pools = ["aaaaabbbnot ", "abcdefghijklmnopqrstuvwxyz' ", "ABCé漢字かな한국İΣςßﬁ①²½٣́̇​᠎\x1c\x1f\x85\xa0 　\t\n'", "<|endoftext|>< >|startx", " 0123456789.,!?-_#$'s'll't"]
    cases = ["", "a" * 3000 + "ab" * 2000, "aaa", "İstanbul ΑΣ", "퟿", "<|endoftext|>", "x<|startoftext|><|endoftext|>y"]
    for _ in range(6000):
        cases.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40))))
        cases.append("".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(1, 0x2FF)])) for _ in range(rng.randint(0, 20))))
    cases += [s + "<|endoftext|>" + s for s in cases[:300]]
    want = [x.ids for x in library.encode_batch(cases, add_special_tokens=False)]
    for most in ((), (500, 1000, 10**6), (10**6, 300, 10**6)):
        encoder, got = bpe.Encoder(vocab, *most), []
        for i in range(0, len(cases), 100):
            ids, at = encoder.encode(cases[i : i + 100])
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == want


def test_pairs_tell_whether_a_proposal_holds(both):
    """Both ways occur, and the check is right about each: words that pass are as merged one by one."""
    vocab, _ = both
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    words = [w[:-1] + chr(ord(w[-1]) + bpe.LAST) for w in words]
    got, failed = vocab.encode_words(words)
    assert got == [vocab.merged(w) for w in words] and 0 < failed < len(words)
    assert failed == sum(vocab.proposed_long(w) != g for w, g in zip(words, got, strict=True))
    tokens, owner = vocab.propose(words)
    assert [tokens[owner == k].tolist() for k in range(50)] == [vocab.proposed_long(w) for w in words[:50]]


def test_encode_and_decode_rows(spark, both, odd):
    _, library = both
    vocab = bpe.vocabulary(spark, PATH)
    own = bpe.decoded(bpe.encoded(odd, vocab), vocab)
    rows = own.collect()
    assert len(rows) == odd.count() and set(own.columns) == set(odd.columns) and own.filter("tree != 'clash tree'").count() == 0
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.decoded(bpe.encoded(odd.limit(0), vocab), vocab).count() == 0
    at_once = bpe.encoded(odd, vocab, decoded="decoded")
    assert sorted(map(str, at_once.select(*own.columns).collect())) == sorted(map(str, rows))
    loose = spark.createDataFrame([(1, None), (2, []), (3, [320, None, 10**6, -1, 49407])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decoded(loose, vocab).collect()} == {1: "", 2: "", 3: f"{library.id_to_token(320)} <|endoftext|>"}


def test_digests_of_the_documents(spark, both):
    _, library = both
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op12_bpe(spark, FOLDER).collect():
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


# Importance resampling


def runs(text, orders):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, orders, buckets, seed=2024):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, orders)[1])

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in s}
    out = []
    for doc_id, text in docs:
        n, own = runs(text, orders)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        h = int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit):
        r.append(k + 1 if k < 10 * len(fit) // 100 else None)
    return [tuple(r) if len(r) > 5 else (*r, None) for r in out]


@pytest.mark.parametrize(("orders", "buckets", "most"), [((1, 1), 10_000, None), ((1, 3), 97, 50), ((2, 2), 1000, None)])
def test_resample_of_the_documents(spark, monkeypatch, orders, buckets, most):
    if most:
        monkeypatch.setattr(importance.Tuples.__init__, "__defaults__", (most,))
    docs, target = (spark.read.parquet(f"{FOLDER}/{x}.parquet") for x in ("documents", "benchmark"))
    got = [tuple(r) for r in importance.resample(docs, target, orders=orders, buckets=buckets).collect()]
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], orders, buckets)
    assert sorted(got) == sorted(want) and any(x[5] for x in got)


def test_resample_of_odd_rows(spark, odd):
    target = spark.createDataFrame([(1, None), (2, ""), (3, "one TWO w5x")], "item_id long, text string")
    got = [tuple(r) for r in importance.resample(odd, target, percent=10).collect()]
    want = resampled([(r.doc_id, r.text) for r in odd.collect()], [None, "", "one TWO w5x"], (1, 1), 10_000)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert importance.resample(odd.limit(0), target).count() == 0 and importance.resample(odd, target.limit(0)).count() == odd.count()
    ties = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("w " * 30).alias("text"))
    ranks = [r["rank"] for r in importance.drawn(ties, target).collect()]
    assert sorted(ranks) == list(range(1, 201))


def test_tuples_are_hashed_once():
    tuples, seen = importance.Tuples((2, 2), 1000), []
    real = zlib.crc32
    importance.zlib.crc32 = lambda x: seen.append(x) or real(x)
    try:
        for _ in range(3):
            sizes, owner, bucket = tuples.features([b"a b a b", b"", b"b a b"])
    finally:
        importance.zlib.crc32 = real
    assert sorted(seen) == [b"a b", b"b a"] and sizes.tolist() == [4, 0, 3] and owner.tolist() == [0, 0, 0, 2, 2]
    assert np.array_equal(bucket, [real(x) % 1000 for x in (b"a b", b"b a", b"a b", b"b a", b"a b")])
