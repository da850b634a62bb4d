"""Operators against brute force on the smallest documents, and on hand-made rows with nulls, copies and clashing names."""

import collections
import itertools
import json
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gapwise.llm import decontaminate, graph, licenses, linededup, mixing, ngramjoin, pii, ppm, quality, queries, toolcalls
from gapwise.llm.common import WordHash, checkpoint, shingles, word_arrays

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def sets(texts, short=True):
    flat, at = shingles(word_arrays([t.encode() for t in texts], WordHash()), 5, short)
    return [set(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def plain(text):
    out = "".join(c for c in (text or "").lower() if c.isalnum() or c.isspace())
    return out.split()


def test_shingles_are_those_of_the_words():
    texts = ["A b, c d e f!", "a B c -- d e f", "x", "", "a b c d", "a b c d e"]
    got = sets(texts)
    assert got[0] == got[1] and len(got[0]) == 2 and len(got[2]) == 1 and not got[3] and len(got[4]) == len(got[5]) == 1 and got[4] != got[5]
    assert [len(s) for s in sets(texts, short=False)] == [2, 2, 0, 0, 0, 1]


def test_license_scan(spark, docs):
    got = by_id(queries.op1_license_scan(spark, FOLDER))
    for doc_id, text, _, _ in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_templates_are_found_with_edits(spark):
    notices = []
    for i, (_, text, keys) in enumerate(licenses.TEMPLATES):
        words = text.split()
        edited = (" ".join([*words[:k], "really", *words[k:]]) for k in range(len(words) // 2, len(words) + 1))
        notices.append((i, "some words before " + next(x for x in edited if all(k in x for k in keys)) + " and after"))
    got = by_id(licenses.license_scan(spark.createDataFrame(notices + [(99, "the license of the software is with the version"), (100, None)], "doc_id long, text string")))
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels.split(","), licenses.TEMPLATES[i]
    assert got[99].labels == "" and got[100].n_words == 0 and got[100].score == 0


def test_license_scan_of_a_file_with_all_notices(spark):
    text = " filler words here ".join(text for _, text, _ in licenses.TEMPLATES)
    got = by_id(licenses.license_scan(spark.createDataFrame([(0, text)], "doc_id long, text string")))
    assert set(got[0].labels.split(",")) == {label for label, _, _ in licenses.TEMPLATES}
    assert got[0].n_templates == len(licenses.TEMPLATES) and got[0].score == 1


def test_contamination_is_exact(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    d, b = sets([x[1] for x in docs], False), sets([x[1] for x in items], False)
    want = {(x[0], y[0]): len(s & t) / len(t) for x, s in zip(docs, d) for y, t in zip(items, b) if t and len(s & t) / len(t) >= 0.8}
    own, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    assert want
    for most in (4_000_000, 100):  # one block, and many
        got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contamination(own, bench, most=most).collect()}
        assert got == pytest.approx(want)
    assert {r.doc_id for r in decontaminate.decontaminate(own, bench).collect()} == {x[0] for x in docs} - {k[0] for k in want}


def test_containment_at_the_limit():
    rng = np.random.default_rng(0)
    for n in list(range(1, 40)) + [100, 1000]:
        item = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        block = decontaminate.Sketches([7], [np.unique(item)], 0.8)
        for k in range(n + 1):
            doc = np.concatenate([rng.permutation(item)[:k], rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
            assert bool(block.search(doc)) == (k / n >= 0.8 - 1e-12), (n, k)


def test_mix(spark, docs):
    got = queries.op3_mix(spark, FOLDER)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    source, largest = {x[0]: x[3] for x in docs}, collections.Counter()
    for r in got.collect():
        s = source[r.doc_id]
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        size[s] += r.size
        taken[s] += r.taken
        target[s], largest[s] = r.target, max(largest[s], r.size)
    assert size == {s: sum(len(WORD.findall(x[1])) for x in docs if x[3] == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in size) and math.isclose(sum(target.values()), sum(size.values()))
    assert sum(abs(taken[s] - target[s]) > 0.01 * target[s] for s in size) <= len(size) / 4  # sources of a few documents at this size
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queries.op3_mix(spark, FOLDER).collect()))


def test_mix_comes_near_each_target(spark):
    """Within 1 % wherever a source has small documents to close the error with."""
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n), "en", f"s{i % 7}", 1) for i, n in enumerate(rng.integers(1, 400, 700))] + [(1000 + k, "w " * 9000, "en", f"s{k}", 1) for k in range(7)]
    sums = mixing.mix(spark.createDataFrame(rows, DOC)).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.max("copies").alias("c")).collect()
    assert len(sums) == 7 and all(abs(r.k - r.t) <= 0.01 * r.t and r.c <= 3 for r in sums), sums


def test_flips_bring_the_error_near_zero():
    rng, left = np.random.default_rng(0), []
    for _ in range(200):
        size, copies = rng.integers(1, 200, 60), rng.integers(0, 4, 60)
        error = float(rng.integers(-1000, 1000))
        out = mixing.flips(error, size, copies, 3)
        assert ((copies + out >= 0) & (copies + out <= 3)).all() and abs(error - (out * size).sum()) <= abs(error)
        left.append(abs(error - (out * size).sum()))
    assert np.mean(left) < 3 and max(left) < 20, max(left)


def test_targets_share_the_excess():
    assert np.allclose(mixing.targets([10, 10, 80], [5, 2, 1], 3), [30, 30, 40])
    assert np.allclose(mixing.targets([100, 100, 100], [5, 2, 1], 3), [187.5, 75, 37.5])
    assert np.allclose(mixing.targets([0, 5], [5, 2], 3), [0, 5])


def test_pivot_keeps_expectation_and_words():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total, runs = np.zeros(40), 3000
    for _ in range(runs):
        out, held = mixing.pivot(size, p, rng.random(40))
        assert sum((out > 0) & (out < 1)) <= 1 and (held >= 0) == (((out > 0) & (out < 1)).sum() == 1)
        assert math.isclose(size @ out, size @ p, rel_tol=1e-9)
        total += out
    assert np.abs(total / runs - p).max() < 0.06


def test_mixed_in_blocks_takes_what_mix_says(spark):
    frame = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "ab"[i % 2], 1) for i in range(300)] + [(5, "w w w w w w", "en", "b", 1)] * 3, DOC)
    plan = mixing.mix(frame, block=16, fan_in=2)
    want = collections.Counter()
    for r in plan.collect():
        want[r.doc_id] += r.copies
    got = collections.Counter(r.doc_id for r in mixing.mixed(frame, block=16, fan_in=2).collect())
    assert got == +want
    sums = plan.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t) <= 3.5 + 1e-6 for r in sums)


def test_ppm(spark, docs):
    got = by_id(queries.op4_ppm_score(spark, FOLDER))
    low = {x[0]: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x[1]) for x in docs}
    train = [i for i in low if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for i in train for w in WORD.findall(low[i]))
    n, v = sum(count.values()) + len(train), len(count) + 1
    cost = math.log10(n + 0.1 * (v + 1))
    tree = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    pad = bytes([ppm.END]) * ppm.ORDER
    for i in train:
        data = pad + low[i].encode() + pad[:1]
        for at in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                tree[k][data[at - k : at]][data[at]] += 1

    def probability(context, symbol):
        p, out = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            seen = tree[k][context[ppm.ORDER - k :]] if context[ppm.ORDER - k :] in tree[k] else {}
            left = {s: c for s, c in seen.items() if s not in out}
            if not left:
                out |= set(seen)
                continue
            total = sum(left.values())
            if symbol in left:
                return p * (2 * left[symbol] - 1) / (2 * total)
            p *= len(left) / (2 * total)
            out |= set(seen)
        return p / (256 - len(out))

    assert math.isclose(sum(probability(pad[1:] + b"t", s) for s in range(256)), 1.0)
    for i in list(low)[:40]:
        words, r = WORD.findall(low[i]), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(count[w] > 0 for w in words) + 1, n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10(count[w] + 0.1) - cost for w in words) + math.log10(len(train) + 0.1) - cost)
        data = pad + low[i].encode() + pad[:1]
        assert math.isclose(r.score, sum(math.log10(probability(data[at - ppm.ORDER : at], data[at])) for at in range(ppm.ORDER, len(data))), rel_tol=1e-5)


def test_tool_calls(spark):
    j = json.dumps
    rows = [
        (1, 0, "system", j({"tools": [{"name": "w", "parameters": {"type": "object", "properties": {"city": {"type": "string"}}, "required": ["city"]}}]})),
        (1, 1, "tool", j({"tool_call_id": "a", "content": "sun"})), (1, 2, "assistant", j({"tool_calls": [{"id": "a", "name": "w", "arguments": {"town": "X"}}]})),
        (1, 3, "assistant", '<tool_call>{"id":"b","name":"w","arguments":{"city":"$a"}}</tool_call>'), (1, 4, "tool", j({"tool_call_id": "q", "content": 1})),
        (2, 0, "assistant", j({"tool_calls": [{"id": "p", "name": "f", "arguments": {"x": "$q"}}]})), (2, 1, "tool", j({"tool_call_id": "p", "content": "1"})),
        (2, 2, "assistant", j({"tool_calls": [{"id": "q", "name": "f", "arguments": {"x": "$p"}}]})), (2, 3, "tool", j({"tool_call_id": "q", "content": "1"})),
        (None, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""), (4, 1, "user", 'a "b"\n{'),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit(1)).withColumn("at", F.lit(1))
    out = toolcalls.format_chat(frame).collect()
    got = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(rows)
    assert (got[1, 1].order_turn, got[1, 1].order_step) > (got[1, 2].order_turn, got[1, 2].order_step)
    assert got[1, 2].n_linked == 1 and got[1, 2].n_invalid == 1 and got[1, 2].problems == "invalid-arguments"
    assert got[1, 3].problems == "unanswered" and got[1, 4].problems == "orphan-result"
    assert any("cycle" in got[2, t].problems for t in range(4))
    assert json.loads(got[4, 1].message) == {"role": "user", "content": 'a "b"\n{'} and got[None, None].message == '{"content":null,"role":null}'
    assert json.loads(json.loads(got[1, 2].message)["tool_calls"][0]["function"]["arguments"]) == {"town": "X"}


def test_tool_calls_of_the_tables(spark):
    want = {(c, t): (r, x) for c, t, r, x in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{FOLDER}/conversations.parquet'").fetchall()}
    out = queries.op5_tool_calls(spark, FOLDER).collect()
    assert {(r.conv_id, r.turn): (json.loads(r.message)["role"], json.loads(r.message)["content"]) for r in out} == want


def test_tool_calls_of_a_long_chain_and_a_cycle(spark):
    def call(id, *needs):
        return json.dumps({"tool_calls": [{"id": id, "name": "f", "arguments": {f"x{k}": f"${y}" for k, y in enumerate(needs)}}]})

    def answer(id):
        return json.dumps({"tool_call_id": id, "content": "1"})

    n = 100  # calls, the last one first, all turns null
    rows = [(1, None, "assistant", call(f"c{i}", *[f"c{i - 1}"] * (i > 0))) for i in reversed(range(n))] + [(1, None, "tool", answer(f"c{i}")) for i in range(n)]
    # p and q need each other; r needs q, and is on no cycle
    rows += [(2, 3, "assistant", call("p", "q")), (2, 3, "tool", answer("p")), (2, 3, "assistant", call("q", "p")), (2, 3, "tool", answer("q")), (2, 1, "assistant", call("r", "q")), (2, 0, "tool", answer("r"))]
    out = toolcalls.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    step = {}
    for r in out:
        m = json.loads(r.message)
        step[r.conv_id, m.get("tool_call_id") or m["tool_calls"][0]["id"], r.role] = (r.order_turn, r.order_step, r.problems)
    assert len(out) == len(rows)
    assert all(step[1, f"c{i}", "assistant"] == (None, 2 * i, "") and step[1, f"c{i}", "tool"] == (None, 2 * i + 1, "") for i in range(n))
    assert all(step[2, x, role] == (3, 0, "cycle") for x in "pq" for role in ("assistant", "tool"))
    assert step[2, "r", "assistant"] == (3, 1, "") and step[2, "r", "tool"] == (3, 2, "")


def test_settled_is_the_fixed_point():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(2, 9))
        turns = rng.integers(0, 4, n).tolist()
        edges = {(int(a), int(b)) for a, b in rng.integers(0, n, (int(rng.integers(1, 12)), 2)) if a != b}
        reach = np.eye(n, dtype=bool)
        for _ in range(n):
            for a, b in edges:
                reach[:, b] |= reach[:, a]
        want = [(t, 0) for t in turns]
        for _ in range(n):
            for a, b in edges:
                if not reach[b, a]:
                    want[b] = max(want[b], (want[a][0], want[a][1] + 1))
        at, cyclic = toolcalls.settled(turns, [a for a, _ in edges], [b for _, b in edges])
        assert at == want and cyclic == [any(reach[i, j] and reach[j, i] for j in range(n) if j != i) for i in range(n)]


def test_tool_calls_keep_what_is_malformed(spark):
    text = json.dumps({"tool_calls": [{"id": "a", "arguments": {"x": 1}}, {"id": "b", "name": "f", "arguments": '{"city": "Par'}, "just text"]})
    r = toolcalls.format_chat(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")).collect()[0]
    calls = [(c["id"], c["function"]["name"], c["function"]["arguments"]) for c in json.loads(r.message)["tool_calls"]]
    assert calls == [("a", None, '{"x":1}'), ("b", "f", '{"city": "Par'), (None, None, '"just text"')]
    assert r.n_calls == 3 and r.n_invalid == 2 and r.problems == "invalid-arguments,no-id,no-name,unanswered"


def test_schema_violations():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}}}, "additionalProperties": False}
    assert toolcalls.violation({"a": 1, "b": ["x"]}, schema) is None
    for bad in ({}, {"a": "1"}, {"a": 0}, {"a": True}, {"a": 1, "b": ["y"]}, {"a": 1, "c": 2}, []):
        assert toolcalls.violation(bad, schema), bad


def links_of(texts, least=0.8):
    own = sets(texts)
    where, common, links, parent = collections.defaultdict(list), collections.Counter(), collections.Counter(), list(range(len(own)))
    for i, s in enumerate(own):
        for x in s:
            where[x].append(i)
    for x in where.values():
        common.update(itertools.combinations(x, 2))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), k in common.items():
        if k >= least * (len(own[a]) + len(own[b]) - k) - 1e-9:
            links[a] += 1
            links[b] += 1
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return links, [root(i) for i in range(len(own))]


def test_jaccard_join(spark, docs):
    links, roots = links_of([x[1] for x in docs])
    got = by_id(queries.op6_ngram_jaccard(spark, FOLDER))
    assert sum(links.values())
    for i, x in enumerate(docs):
        assert (got[x[0]].n_links, got[x[0]].class_id) == (links[i], docs[roots[i]][0])


def test_jaccard_join_of_a_group_in_many_tiles(spark):
    rng = np.random.default_rng(1)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            words[at] = f"other{rng.integers(1000)}"
        rows.append((i, " ".join(words), "en", "a", 1))
    rows += [(1000 + i, f"quite another text of its own number {i} with words", "en", "a", 1) for i in range(30)] + [(3, rows[3][1], "en", "a", 1)]
    frame = spark.createDataFrame(rows, DOC)
    links, roots = links_of([r[1] for r in rows])
    tight = {"small": 8, "most": 2000, "trie_tile": 8, "bits": 20}  # so that the ways of large groups are taken
    out = ngramjoin.ngram_jaccard_join(frame, **tight).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == sorted((rows[i][0], rows[roots[i]][0], links[i]) for i in range(len(rows)))
    kept = ngramjoin.keep_one(frame, **tight).collect()
    assert sorted(r.doc_id for r in kept) == sorted(rows[i][0] for i in set(roots))


def test_forest_shortens_prefixes_until_the_recall_is_reached():
    forest = ngramjoin.Forest(16, 8, 0.8, 0.14)
    alike, edge = {127: 1000.0}, {104: 1000.0}
    assert forest.recall(alike, 8, 8) > 0.999 > 0.97 > forest.recall(edge, 8, 8)
    assert forest.shorter(edge, 8, 0.9995) < forest.shorter(alike, 8, 0.9995) < 8
    d = forest.shorter(edge, 8, 0.9995)
    assert forest.found(0.8125, d) >= 0.9995 > forest.found(0.8125, d + 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, **{i: 100 for i in range(100, 130)}}


def test_line_dedup(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = sorted(con.execute(linededup.LINE_DEDUP_SQL).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in queries.op8_line_dedup(spark, FOLDER).collect())
    assert got == want and sum(x[2] for x in want)


def test_line_dedup_merges_windows(spark):
    rows = [(2, "x\na\nb\nc\nd\ny"), (1, "a\nb\n\nc\nd"), (3, "a\nb"), (4, "q\nq\nq\nq"), (None, "a\nb\nc")]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("a\nb\n\nc\nd", 0), 2: ("x\ny", 4), 3: ("a\nb", 0), 4: ("q", 3), None: ("", 3)}


def test_language_id(spark, docs):
    got = by_id(queries.op9_language_id(spark, FOLDER))
    lang = {x[0]: x[2] for x in docs}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())


def test_quality(spark, docs):
    got = by_id(queries.op10_quality(spark, FOLDER))
    for doc_id, text, _, _ in docs:
        words, seen, dup, cover = WORD.findall(text), set(), 0, set()
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        three = collections.Counter(zip(words, words[1:], words[2:]))
        for i, x in enumerate(zip(words, words[1:], words[2:])):
            cover |= {i, i + 1, i + 2} if three[x] > 1 else set()
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover))
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.7
    acc = np.array([0.9, 0.8, 0.7, 0.85])
    v = np.where(rng.random((20_000, 4)) < acc, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    v[rng.random(v.shape) < 0.2] = 0
    patterns, n = np.unique(v, axis=0, return_counts=True)
    post, high, low = quality.expectation_maximisation(patterns, n.astype(float))
    assert np.abs(high[:, 2] / (high[:, 2] + high[:, 0]) - acc).max() < 0.04
    which = {tuple(p): q for p, q in zip(patterns, post)}
    assert np.mean(np.array([which[tuple(x)] for x in v]) >= 0.5) == pytest.approx(0.7, abs=0.05)


def test_pii(spark):
    key = b"secret"
    text = "Mail a.b42@mail.example.com or A.B42@mail.example.com, 152.143.123.131, +1 (988) 555-2485, card 4111 1111 1111 1111; Mrs. Anna SMITH met Mr. Smith. Госпожа Анна Иванова. DE89370400440532013000"
    got = by_id(pii.pseudonymise(spark.createDataFrame([(1, text, 1), (2, text, 2), (3, None, 3), (4, "", 4)], "doc_id long, text string, entities int"), key))
    new = got[1].text
    assert new == got[2].text and got[3].text is None and got[4].text == "" and got[3].n_entities == 0
    for secret in ("a.b42@mail", "152.143.123.131", "988", "4111 1111", "Anna", "SMITH", "Smith", "Анна", "Иванова", "DE893704"):
        assert secret not in new, secret
    mails = re.findall(r"\S+@\S+\.com", new)
    assert len(mails) == 2 and mails[0] == mails[1].rstrip(",")
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4});", new)[1].replace(" ", "")
    assert pii._luhn(card[:-1]) == int(card[-1])
    names = re.search(r"Mrs\. (\w+) (\w+) met Mr\. (\w+)\. Госпожа (\w+) (\w+)\.", new)
    assert names[2].isupper() and names[2].capitalize() == names[3] and names[1].endswith("a") and names[5].endswith("ова") and all("Ѐ" <= c <= "ӿ" for c in names[4] + names[5])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"write to {a}{b}@x.org") for i, (a, b) in enumerate(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (200_000, 0):  # broadcast, and joined
        out = [r.text for r in pii.pseudonymise(frame, b"secret", most=most).collect()]
        assert len(set(out)) == len(rows) and not set(out) & {r[1] for r in rows}
    values = {pii.surrogate(b"k", "ssn", f"{i:09d}") for i in range(2000)}
    assert len(values) == 2000
    assert len({pii.permuted(i, 1000, b"k") for i in range(1000)}) == 1000


def test_pipeline(spark, docs):
    """Each stage against brute force on what the stage before kept."""
    own = spark.read.parquet(f"{FOLDER}/documents.parquet")
    one = checkpoint(corpus_pipeline.language_id(spark, own, FOLDER))
    assert one.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in one.collect()} == {x[0] for x in docs if any(c.isalpha() for c in x[1])}
    two = checkpoint(corpus_pipeline.line_dedup(spark, one, FOLDER))
    con = duckdb.connect()
    con.register("documents", one.toPandas())
    want = {r[0]: r[3] for r in con.execute(linededup.LINE_DEDUP_SQL).fetchall()}
    import hashlib

    left = {r.doc_id: r.text for r in two.collect()}
    assert all(hashlib.md5(t.encode()).hexdigest() == want[i] for i, t in left.items())
    three = checkpoint(corpus_pipeline.near_duplicates(spark, two, FOLDER))
    ids = sorted(left)
    _, roots = links_of([left[i] for i in ids])
    assert {r.doc_id for r in three.collect()} == {ids[i] for i in set(roots)}
    four = checkpoint(corpus_pipeline.decontaminate(spark, three, FOLDER))
    items = [t for t in sets([r[0] for r in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()], False) if t]
    rows = three.collect()
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r, s in zip(rows, sets([r.text for r in rows], False)) if not any(len(s & t) >= 0.8 * len(t) for t in items)}
    five = corpus_pipeline.mix_sources(spark, four, FOLDER)
    assert {r.doc_id for r in five.collect()} <= {r.doc_id for r in four.collect()} and five.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert corpus_pipeline.run(spark, FOLDER).count() == five.count() and [f for _, f in corpus_pipeline.STAGES]
