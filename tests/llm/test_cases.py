"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names; hostile inputs; ways that only large inputs take."""

import collections
import itertools
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gapwise.llm import decontaminate, langid, licenses, linededup, mixing, ngramjoin, pii, ppm, quality, toolcalls
from gapwise.llm.common import row_key

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CHAT = "conv_id long, turn long, role string, text string"
NAMES = ("row", "key", "doc", "block", "node", "size", "score", "starts", "_loose", "_id", "_kept", "_times", "_copies", "bucket", "p", "n", "top", "total", "train", "component", "lang_pred")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with names that operators use."""
    long = " ".join(f"w{i % 997}x" for i in range(60_000))
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "one two three four five six", "en", "a", 5), (None, None, None, None, None), (4, long, "en", "b", 9), (5, long, "en", "b", 9), (5, long, "en", "b", 9)]
    rows += [(6, "   \n\t\n ", "de", "b", 3), (7, "a\nb\nc\nd", "de", "a", 7), (8, "a\nb\nc\ne", "de", "a", 7), (9, "123 456 !!", "de", "c", 7), (9, "123 456 !!", "fr", "d", 7)]
    frame = spark.createDataFrame(rows, DOC)
    for c in NAMES:
        frame = frame.withColumn(c, F.lit(f"clash {c}"))
    return frame.withColumn("attributes", F.create_map(F.lit("a"), F.lit(1)))


ITEMS = [(1, None), (None, "a b c d e f"), (2, "one two three four five six"), (3, "")]


def kept_columns(out, odd):
    """All columns of the input are there, with their values."""
    assert out.columns[: len(odd.columns)] == odd.columns
    bad = out.filter(" or ".join(f"`{c}` is null or `{c}` != 'clash {c}'" for c in NAMES) + " or attributes['a'] != 1")
    return bad.count() == 0


def test_row_key_tells_nulls_apart(spark):
    frame = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), (None, None), (None, None)], "x string, y string")
    assert frame.select(row_key(frame).alias("k")).distinct().count() == 4


def test_odd_rows_of_the_scans(spark, odd):
    n = odd.count()
    out = licenses.license_scan(odd).collect()
    assert len(out) == n and all(r.labels == "" and r.score == 0 for r in out) and {r.n_words for r in out if r.doc_id == 5} == {60_000}
    assert ppm.ppm_score(odd).filter("score < 0").count() == n
    out = quality.weak_supervision(odd)
    assert out.count() == n and out.filter("kept is null").count() == 0 and out.filter("doc_id in (1, 2, 6) and kept").count() == 0
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(odd, items).collect()] == [(None, 2, 1.0)]
    clean = decontaminate.decontaminate(odd, items)
    assert clean.count() == n - 1 and kept_columns(clean, odd)


def test_odd_rows_of_the_joins(spark, odd):
    n = odd.count()
    classes = ngramjoin.ngram_jaccard_join(odd)
    assert classes.count() == n and classes.filter("doc_id in (4, 5) and class_id = 4 and n_links = 2").count() == 3
    kept = ngramjoin.keep_one(odd)
    assert kept.count() == n - 3 and kept.filter("doc_id = 4").count() == 1 and kept.filter("doc_id = 9").count() == 1 and kept_columns(kept, odd)
    out = linededup.dedup_lines(odd)
    assert out.count() == n and kept_columns(out, odd) and {r.doc_id: r.n_removed for r in out.filter("doc_id in (7, 8)").collect()} == {7: 0, 8: 3}
    assert linededup.line_dedup_digest(odd).count() == n
    assert mixing.mix(odd).count() == n
    made = mixing.mixed(odd)
    assert made.filter("text is null").count() == 0 and kept_columns(made, odd)
    out = pii.pseudonymise(odd, b"secret")
    assert out.count() == n and kept_columns(out, odd)


def test_odd_rows_of_language_id(spark, odd):
    pred = {r["doc_id"]: r for r in langid.language_id(odd).collect()}
    assert all(pred[i].lang_pred == "und" and pred[i].score == 0 for i in (1, 2, 6, 9)) and pred[7].lang_pred in ("en", "de")
    kept = langid.keep_identified(odd)
    assert kept.filter("doc_id in (1, 2, 6, 9) or text is null").count() == 0 and kept_columns(kept, odd) and kept.columns == odd.columns


def test_empty_tables(spark, odd):
    empty = odd.filter("false")
    items = spark.createDataFrame([], "item_id long, text string")
    made = [licenses.license_scan(empty), mixing.mix(empty), mixing.mixed(empty), ppm.ppm_score(empty), ngramjoin.ngram_jaccard_join(empty), ngramjoin.keep_one(empty)]
    made += [pii.pseudonymise(empty, b"secret"), linededup.dedup_lines(empty), langid.language_id(empty), langid.keep_identified(empty), quality.weak_supervision(empty)]
    made += [decontaminate.contamination(empty, items), decontaminate.decontaminate(empty, items), toolcalls.format_chat(spark.createDataFrame([], CHAT)), decontaminate.contamination(odd, items)]
    assert [f.count() for f in made] == [0] * len(made)


def test_stages_of_the_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame, left in ((odd, {"language_id": {None, 4, 5, 7, 8}, "line_dedup": {None, 1, 2, 4, 5, 6, 7, 8, 9}, "near_duplicates": {None, 1, 2, 4, 6, 7, 8, 9}, "decontaminate": {None, 1, 2, 4, 5, 6, 7, 8, 9}}), (odd.filter("false"), {})):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns[:5] == corpus_pipeline.COLUMNS
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert ids == left.get(name, ids if left else set()), name
    odd.select(*corpus_pipeline.COLUMNS).filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_license_match_is_that_of_all_starts():
    """Whatever the postings rule out, no other start would have been accepted."""
    index, rng = licenses.LicenseIndex(), np.random.default_rng(0)
    pool = [w for _, text, _ in licenses.TEMPLATES for w in text.encode().split()] + [b"x%d" % i for i in range(30)]

    def brute(words, slack, least):
        out = []
        for t, body in enumerate(index.words):
            best = (0.0, 0)
            for start in range(-len(body), len(words)):
                lo, hi = max(0, start - slack), min(len(words), start + len(body) + slack)
                if not any(p - q == start for p, w in enumerate(words) for q, v in enumerate(body) if v == w and w in index.vocabulary):
                    continue
                if all(any(words[i : i + len(k)] == k for i in range(lo, hi - len(k) + 1)) for k in index.keys[t]):
                    hit = sum(w in words[max(0, start + i - slack) : max(0, start + i + slack + 1)] for i, w in enumerate(body))
                    best = max(best, (hit / len(body), -start))
            if best[0] >= least:
                out.append((index.labels[t], best[0], -best[1]))
        return sorted(out)

    found = 0
    for _ in range(60):
        words: list[bytes] = []
        for _ in range(rng.integers(1, 4)):
            body = index.words[rng.integers(len(index.words))]
            words += [w for w in body if rng.random() > 0.12] + [pool[i] for i in rng.integers(0, len(pool), 5)]
        got = sorted(licenses.match(words, index, {}, 2, 0.7))
        found += len(got)
        assert got == brute(words, 2, 0.7)
    assert found > 50


def test_levels_are_those_of_bins():
    rng = np.random.default_rng(0)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2), np.array([0, 1, 2, (1 << 63) - 1, 1 << 63, (1 << 64) - 1], np.uint64)]))
    level = decontaminate.levels(values)
    for m in (0, 1, 5, 12, 63, 64):
        bins = [int(v) >> (64 - m) for v in values.tolist()]
        first = [i == 0 or bins[i] != bins[i - 1] for i in range(len(bins))]
        assert first == (level <= m).tolist()


def test_items_are_found_in_long_documents_by_signature():
    """All planted items, of every size and share, in documents of every size; the signature of long items is a small part of the document."""
    rng = np.random.default_rng(1)
    items = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 3, 17, 31, 64, 200, 900, 1000)]
    block = decontaminate.Sketches(list(range(len(items))), items, 0.8)
    missed = 0
    for k in (0, 100, 5_000, 60_000):
        noise = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        for i, item in enumerate(items):
            for _ in range(10):
                part = rng.permutation(item)[: int(np.ceil(0.8 * len(item)))]
                missed += i not in {x for x, _ in block.search(np.concatenate([noise, part]))}
    assert missed == 0
    big = decontaminate.Sketches([0], [items[-1]], 0.8)
    doc = np.unique(np.concatenate([rng.integers(0, 1 << 63, 60_000, dtype=np.uint64), items[-1]]))
    bins = int(decontaminate.size_part(len(doc))) + decontaminate.BINS - big.smallest
    assert (decontaminate.levels(doc) <= bins).mean() < 0.1


def test_link_rule_of_large_clusters():
    """z and what differs from any set tell exactly whether two sets have similarity 0.8."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        base = rng.permutation(1000)[: rng.integers(5, 60)]
        a, b, p = (np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1000, rng.integers(0, 4))])) for _ in range(3))
        da, db = np.setxor1d(a, p), np.setxor1d(b, p)
        z = np.array([round((len(a) / 9 - len(da)) * 1e6), round((len(b) / 9 - len(db)) * 1e6)])
        both = len(np.intersect1d(a, b))
        linked = both >= 0.8 * (len(a) + len(b) - both) - 1e-9
        sure = z.sum() >= ngramjoin._NIL
        pairs = ngramjoin.linked_pairs([da, db], z, np.zeros(2, int), 0, 0)[0]
        assert linked == (sure or len(pairs) > 0)


def test_languages_beyond_one_model(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(12):
        letters = [chr(ord("a") + x) for x in rng.permutation(26)[:6]]
        rows += [(100 * k + i, " ".join("".join(rng.choice(letters, 5)) for _ in range(30)), f"l{k}", "s", 1) for i in range(12)]
    frame = spark.createDataFrame(rows + [(9999, "...", "l1", "s", 1), (9998, None, "l2", "s", 1)], DOC)
    whole, parts = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.language_id(frame, most_languages=m).collect()} for m in (256, 4))
    assert whole == parts and whole[9999] == ("und", 0.0) and sum(whole[r[0]][0] == r[2] for r in rows) > 0.9 * len(rows)


def test_names_and_phones_leave_no_original(spark):
    rows = [
        (1, "Mrs. Anna Smith called. Later Smith and Anna left. Contact Anna Smith, SMITH or Smith's office."), (2, "Госпожа Анна Иванова и Господин Иван Иванов. Иванова, Анна."),
        (3, "+1 (988) 555-2485, (988) 555-2485, 9885552485 and +19885552485"), (4, "My name is Jean-Paul Weber-Schulz. Weber and Jean."), (5, "10.1.2.3 169.254.7.7 8.8.8.8"),
    ]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"secret").collect()}
    for i, text in rows:
        for _, _, _, _, _ in pii.entities(text):
            pass
        for word in re.findall(r"\w{4,}", " ".join(text[a:b] for a, b, *_ in pii.entities(text))):
            assert not re.search(rf"(?<!\w){word}(?!\w)", out[i].text, re.I), (word, out[i].text)
    assert out[1].n_entities == 8 and out[2].text.split()[2].rstrip(".").endswith("ова") and re.search(r"Господин \w+ \w+ов\.", out[2].text)
    numbers = {re.sub(r"\D", "", x)[-10:] for x in re.split(r", | and ", out[3].text)}
    assert len(numbers) == 1 and len(next(iter(numbers))) == 10
    a, b, _ = out[5].text.split()
    assert a.startswith("10.") and b.startswith("169.254.") and pii.entities(out[5].text)[0][3] == a


def test_permuted_surrogates_are_no_other_entity(spark):
    """A table of so many numbers that first surrogates hit other entities: after the check none does, and none is given twice."""
    rows = [(i, f"id 123-45-{i:04d} done") for i in range(3000)] + [(5000 + i, f"at 169.254.{i // 256}.{i % 256} end") for i in range(20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    new = [pii.entities(r.text)[0][3] for r in pii.pseudonymise(frame, b"secret").collect()]
    old = {pii.entities(t)[0][3] for _, t in rows}
    assert len(set(new)) == len(rows) and not set(new) & old
    assert any(pii.surrogate(b"secret", "ip", x) in old for x in old if "." in x)


HOSTILE = [
    '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": Infinity}}]}', '{"tool_calls": [{"id": "a", "name": "f", "arguments": "{\\"x\\": NaN}"}]}',
    '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1e999}}]}', '{"tool_calls": [{"id": "\\ud800", "name": "\\udfffn", "arguments": {"\\ud800": "\\ud83d\\ude00"}}]}',
    '{"tool_calls": [{"id": {"a": 1}, "name": ["f"], "arguments": [1]}, null, 3]}', '<tool_call>{"id": "q", "name": "f", "arguments": ' + '{"a":' * 2000 + "1" + "}" * 2000 + "}</tool_call>",
    '{"tool_calls": [{"id": "a", "name": "f", "arguments": "' + "[" * 2000 + "]" * 2000 + '"}]}', "[" * 100_000, '{"tool_call_id": "a", "content": ' + "[" * 500 + "]" * 500 + "}", '{"tools": [{"name": 3}, 4]}',
    "<tool_response>{\"tool_call_id\": null}</tool_response><tools>{}</tools>", '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"n": ' + "9" * 5000 + "}}]}", None, "",
]
SCHEMAS = [
    {"type": "integer"}, {"minimum": "text", "maximum": None}, {"properties": ["a"], "required": 3}, {"anyOf": None, "enum": None}, {"enum": "abc"}, {"type": 5}, {"type": ["integer", 7, None]},
    {"required": [1, "x"]}, {"minLength": "z", "maxLength": True}, {"items": 3, "additionalProperties": 1}, {"const": None}, {"anyOf": [3, None]}, {"type": "object", "properties": {"x": {"type": "integer", "minimum": [1]}}},
]


def test_hostile_messages_give_rows(spark):
    rows = [(i, 0, "assistant", x) for i, x in enumerate(HOSTILE)]
    rows += [(100 + i, t, "assistant", x) for i, s in enumerate(SCHEMAS) for t, x in enumerate((json.dumps({"tools": [{"name": "f", "parameters": s}]}), json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1.5, "y": "s"}}]})))]
    out = toolcalls.format_chat(spark.createDataFrame(rows, CHAT)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert "NaN" not in json.dumps(json.loads(r.message)) or r.conv_id == 1
    got = {(r.conv_id, r.turn): r for r in out}
    assert "�" in got[3, 0].message and "😀" in got[3, 0].message and "invalid-arguments" in got[6, 0].problems
    assert got[0, 0].n_calls == 0 and json.loads(got[0, 0].message)["content"] == HOSTILE[0]


def test_values_against_schemas_of_any_kind():
    values = [1, 1.5, True, None, "s", "", [], [1], {}, {"x": 1}, -3, 1e300]
    for s, x in itertools.product([*SCHEMAS, 3, None, []], values):
        assert toolcalls.violation(x, s) is None or isinstance(toolcalls.violation(x, s), str)
    assert toolcalls.violation(True, {"enum": [1]}) and not toolcalls.violation(1.0, {"enum": [1]}) and toolcalls.violation(1.5, {"type": "integer"})


def linked_by_hand(rows):
    """(conv, turn) -> (order, n_calls, n_results, n_linked, n_invalid, problems) of messages of distinct turns."""
    by_conv = collections.defaultdict(list)
    for conv, turn, _, text in sorted(rows, key=lambda r: (r[0], r[1])):
        by_conv[conv].append((turn, json.loads(text)))
    out = {}
    for conv, messages in by_conv.items():
        first, answers, schemas = {}, collections.defaultdict(list), {}
        for turn, m in messages:
            for k, c in enumerate(m.get("tool_calls", [])):
                first.setdefault(c["id"], (turn, k))
            if "tool_call_id" in m:
                answers[m["tool_call_id"]].append(turn)
            for tool in m.get("tools", []):
                schemas.setdefault(tool["name"], tool["parameters"])
        edges = {(first[i][0], t) for i, ts in answers.items() if i in first for t in ts}
        info = {}
        for turn, m in messages:
            linked, invalid, problems = 0, 0, set()
            for k, c in enumerate(m.get("tool_calls", [])):
                again = first[c["id"]] != (turn, k)
                found = answers.get(c["id"], [])
                linked += bool(found) and not again
                problems |= {"repeated-id"} if again else set()
                problems |= {"unanswered"} if not found else {"repeated-result"} if len(found) > 1 else set()
                problems |= {"unknown-tool"} if schemas and c["name"] not in schemas else set()
                bad = not isinstance(c["arguments"], dict) or c["name"] in schemas and not isinstance(c["arguments"].get("n"), int)
                invalid += bad
                problems |= {"invalid-arguments"} if bad else set()
                for v in c["arguments"].values() if isinstance(c["arguments"], dict) else ():
                    if isinstance(v, str) and v[1:] in answers:
                        edges.add((min(answers[v[1:]]), turn))
            problems |= {"orphan-result"} if m.get("tool_call_id", next(iter(first), None)) not in first and "tool_call_id" in m else set()
            info[turn] = [len(m.get("tool_calls", [])), int("tool_call_id" in m), linked, invalid, problems]
        edges = {e for e in edges if e[0] != e[1]}
        turns = [t for t, _ in messages]
        reach = {t: {t} for t in turns}
        for _ in turns:
            for a, b in edges:
                reach[a] |= {b} | reach[b]
                for t in turns:
                    if a in reach[t]:
                        reach[t] |= reach[a]
        at = {t: (t, 0) for t in turns}
        for _ in turns:
            for a, b in edges:
                if a not in reach[b]:
                    at[b] = max(at[b], (at[a][0], at[a][1] + 1))
        for t in turns:
            if any(a in reach[b] for a, b in edges if b in reach[t] and t in reach[b] and a in reach[t] and t in reach[a]):
                info[t][4].add("cycle")
            out[conv, t] = (at[t], *info[t][:4], ",".join(sorted(info[t][4])))
    return out


def chats(seed, n):
    """Conversations of calls, results and needs in any order, with schemas, repeated identifiers, orphans and cycles."""
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(n):
        ids = [f"c{i}" for i in range(rng.integers(1, 5))]
        messages = [{"tools": [{"name": "f", "parameters": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}]}] if rng.random() < 0.5 else []
        for i in ids + [x for x in ids if rng.random() < 0.15]:
            needs = {f"x{k}": f"${x}" for k, x in enumerate(ids) if rng.random() < 0.25}
            args = {"n": 1, **needs} if rng.random() < 0.7 else {**needs} if rng.random() < 0.7 else [1]
            messages.append({"tool_calls": [{"id": i, "name": "f" if rng.random() < 0.8 else "g", "arguments": args}]})
        messages += [{"tool_call_id": i, "content": "r"} for i in [*ids, "zz"] for _ in range(rng.integers(0, 3) if rng.random() < 0.4 else int(i != "zz"))]
        rows += [(conv, t, "assistant", json.dumps(messages[k])) for t, k in enumerate(rng.permutation(len(messages)).tolist())]
    return rows


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_tool_calls_of_generated_chats(spark, most):
    """All columns against a linker that looks at every pair; with most=0 all sets of links are ordered by joins."""
    rows = chats(5, 60 if most else 12)
    got = {(r.conv_id, r.turn): ((r.order_turn, r.order_step), r.n_calls, r.n_results, r.n_linked, r.n_invalid, r.problems) for r in toolcalls.format_chat(spark.createDataFrame(rows, CHAT), most).collect()}
    want = linked_by_hand(rows)
    assert got == want
    if most:
        assert {p for x in want.values() for p in x[5].split(",")} >= {"cycle", "orphan-result", "repeated-id", "repeated-result", "unanswered", "unknown-tool", "invalid-arguments", ""}
