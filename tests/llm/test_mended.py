"""Repeated items over blocks, unknown fields of messages, formats of which all values are taken."""

import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from gapwise.llm import decontaminate, pii, toolcalls

A, B = "one two three four five six seven", "red orange yellow green blue violet"


@pytest.mark.parametrize("most", [4_000_000, 3, 1])
def test_repeated_items_are_one_pair_in_any_number_of_blocks(spark, most):
    items = spark.createDataFrame([(1, A), (1, B), (2, B), (3, "not there at all in any text")], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"{A} and {B}"), (8, B), (9, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contamination(docs, items, most=most).collect())
    assert got == [(7, 1, 1.0), (7, 2, 1.0), (8, 1, 1.0), (8, 2, 1.0)]


def messages(spark, *texts):
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)]
    got = toolcalls.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    return [(json.loads(r.message), r) for r in got]


def test_unknown_fields_stay(spark):
    call = {"tool_calls": [{"id": "y", "index": 3, "type": "custom", "function": {"name": "f", "arguments": {"a": 1}, "strict": True}}, {"id": "z", "name": "g", "note": None}], "thought": "keep me", "content": 5, "role": "x"}
    answer = {"tool_call_id": "y", "content": "ok", "status": "error"}
    (m, r), (n, s) = messages(spark, json.dumps(call), json.dumps(answer))
    assert m["thought"] == "keep me" and m["content"] == "5" and m["_role"] == "x" and m["role"] == "assistant" and r.n_calls == 2 and r.n_linked == 1
    assert m["tool_calls"][0] == {"id": "y", "index": 3, "type": "custom", "function": {"name": "f", "arguments": '{"a":1}', "strict": True}}
    assert m["tool_calls"][1] == {"id": "z", "note": None, "type": "function", "function": {"name": "g", "arguments": "{}"}}
    assert n == {"role": "assistant", "content": "ok", "tool_call_id": "y", "status": "error"} and s.n_results == 1


def test_tags_without_a_name_and_with_more_fields(spark):
    (m, r), (n, _), (o, q) = messages(spark, 'so <tool_call>{"id": "a", "arguments": {}}</tool_call> be it', '<tool_response>{"tool_call_id": "a", "content": "r", "ms": 7}</tool_response>', "<tool_call>not json</tool_call>")
    assert r.n_calls == 1 and r.problems == "no-name" and m["content"] == "so  be it" and m["tool_calls"][0]["function"]["name"] is None
    assert n["tool_responses"] == [{"tool_call_id": "a", "ms": 7}] and n["content"] == "r"
    assert q.n_calls == 0 and o["content"] == "<tool_call>not json</tool_call>"


def test_moved_is_a_permutation_without_fixed_points():
    for size in (2, 10, 97, 1000):
        for attempt in (0, 3, pii.ALONE):
            new = [pii.moved(i, size, b"k", attempt, "t") for i in range(size)]
            assert sorted(new) == list(range(size))
        assert all(i != x for i, x in enumerate(new))
        assert all(pii.unpermuted(pii.permuted(i, size, b"k", "t"), size, b"k", "t") == i for i in range(size))


def test_a_full_network_ends(spark):
    """All 65,536 addresses of a network: no free one is left, yet the job ends, and surrogates stay distinct and in it."""
    rows = spark.range(1 << 16).select(F.col("id").alias("doc_id"), F.concat(F.lit("at 192.168."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256, F.lit(" and 10.0.0.1")).alias("text"))
    got = pii.pseudonymise(rows, b"secret", most=100_000).select("doc_id", F.split("text", " ")[1].alias("new"), F.split("text", " ")[3].alias("other")).collect()
    new = {r.doc_id: r.new for r in got}
    assert len(set(new.values())) == 1 << 16 and all(ipaddress.ip_address(x) in ipaddress.ip_network("192.168.0.0/16") for x in new.values())
    assert all(new[i] != f"192.168.{i // 256}.{i % 256}" for i in new)
    assert len({r.other for r in got}) == 1 and got[0].other.startswith("10.") and got[0].other != "10.0.0.1"


def test_addresses_in_other_scripts():
    assert [x[2:4] for x in pii.entities("mail bob@exämple.com, анна@почта.рф or c@xn--bcher-kva.xn--p1ai!")] == [("email", "bob@exämple.com"), ("email", "анна@почта.рф"), ("email", "c@xn--bcher-kva.xn--p1ai")]


def test_whole_licences_and_their_versions(spark):
    """Each whole text in a longer file, with its punctuation and some words lost, gives its own label and no other version's."""
    from gapwise.llm import licenses
    from gapwise.llm.licence_texts import WHOLE

    rows, filler = [], " ".join(f"w{i}" for i in range(300))
    for i, (_, text, keys) in enumerate(WHOLE):
        rows.append((i, f"// {filler}\n/* Copyright (c) 2020 A Person\n * " + text.replace(", ", ",\n * ") + f"\n */ {filler}"))
        words = text.split()
        rows.append((100 + i, " ".join(words[: len(words) // 3])))
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = [x[0] for x in WHOLE]
    for i, label in enumerate(own):
        assert got[i] & set(own) == {label}, (label, got[i])
        assert label not in got[100 + i]
    assert "bsd" in got[own.index("bsd-2-clause")] and "mit" in got[own.index("mit-text")] and "apache" in got[own.index("apache-2.0")]


def test_grams_of_many_pieces_are_merged_as_they_come(monkeypatch):
    import numpy as np

    from gapwise.llm import ppm

    rng = np.random.default_rng(5)
    bodies = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(0, 60, 80)]
    train = [i % 10 != 0 for i in range(80)]
    want = ppm.distinct_grams(bodies, train)
    monkeypatch.setattr(ppm, "PIECE", 50)
    most, summed = [], ppm.summed
    monkeypatch.setattr(ppm, "summed", lambda keys, n: most.append(len(keys)) or summed(keys, n))
    got = ppm.distinct_grams(bodies, train)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    assert int(got[1].sum()) == sum(len(x) + 1 for x, t in zip(bodies, train, strict=True) if t)
    assert len(most) > 2 and max(most) < 3 * len(got[0])  # before: all pieces at once
    assert ppm.distinct_grams([], [])[0].size == 0
