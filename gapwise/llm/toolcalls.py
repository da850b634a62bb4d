"""Chat formatting: links tool calls with their results, orders them, validates arguments, writes canonical JSON.

Calls are JSON objects: {"tool_calls": [{"id", "name", "arguments"} or {"id", "function": {...}}]} as a message's
whole text, or {"id", "name", "arguments"} in <tool_call> tags. Results are {"tool_call_id", "content"} as a whole
text, or in <tool_response> tags. Schemas are {"tools": [{"name", "parameters"}]} as a whole text or a list in
<tools> tags. An argument that is the text "$id" depends on the result of call id.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import checkpoint, in_arrow
from gapwise.llm.graph import components

_TAG = re.compile(r"<(tool_call|tool_response|tools)>(.*?)</\1>", re.S)
_PARSED = (
    "content string, rest string, calls array<struct<id:string,name:string,arguments:string,ok:boolean,needs:array<string>,rest:string>>, "
    "results array<string>, tools array<struct<name:string,schema:string>>"
)
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: Objects and lists within each other, beyond which JSON is kept as text.
DEPTH = 200


def canonical(x: Any) -> str:
    """JSON with sorted keys and no white space; text stays as it is."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _whole(text: str) -> str:
    """The text with halves of surrogate pairs, which UTF-8 can't hold, replaced."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def _no_constant(name: str) -> Any:
    raise ValueError(name)


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(text)
    return x


def _repaired(x: Any) -> Any:
    """The value with all its texts whole; too deep a one is an error."""
    out: list[Any] = [None]
    todo: list[tuple[Any, Any, Any, int]] = [(x, out, 0, 0)]
    while todo:
        y, into, at, depth = todo.pop()
        if depth > DEPTH:
            raise ValueError("too deep")
        if isinstance(y, dict):
            into[at] = new = {}
            for k, v in y.items():
                new[k := _whole(k)] = None
                todo.append((v, new, k, depth + 1))
        elif isinstance(y, list):
            into[at] = new = [None] * len(y)
            todo += [(v, new, k, depth + 1) for k, v in enumerate(y)]
        else:
            into[at] = _whole(y) if isinstance(y, str) else y
    return out[0]


def _load(text: str) -> Any:
    """A JSON value; null for what isn't JSON, holds numbers that aren't finite, or is too deep."""
    try:
        return _repaired(json.loads(text, parse_constant=_no_constant, parse_float=_finite))
    except (ValueError, RecursionError):
        return None


def _needs(x: Any) -> Iterator[str]:
    if isinstance(x, str) and re.fullmatch(r"\$[\w.-]+", x):
        yield x[1:]
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from _needs(y)


def _name(x: Any) -> str | None:
    """A name or an identifier; what isn't text is written as JSON."""
    return x if x is None or isinstance(x, str) else canonical(x)


def _rest(x: dict, *known: str) -> dict:
    """The fields that aren't among those that have a place of their own."""
    return {k: v for k, v in x.items() if k not in known}


def _call(x: Any) -> dict:
    if not isinstance(x, dict):  # kept as it is
        return {"id": None, "name": None, "arguments": canonical(x), "ok": False, "needs": [], "rest": None}
    inner = x["function"] if isinstance(x.get("function"), dict) else x
    raw = inner.get("arguments", {})
    args = _load(raw) if isinstance(raw, str) else raw
    rest = _rest(x, "id", "function") | {"function": _rest(inner, "name", "arguments")} if inner is not x else _rest(x, "id", "name", "arguments")
    rest = {k: v for k, v in rest.items() if k != "function" or v}
    # an identifier that is missing links to nothing; text that isn't JSON stays as it is
    return {
        "id": _name(x.get("id")), "name": _name(inner.get("name")), "arguments": raw if args is None and isinstance(raw, str) else canonical(args),
        "ok": isinstance(args, dict), "needs": sorted(set(_needs(args))), "rest": canonical(rest) if rest else None,
    }


def _with_rest(x: dict, rest: str | None) -> dict:
    """``x`` with more fields; one that has a name of x's own is kept with an underscore before it."""
    for k, v in (json.loads(rest) if rest else {}).items():
        while k in x:
            k = f"_{k}"
        x[k] = v
    return x


def _written(c: dict) -> dict:
    """A call in its canonical form, with all of its fields."""
    rest = json.loads(c["rest"]) if c["rest"] else {}
    inner = rest.pop("function", None) if isinstance(rest.get("function"), dict) else None
    function = _with_rest({"name": c["name"], "arguments": c["arguments"]}, canonical(inner) if inner else None)
    kind = rest.pop("type", "function")
    return _with_rest({"id": c["id"], "type": kind, "function": function}, canonical(rest))


def _tool(x: Any) -> dict | None:
    inner = x.get("function", x) if isinstance(x, dict) else None
    if not isinstance(inner, dict) or inner.get("name") is None:
        return None
    return {"name": _name(inner["name"]), "schema": canonical(inner.get("parameters", {}))}


def parse(text: str | None) -> dict:
    """content without what is parsed from it, rest (JSON of fields that have no place of their own), calls, ids of results, tools."""
    out: dict[str, Any] = {"content": text, "rest": None, "calls": [], "results": [], "tools": []}
    if not text:
        return out
    if text.lstrip()[:1] == "{" and isinstance(x := _load(text), dict):
        if isinstance(x.get("tool_calls"), list):
            out["calls"] = [_call(y) for y in x["tool_calls"]]
            content, rest = x.get("content"), _rest(x, "tool_calls", "content")
            out["content"] = content if content is None or isinstance(content, str) else canonical(content)
            out["rest"] = canonical(rest) if rest else None
        elif x.get("tool_call_id") is not None:
            out["results"] = [_name(x["tool_call_id"])]
            out["content"] = x["content"] if isinstance(x.get("content"), str) else canonical(x.get("content"))
            rest = _rest(x, "tool_call_id", "content")
            out["rest"] = canonical(rest) if rest else None
        elif isinstance(x.get("tools"), list):
            out["tools"] = [c for y in x["tools"] if (c := _tool(y))]
        return out

    answers: list[dict] = []

    def take(m: re.Match) -> str:
        x = _load(m[2])
        if m[1] == "tool_call" and isinstance(x, dict):
            out["calls"].append(_call(x))
        elif m[1] == "tool_response" and isinstance(x, dict) and x.get("tool_call_id") is not None:
            out["results"].append(_name(x["tool_call_id"]))
            if rest := _rest(x, "content", "tool_call_id"):
                answers.append({"tool_call_id": x["tool_call_id"]} | rest)
            return x["content"] if isinstance(x.get("content"), str) else canonical(x.get("content"))
        elif m[1] == "tools" and isinstance(x, list):
            out["tools"] += [c for y in x if (c := _tool(y))]
        else:
            return m[0]
        return ""

    if "<tool" in text:
        out["content"] = _TAG.sub(take, text)
        out["rest"] = canonical({"tool_responses": answers}) if answers else None
    return out


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _same(a: Any, b: Any) -> bool:
    """Equal as JSON values: 1 is 1.0, but true is not 1."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def _of_type(x: Any, kind: Any) -> bool:
    if kind == "number":
        return _number(x)
    if kind == "integer":
        return _number(x) and x == math.floor(x)
    return isinstance(kind, str) and isinstance(x, _TYPES.get(kind, ()))


def violation(x: Any, schema: Any, at: str = "$") -> str | None:
    """The first way in which a value doesn't fit a JSON schema, or null.

    Knows type, enum, const, required, properties, additionalProperties, items, anyOf and bounds. A keyword whose own
    value is of a wrong type says nothing.
    """
    if not isinstance(schema, dict):
        return None

    def rule(name: str, kind: type | tuple) -> Any:
        y = schema.get(name)
        return y if isinstance(y, kind) and not (isinstance(y, bool) and kind is not bool) else None

    kinds = [schema["type"]] if isinstance(schema.get("type"), str) else rule("type", list)
    if kinds and not any(_of_type(x, kind) for kind in kinds):
        return f"{at}: not of type {canonical(kinds if isinstance(schema['type'], list) else kinds[0])}"
    allowed = rule("enum", list)
    if allowed is not None and not any(_same(x, y) for y in allowed) or "const" in schema and not _same(x, schema["const"]):
        return f"{at}: not an allowed value"
    choices = rule("anyOf", list)
    if choices and all(violation(x, s, at) for s in choices):
        return f"{at}: fits no alternative"
    if _number(x):
        low, high = rule("minimum", (int, float)), rule("maximum", (int, float))
        if low is not None and x < low or high is not None and x > high:
            return f"{at}: out of bounds"
    if isinstance(x, str):
        low, high = rule("minLength", (int, float)), rule("maxLength", (int, float))
        if low is not None and len(x) < low or high is not None and len(x) > high:
            return f"{at}: of a wrong length"
    if isinstance(x, dict):
        own, more = rule("properties", dict) or {}, schema.get("additionalProperties")
        for name in rule("required", list) or ():
            if isinstance(name, str) and name not in x:
                return f"{at}.{name}: missing"
        for name, value in sorted(x.items()):
            inner = own[name] if name in own else more
            if inner is False:
                return f"{at}.{name}: not allowed"
            if v := violation(value, inner, f"{at}.{name}"):
                return v
    for i, value in enumerate(x if isinstance(x, list) else ()):
        if v := violation(value, schema.get("items"), f"{at}[{i}]"):
            return v
    return None


def _mapped(df: DataFrame, inputs: list[str], one, schema: str) -> DataFrame:
    """Adds the columns of ``schema`` as ``one`` makes them, a dictionary for each row."""
    from pyspark.sql import types as T

    added = T.StructType.fromDDL(schema)
    names = [f.name for f in added.fields]
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        for batch in batches:
            rows = [one(*x) for x in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], names=[*batch.schema.names, *names])

    return df.transform(in_arrow, run, T.StructType([*df.schema.fields, *added.fields]))


def settled(turns: list[int], before: list[int], after: list[int]) -> tuple[list[tuple[int, int]], list[bool]]:
    """Place (turn, step) of each message of a set, and whether it lies on a cycle of links (before, after), in time linear in the links.

    Strong components come out of the search (Tarjan's, without recursion) after all that follow them; in the
    opposite order, each message is final before those that follow it. Links within a component don't count.
    """
    n = len(turns)
    follow: list[list[int]] = [[] for _ in range(n)]
    for u, v in zip(before, after, strict=True):
        follow[u].append(v)
    index, low, part, size = [-1] * n, [0] * n, [-1] * n, []
    made, open_, count = [], [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        index[root] = low[root] = count
        count += 1
        open_.append(root)
        path = [(root, iter(follow[root]))]
        while path:
            u, rest = path[-1]
            for v in rest:
                if index[v] < 0:
                    index[v] = low[v] = count
                    count += 1
                    open_.append(v)
                    path.append((v, iter(follow[v])))
                    break
                if part[v] < 0:
                    low[u] = min(low[u], index[v])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[u])
                if low[u] == index[u]:
                    size.append(0)
                    while part[u] < 0:
                        v = open_.pop()
                        part[v] = len(size) - 1
                        size[-1] += 1
                        made.append(v)
    at = [(t, 0) for t in turns]
    for u in reversed(made):
        least = (at[u][0], at[u][1] + 1)
        for v in follow[u]:
            if part[v] != part[u] and at[v] < least:
                at[v] = least
    return at, [size[k] > 1 for k in part]


def spread(edges: DataFrame, start: DataFrame, step: int = 0) -> DataFrame:
    """node, best: the greatest (turn, step) of ``start`` (node, best) that reaches a node along ``edges`` (before, after), with ``step`` more at each edge, in rounds until nothing rises."""
    best = checkpoint(start)
    while True:
        sent = edges.join(best, edges["before"] == best["node"]).select(F.col("after").alias("node"), F.struct(F.col("best.turn").alias("turn"), (F.col("best.step") + step).alias("step")).alias("new"))
        sent = sent.groupBy("node").agg(F.max("new").alias("new"))
        made = checkpoint(best.join(sent, "node", "left").select("node", F.greatest("best", F.coalesce("new", "best")).alias("now"), "best"))
        best = made.select("node", F.col("now").alias("best"))
        if made.filter("now > best").isEmpty():
            return best


def settled_at_large(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As settled(), of nodes (node, turn) and edges (before, after) that needn't fit a task: node, at, cyclic.

    Strong components are found by colours: the greatest node that reaches a node is its colour, and those of a
    colour that reach the node it is named after are one component with it; the others are coloured anew. Places then
    rise along the links between components. Each takes as many rounds as the longest path; each round is one join.
    """
    found, left, inner = None, checkpoint(nodes.select("node")), edges
    while not left.isEmpty():
        color = spread(inner, left.select("node", F.struct(F.col("node").alias("turn"), F.lit(0).alias("step")).alias("best"))).select("node", F.col("best.turn").alias("color"))
        named = inner.join(color.select(F.col("node").alias("before"), F.col("color").alias("c")), "before").join(color.select(F.col("node").alias("after"), "color"), "after").filter("c = color")
        back = checkpoint(named.select(F.col("after").alias("before"), F.col("before").alias("after")))
        # 1 spreads against the links of a colour, from the node that it is named after
        start = color.select("node", F.struct((F.col("node") == F.col("color")).cast("long").alias("turn"), F.lit(0).alias("step")).alias("best"))
        one = checkpoint(spread(back, start).filter("best.turn = 1").select("node").join(color, "node"))
        found = one if found is None else found.unionByName(one)
        left = checkpoint(left.join(one, "node", "left_anti"))
        inner = checkpoint(inner.join(left.withColumnRenamed("node", "before"), "before", "left_semi").join(left.withColumnRenamed("node", "after"), "after", "left_semi"))
    found = checkpoint(found)
    between = edges.join(found.select(F.col("node").alias("before"), F.col("color").alias("c")), "before").join(found.select(F.col("node").alias("after"), "color"), "after")
    between = checkpoint(between.filter("c != color").select("before", "after"))
    at = spread(between, nodes.select("node", F.struct("turn", F.lit(0).alias("step")).alias("best")), 1)
    size = found.groupBy("color").agg(F.count("*").alias("n"))
    return at.join(found.join(size, "color"), "node").select("node", F.col("best").alias("at"), (F.col("n") > 1).alias("cyclic"))


def positions(edges: DataFrame, messages: DataFrame, most: int = 1_000_000) -> DataFrame:
    """conv_id, row, at (turn, step), cyclic of the messages that edges (conv_id, before, after) move.

    A message comes at its own turn, or, where one that must come before it isn't earlier, right after that one.
    Messages on a cycle are marked and don't wait for each other. Messages that are linked, with each other or by way
    of others, are one set; sets whose links all lead to a later turn stay as they are. The links of a set, without
    text, are solved in a task up to ``most`` of them, and by joins beyond.
    """
    own = messages.select("conv_id", "row", "turn")
    links = edges.join(own.select("conv_id", F.col("row").alias("before"), F.col("turn").alias("turn_before")), ["conv_id", "before"])
    links = links.join(own.select("conv_id", F.col("row").alias("after"), F.col("turn").alias("turn_after")), ["conv_id", "after"])
    # a message is named by conversation and row
    links = checkpoint(links.select(F.xxhash64("conv_id", "before").alias("before"), F.xxhash64("conv_id", "after").alias("after"), "turn_before", "turn_after"))
    base = own.withColumn("node", F.xxhash64("conv_id", "row"))
    made = None
    if not links.filter("turn_before >= turn_after").isEmpty():
        sets = components(links.select(F.col("before").alias("a"), F.col("after").alias("b"))).select(F.col("node").alias("before"), F.col("component").alias("set"))
        links = links.join(sets, "before")
        moving = links.groupBy("set").agg(F.count("*").alias("n"), F.max(F.col("turn_before") >= F.col("turn_after")).alias("moves")).filter("moves").select("set", "n")
        links = checkpoint(links.join(moving, "set"))

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            ids, first, at = np.unique(np.concatenate([rows["before"], rows["after"]]), return_index=True, return_inverse=True)
            turns = np.concatenate([rows["turn_before"], rows["turn_after"]])[first]
            places, cyclic = settled(turns.tolist(), at[: len(rows)].tolist(), at[len(rows) :].tolist())
            return pd.DataFrame({"node": ids, "turn": [x[0] for x in places], "step": [x[1] for x in places], "cyclic": cyclic})

        made = links.filter(F.col("n") <= most).groupBy("set").applyInPandas(run, "node long, turn long, step int, cyclic boolean")
        made = made.select("node", F.struct("turn", "step").alias("new"), "cyclic")
        large = links.filter(F.col("n") > most)
        if not large.isEmpty():
            both = large.select(F.col("before").alias("node"), F.col("turn_before").alias("turn")).unionByName(large.select(F.col("after").alias("node"), F.col("turn_after").alias("turn"))).distinct()
            made = made.unionByName(settled_at_large(both, large.select("before", "after")).withColumnRenamed("at", "new"))
    if made is None:
        return base.select("conv_id", "row", F.struct("turn", F.lit(0).alias("step")).alias("at"), F.lit(False).alias("cyclic"))
    return base.join(made, "node", "left").select("conv_id", "row", F.coalesce("new", F.struct("turn", F.lit(0).alias("step"))).alias("at"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def format_chat(conversations: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One row per message: conv_id, turn, role, order_turn, order_step, n_calls, n_results, n_linked, n_invalid, problems, message.

    Sorted by order_turn, order_step and turn, a conversation's calls come before their results and results before
    the calls that need them. message is canonical JSON. problems, sorted and joined by commas: unanswered, answered
    twice (repeated-result), an identifier used again (repeated-id) or missing (no-id), a missing name (no-name),
    orphan-result, unknown-tool, invalid-arguments (text that isn't JSON is kept as it is), cycle. A tool without a
    schema in its conversation is unknown only if the conversation has schemas.

    Fields of messages, calls and results that have no place of their own are kept in the message (where the name is
    taken, with an underscore before it); content that isn't text is written as JSON; of results in tags they are
    listed as tool_responses. A tag that holds an object is a call with a name or without.

    JSON with numbers that aren't finite (NaN, 1e999) or nested deeper than 200 isn't JSON here; halves of surrogate
    pairs become U+FFFD; keywords of a schema with values of a wrong type say nothing. Null texts have null content,
    empty ones empty, and texts of any length are read whole; a null conv_id is a conversation of its own; a null turn
    comes first; of equal turns an order by a hash decides; repeated rows are one message that is returned as often;
    an empty table gives an empty result; further columns are ignored. Joins go by conversation and identifier, counts
    combine before their shuffle; what is gathered are the links of a set of linked messages, ``most`` at most.
    """
    own = conversations.select("conv_id", "turn", "role", "text").withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))
    # null-safe in joins
    own = own.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    seen = checkpoint(_mapped(own, ["text"], parse, _PARSED).drop("text"))
    messages = seen.filter("size(calls) > 0 or size(results) > 0").select(F.col("conv").alias("conv_id"), "row", F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"), "calls", "results").dropDuplicates(["conv_id", "row"])
    calls = messages.select("conv_id", "row", "turn", F.posexplode("calls").alias("k", "call")).select("conv_id", "row", "turn", "k", "call.*")
    results = messages.select("conv_id", "row", "turn", F.explode("results").alias("id"))
    first = calls.filter("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "k")).alias("first"))
    answers = results.groupBy("conv_id", "id").agg(F.count("*").alias("n_answers"), F.min(F.struct("turn", "row")).alias("answer"))
    tools = seen.filter("size(tools) > 0").select(F.col("conv").alias("conv_id"), "turn", F.explode("tools").alias("tool"))
    schemas = tools.groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.min(F.struct("turn", "tool.schema"))["schema"].alias("schema"))
    with_tools = schemas.select("conv_id", F.lit(True).alias("has_tools")).distinct()

    linked = calls.join(first, ["conv_id", "id"], "left").join(answers, ["conv_id", "id"], "left")
    linked = linked.join(schemas, ["conv_id", "name"], "left").join(with_tools, "conv_id", "left")

    def judge(args: str, ok: bool, schema: str | None) -> dict:
        wrong = None if ok else "$: not an object"
        return {"wrong": wrong or (violation(_load(args), _load(schema)) if schema else None)}

    linked = _mapped(linked, ["arguments", "ok", "schema"], judge, "wrong string")
    again = F.struct("turn", "row", "k") != F.col("first")
    problems = F.array_compact(F.array(
        F.when(F.col("id").isNull(), "no-id"), F.when(F.col("name").isNull(), "no-name"), F.when(again, "repeated-id"),
        F.when(F.col("id").isNotNull() & F.col("n_answers").isNull(), "unanswered"), F.when(F.col("n_answers") > 1, "repeated-result"),
        F.when(F.col("has_tools") & F.col("name").isNotNull() & F.col("schema").isNull(), "unknown-tool"), F.when(F.col("wrong").isNotNull(), "invalid-arguments"),
    ))
    by_call = linked.select("conv_id", "row", "k", "id", "needs", "wrong", (F.col("n_answers").isNotNull() & ~again).alias("linked"), "answer", problems.alias("problems"))
    by_call = checkpoint(by_call)
    # call -> its first answer; answer of what a call needs -> the call
    to_answer = results.join(first, ["conv_id", "id"]).select("conv_id", F.col("first.row").alias("before"), F.col("row").alias("after"))
    needs = by_call.select("conv_id", "row", F.explode("needs").alias("id")).join(answers, ["conv_id", "id"]).select("conv_id", F.col("answer.row").alias("before"), F.col("row").alias("after"))
    edges = checkpoint(to_answer.unionByName(needs).filter("before != after").distinct())
    placed = positions(edges, messages, most)
    orphan = results.join(first, ["conv_id", "id"], "left_anti").select("conv_id", "row").distinct().withColumn("orphan", F.lit(True))
    per_row = by_call.groupBy("conv_id", "row").agg(F.sum(F.col("linked").cast("long")).alias("n_linked"), F.count("wrong").alias("n_invalid"), F.array_distinct(F.flatten(F.collect_list("problems"))).alias("problems"))
    info = placed.join(per_row, ["conv_id", "row"], "left").join(orphan, ["conv_id", "row"], "left").withColumnRenamed("conv_id", "conv")
    out = seen.join(info, ["conv", "row"], "left")
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<string>")
    marks = [F.when(F.col(c), F.array(F.lit(name))).otherwise(none) for c, name in (("orphan", "orphan-result"), ("cyclic", "cycle"))]
    lists = F.concat(F.coalesce("problems", none), *marks)
    moved = F.when(F.col("at.turn") == -(2**62), None).otherwise(F.col("at.turn")).cast("long")

    def write(role: str | None, content: str | None, rest: str | None, calls: list[dict], results: list[str]) -> dict:
        message: dict[str, Any] = {"role": role, "content": content}
        if calls:
            message["tool_calls"] = [_written(c) for c in calls]
        if results:
            message["tool_call_id"] = results[0] if len(results) == 1 else results
        return {"message": canonical(_with_rest(message, rest))}

    out = out.select("conv_id", "turn", "role", F.when(F.col("at").isNull(), F.col("turn").cast("long")).otherwise(moved).alias("order_turn"), F.coalesce("at.step", F.lit(0)).alias("order_step"),
        F.size("calls").cast("long").alias("n_calls"), F.size("results").cast("long").alias("n_results"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("n_invalid", zero).alias("n_invalid"),
        F.array_join(F.array_sort(lists), ",").alias("problems"), "content", "rest", "calls", "results")
    return _mapped(out, ["role", "content", "rest", "calls", "results"], write, "message string").drop("content", "rest", "calls", "results")
