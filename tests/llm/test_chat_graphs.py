"""Levels, links and validity of random call graphs against a plain implementation."""

import json
import random

import pytest

from tidemark.llm import chat
from tidemark.llm.common import Tables


def plain_levels(needs):
    """Longest path to each call by depth-first search; None on or behind a cycle."""
    known, busy = {}, set()

    def level(c):
        if c in known:
            return known[c]
        if c in busy:
            return None
        busy.add(c)
        below = [level(n) for n in needs[c]]
        busy.discard(c)
        out = None if any(b is None for b in below) else max(below, default=-1) + 1
        if not busy or out is not None:
            known[c] = out
        return out

    return {c: level(c) for c in needs}


def messages(graph, conv, turn):
    calls = [{"id": c, "name": "get", "arguments": {f"a{i}": f"${n}" for i, n in enumerate(sorted(needs))} or {"x": 1}} for c, needs in graph.items()]
    return (conv, turn, "assistant", json.dumps({"tool_calls": calls}))


def graphs(seed):
    rng = random.Random(seed)
    yield {f"c{i}": {f"c{i - 1}"} if i else set() for i in range(60)}
    yield {f"c{i}": {f"c{j}" for j in (i - 1, i - 2) if j >= 0} for i in range(14)}
    yield {"a": {"a"}, "b": {"a"}, "c": set(), "d": {"c", "b"}, "e": {"c", "missing"}}
    yield {f"c{i}": {f"c{(i + 1) % 5}"} for i in range(5)} | {"out": {"c1"}, "free": set()}
    for _ in range(6):
        n = rng.randint(2, 12)
        yield {f"c{i}": {f"c{rng.randrange(n)}" for _ in range(rng.randint(0, 2))} for i in range(n)}


def test_levels_of_graphs(spark):
    rows, expected = [], {}
    for conv, graph in enumerate(graphs(3)):
        rows.append(messages(graph, conv, 1))
        inside = {c: {n for n in needs if n in graph} for c, needs in graph.items()}
        expected |= {(conv, c): lv for c, lv in plain_levels(inside).items()}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tables = Tables(spark)
    read = tables.put("messages", chat.read_messages(frame))
    linked = chat.link_calls(read, {}, tables).join(read.select("_row", "conv_id"), "_row")
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in linked.collect()} == expected
    assert expected[0, "c59"] == 59 and expected[1, "c13"] == 13 and expected[2, "d"] is None and expected[2, "e"] == 1


def test_long_chain_takes_few_rounds(spark):
    n = 3000
    needs = spark.range(1, n).selectExpr("1L AS conv_id", "concat('c', id) AS call_id", "concat('c', id - 1) AS needed")
    calls = spark.range(n).selectExpr("1L AS conv_id", "concat('c', id) AS call_id")
    tables = Tables(spark)
    rounds = []
    inner = tables.put
    tables.put = lambda name, df: (rounds.append(name), inner(name, df))[1]
    found = {r["call_id"]: r["level"] for r in chat.levels_of(calls, needs, tables).collect()}
    assert found == {f"c{i}": i for i in range(n)}
    assert rounds.count("after") <= 14


def test_shared_and_missing_ids(spark):
    one = json.dumps({"tool_calls": [{"id": "k", "name": "get", "arguments": {}}, {"name": "get", "arguments": {}}]})
    rows = [(1, t, "assistant", one) for t in range(300)] + [(1, t, "tool", json.dumps({"tool_call_id": "k", "content": t})) for t in range(300, 600)] + [(1, None, "assistant", one)]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == len(rows)
    assert [r["turn"] for r in found if r["n_linked"]] == [0]
    assert sum(r["n_calls"] for r in found) == 600


def conforms(value, kind):
    words = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    if isinstance(kind, str):
        return isinstance(value, words[kind]) and (kind == "boolean") == isinstance(value, bool)
    if isinstance(kind, list):
        return isinstance(value, list) and all(conforms(v, kind[0]) for v in value)
    if not isinstance(value, dict):
        return False
    names = {f.rstrip("?"): (f.endswith("?"), k) for f, k in kind.items() if f != "*"}
    return all((f in value and conforms(value[f], k)) or (f not in value and optional) for f, (optional, k) in names.items()) and ("*" in kind or set(value) <= set(names))


@pytest.mark.parametrize("schema", [{"q": "string", "n?": "integer"}, {"q?": ["string"], "*": "any"}, {"o": {"a": "number", "b?": ["integer"]}}, {}])
def test_validity(spark, schema):
    values = [{}, {"q": "x"}, {"q": 1}, {"q": "x", "n": 3}, {"q": "x", "n": 3.5}, {"q": "x", "n": None}, {"q": ["a", "b"]}, {"q": ["a", 1]}, {"q": []}, {"o": {"a": 1}}, {"o": {"a": 1.5, "b": [1, 2]}}, {"o": {"a": 1, "b": ["x"]}}, {"o": {"a": 1, "c": 2}}, {"o": []}, {"q": "x", "z": True}, [1], "text", 7]
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [{"id": str(i), "name": "get", "arguments": v}]})) for i, v in enumerate(values)]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"get": schema}).collect()
    assert {r["turn"]: r["n_invalid"] for r in found} == {i: 1 - conforms(v, schema) for i, v in enumerate(values)}
