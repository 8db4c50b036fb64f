import json

from tidemark.llm import chat


def test_calls_belong_to_their_own_row(spark):
    made = lambda *ids: json.dumps({"content": "x", "tool_calls": [{"id": i, "name": "get", "arguments": {"q": i}} for i in ids]})
    data = [(1, 0, "assistant", made("a"))] * 3 + [(1, 0, "assistant", made("b", "c")), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "r"}))]
    data += [(None, 0, "assistant", made("a")), (1, None, "assistant", made("a"))]
    out = chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), {"get": {"q": "string"}}).collect()
    assert len(out) == len(data)
    found = sorted((r["n_calls"], r["n_linked"], [c["id"] for c in json.loads(r["message"]).get("tool_calls", [])]) for r in out)
    assert found == [(0, 0, [])] * 3 + [(1, 1, ["a"])] * 3 + [(2, 0, ["b", "c"])]
    assert {json.loads(r["message"])["content"] for r in out if r["conv_id"] is None or r["turn"] is None} == {made("a")}
