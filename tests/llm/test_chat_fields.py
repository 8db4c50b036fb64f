import json

from tidemark.llm import chat


def test_nothing_of_a_message_is_lost(spark):
    calls = [{"id": "a", "name": "get", "arguments": '{"q": "cut'}, {"id": "b", "name": "get", "arguments": "plain words"}]
    data = [
        (1, 0, "assistant", json.dumps({"tool_calls": calls, "content": "x", "reasoning": 'why "so"', "a": {"z": 1, "b": [None, 2]}, "role": "y"})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "result": 42, "none": None, "é\"": True})),
    ]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    first, second = (r["message"] for r in chat.format_chats(frame, {"get": {"q": "string"}}).orderBy("turn").collect())
    assert json.loads(second) == {"content": "", "none": None, "result": 42, "role": "tool", "tool_call_id": "a", "é\"": True}
    found = json.loads(first)
    assert [(c["id"], c["arguments"], c["valid"]) for c in found["tool_calls"]] == [("a", '{"q": "cut', False), ("b", "plain words", False)]
    assert {k: found[k] for k in found if k != "tool_calls"} == {"content": "x", "reasoning": 'why "so"', "a": {"z": 1, "b": [None, 2]}, "role": "assistant"}
    assert first.startswith('{"a":{"b":[null,2],"z":1},"content":"x","reasoning":') and list(found) == sorted(found)
