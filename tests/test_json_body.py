"""JSON bodies, without Spark."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cloakframe.operators.json_body import BadBody, body_texts, encode, parse, put_back, segments


def texts(body, strict=True):
    return [n.text for n in body_texts(json.dumps(body), strict)]


def test_fields():
    body = {
        "system": "never",
        "messages": [
            {"content": "plain"},
            {"content": [{"type": "text", "text": "t"}, {"type": "thinking", "thinking": "no"}, {"type": "tool_result", "content": [{"type": "text", "text": "r"}]}]},
            {"content": [{"type": "tool_use", "input": {"k": {"n": 1.50, "v": ["w"]}}}]},
        ],
        "tools": [{"name": "mcp__x", "description": "d", "input_schema": {"properties": {"p": {"title": "e", "enum": ["f"]}}}}, {"name": "own", "description": "no"}],
        "safeguards": {"type": "no", "rule": "s"},
    }
    assert texts(body) == ["plain", "t", "r", "k", "n", "v", "w", "d", "e", "f", "s"]
    assert texts({"requests": [{"params": {"messages": [{"content": "a"}]}}], "result": {"message": {"content": [{"type": "text", "text": "b"}]}}}) == ["a", "b"]


@pytest.mark.parametrize(
    "body",
    ["{", '{"a":1} x', '{"a":1,"a":2}', r'{"a":1,"a":2}', r'{"a":"\ud800"}', '{"messages":[{"content":[{"type":"odd"}]}]}',
     '{"messages":[{"content":[{"type":"fallback","from":{"model":"a"},"to":{"model":1}}]}]}', '{"messages":[{"content":[{"type":"tool_result","content":[{"type":"tool_reference","extra":1}]}]}]}', "NaN"],
)
def test_fails_closed(body):
    with pytest.raises(BadBody):
        body_texts(body)


def test_reminders():
    text = "a<system-reminder>\n<total_tokens>9</system-reminder>b<system-reminder>other</system-reminder>"
    assert [t for t, scan in segments(text) if scan] == ["a", "b", "other"]
    context = "<system-reminder>As you answer the user's questions, you can use the following context:\n# claudeMd\nread\n# other\nnot\n</system-reminder>"
    assert [t for t, scan in segments(context) if scan] == ["read\n"]
    assert "".join(t for t, _ in segments(text)) == text and "".join(t for t, _ in segments(context)) == context


def test_only_changed_literals_change():
    body = '{ "a" : "x\\u00e9" , "n": 1.50, "b":"y"}'
    root = parse(body)
    out = put_back(body, [(v.start, v.end, v.text if k.text == "a" else "<é>") for k, v in root.items if v.kind == "string"])
    assert out == '{ "a" : "x\\u00e9" , "n": 1.50, "b":"\\u003cé\\u003e"}'


@given(st.text())
def test_literals_round_trip(text):
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "ignore")
    assert json.loads(encode(text)) == text and parse(encode(text)).text == text


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=20))
def test_parser_takes_what_json_takes(value):
    try:
        root = parse(json.dumps(value))
    except BadBody as e:
        assert "surrogate" in str(e)
    else:
        assert root.end == len(json.dumps(value))
