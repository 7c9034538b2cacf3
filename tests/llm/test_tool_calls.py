import json

import pytest

from helpers import clashing
from placerank.llm import tool_calls as t

CALLS = "conv_id long, turn long, call_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, content string"
TOOLS = "name string, schema string"
NEEDS = "conv_id long, call_id string, needed_id string"
SCHEMA = json.dumps({"type": "object", "required": ["a"], "properties": {
    "a": {"type": "integer", "minimum": 1}, "b": {"type": ["string", "null"], "maxLength": 3}, "c": {"type": "array", "items": {"enum": [1, "x"]}}},
    "additionalProperties": False})


def test_canonical():
    assert t.canonical({"b": [1.0, -0.5, 1e30, True, None], "a": "é\n\"", "\U0001f600": 1, "דּ": 2}) == \
        '{"a":"é\\n\\"","b":[1,-0.5,1e+30,true,null],"\U0001f600":1,"דּ":2}'


def test_numbers():
    for text, want in [("1e-7", "1e-7"), ("1.5e-9", "1.5e-9"), ("0.00001", "0.00001"), ("1e-6", "0.000001"), ("123e20", "1.23e+22"), ("1e20", "1" + "0" * 20),
                       ("-0.0", "0"), ("-2.50", "-2.5"), ("1e21", "1e+21"), ("333333333.33333329", "333333333.3333333"), ("12345678901234567890", "12345678901234567890")]:
        assert t.canonical(json.loads(text)) == want


def test_schemas():
    schema = json.loads(SCHEMA)
    good = [{"a": 1}, {"a": 2.0, "b": None, "c": [1, "x"]}]
    bad = [[], {"a": 0}, {"a": True}, {"b": "x"}, {"a": 1, "b": "long"}, {"a": 1, "c": [2]}, {"a": 1, "d": 1}, {"a": "1"}]
    assert not any(t.invalid(v, schema) for v in good) and all(t.invalid(v, schema) for v in bad)
    assert t.invalid(True, {"enum": [1]}) and not t.invalid(1.0, {"enum": [1]}) and t.invalid(0, {"const": False})
    assert t.invalid({"a": 1}, {"properties": {"a": False}}) and not t.invalid([1], {"items": True}) and t.invalid(1, False)
    for text in ("1", "null", "[]", '"object"', '{"type":"thing"}', '{"type":[]}', '{"type":{}}', '{"properties":[]}', '{"required":"a"}', '{"required":[1]}',
                 '{"minimum":"1"}', '{"items":3}', '{"properties":{"a":{"type":"x"}}}', '{"enum":1}', "{", "NaN", '{"maximum":1e999}'):
        with pytest.raises(ValueError):
            t.read_schema(text)


def link(spark, calls, results, tools=((("f"), SCHEMA),), needs=()):
    make = lambda rows, ddl: clashing(spark.createDataFrame(list(rows), ddl).repartition(3), "level", "status", "g")
    return {(r.conv_id, r.call_id): r for r in t.link_tool_calls(
        make(calls, CALLS), make(results, RESULTS), make(tools, TOOLS), make(needs, NEEDS)).collect()}


def test_statuses(spark):
    ok = '{"a":1}'
    calls = [(1, 1, "ok", "f", ok), (1, 1, "bad", "f", '{"a":0}'), (1, 1, "json", "f", "{"), (1, 1, "nan", "f", '{"a":NaN}'), (1, 1, "tool", "g", ok),
             (1, 2, "twice", "f", ok), (1, 1, "twice", "f", '{"a":2}'), (1, 3, "late", "f", ok), (1, 1, "none", "f", ok), (1, 1, "null", None, None),
             (None, 1, "x", "f", ok), (1, None, "turn", "f", ok), (2, 1, "ok", "f", None)]
    results = [(1, 2, "ok", "r"), (1, 5, "ok", "q"), (1, 2, "late", "r"), (1, 9, "who", "r"), (1, 9, None, "r"), (1, 2, "turn", None), (1, 3, "twice", "é")]
    got = link(spark, calls, results)
    status = {k: r.status for k, r in got.items()}
    assert status == {(1, "ok"): "ok", (1, "bad"): "invalid_arguments", (1, "json"): "invalid_arguments", (1, "nan"): "invalid_arguments",
                      (1, "tool"): "unknown_tool", (1, "twice"): "ok", (1, "late"): "result_before_call", (1, "none"): "missing_result",
                      (1, "null"): "unknown_tool", (None, "x"): "no_id", (1, "turn"): "ok", (1, "who"): "orphan_result", (1, None): "orphan_result",
                      (2, "ok"): "invalid_arguments"}
    assert got[1, "twice"].n_calls == 2 and got[1, "ok"].n_results == 2
    assert got[1, "twice"].record == '{"arguments":{"a":2},"conversation":1,"id":"twice","name":"f","result":"é"}'
    assert got[2, "ok"].error == "$.a: missing"


def test_awkward_json_ends_no_job(spark):
    rule, deep = '{"properties":{"a":{"type":"integer"},"x":{"type":"number"}}}', "[" * 100_000
    texts = {"inf": '{"a":1e999}', "number": '{"x":-1e999}', "half": '{"x":"\\ud800"}', "key": '{"\\udfff":1}', "deep": deep, "digits": "9" * 6000,
             "text": "\u0001", "empty": "", "good": '{"a":1e3,"x":1e-7}', "pair": '{"a":1,"y":"\\ud83d\\ude00"}'}
    calls = [(1, 1, k, "f", v) for k, v in texts.items()] + [(1, 1, f"by-{n}", n, "{}") for n in ("yes", "no", "odd", "kind", "none")]
    tools = [("f", rule), ("yes", "true"), ("no", "false"), ("odd", "[1]"), ("kind", '{"type":"thing"}'), ("none", None)]
    got = link(spark, calls, [(1, 2, c[2], "r") for c in calls], tools)
    status = {k[1]: (r.status, r.error) for k, r in got.items()}
    bad = "invalid_arguments"
    assert status == {
        "inf": (bad, "not a JSON number"), "number": (bad, "not a JSON number"), "half": (bad, "not Unicode"), "key": (bad, "not Unicode"),
        "deep": (bad, "too deep"), "digits": (bad, "not JSON"), "text": (bad, "not JSON"), "empty": ("ok", None), "good": ("ok", None), "pair": ("ok", None),
        "by-yes": ("ok", None), "by-no": (bad, "$: not allowed"), "by-odd": ("bad_schema", None), "by-kind": ("bad_schema", None), "by-none": ("unknown_tool", None)}
    assert got[1, "half"].record.startswith('{"arguments":"{\\"x\\":')
    assert got[1, "good"].record == '{"arguments":{"a":1000,"x":1e-7},"conversation":1,"id":"good","name":"f","result":"r"}'


def test_results_without_identifiers_stay(spark):
    rows = [(1, 9, None, "a"), (None, 9, "x", "b"), (None, None, None, None), (None, 9, "x", "b")]
    make = lambda r, ddl: spark.createDataFrame(r, ddl)
    got = t.link_tool_calls(make([(None, None, None, None, None)], CALLS), make(rows, RESULTS), make([], TOOLS), make([], NEEDS)).collect()
    assert sorted((r.status, r.n_calls, r.n_results, r.turn or 0) for r in got) == [("no_id", 1, 0, 0)] + [("orphan_result", 0, 1, n) for n in (0, 9, 9, 9)]


def brute_levels(nodes, needs):
    below = {n: [d for v, d in needs if v == n and d in nodes] for n in nodes}
    level = {n: 0 for n in nodes}
    for _ in range(len(nodes) + 1):
        level = {n: max([level[d] + 1 for d in below[n]], default=0) for n in nodes}
    return {n: None if v > len(nodes) - 1 else v for n, v in level.items()}


def test_levels(spark):
    import random

    rng = random.Random(7)
    nodes = [f"n{i}" for i in range(60)]
    needs = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 40) for _ in range(2)] + [(f"n{i}", f"n{i - 1}") for i in range(40, 55)]
    needs += [("n3", "gone"), ("n56", "n57"), ("n57", "n56"), ("n58", "n56"), ("n58", "n2"), ("n59", "n59")]
    calls = spark.createDataFrame([(1, n) for n in nodes] + [(2, "n1")], "conv_id long, call_id string")
    edges = spark.createDataFrame([(1, a, b) for a, b in needs], NEEDS)
    got = {r.call_id: r.level for r in t.levels(calls, edges).where("conv_id = 1").collect()}
    want = brute_levels(nodes, needs)
    for n in ("n56", "n57", "n58", "n59"):
        want[n] = None
    assert got == want


def test_empty_and_turns(spark):
    assert link(spark, [], [], (), ()) == {}
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, "user", None), (None, 1, "user", "x"), (2, 5, "assistant", "lost")]
    got = {(r.conv_id, r.call_id): (r.level, r.status) for r in t.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, "1-1"): (0, "ok"), (1, "1-3"): (1, "unknown_tool"), (None, None): (None, "no_id"), (2, "2-4"): (None, "orphan_result")}
