import json

from tallyforge.operators.nested import call_conditions, call_nodes, nodes, plan_steps, result_tables, walk_nodes

SCHEMA = "source_line long, payload string, result string, pre long, msg_pos int"


def payload(history, key="history", as_text=False):
    state = {"question": "q", key: history}
    return json.dumps({"state": json.dumps(state) if as_text else state})


def call(arguments, id="c1", name="f"):
    return {"id": id, "type": "function", "function": {"name": name, "arguments": arguments}}


FILTERS = {"filters": {"and": [{"field": "a"}, {"or": [{"field": "b", "values": [{"field": "inner"}]}, {"x": 1}]}]}}


def rows(spark, *payloads):
    return spark.createDataFrame([(i, p, None, 0, 0) for i, p in enumerate(payloads)], SCHEMA)


def found(spark, *payloads):
    return sorted(tuple(r)[:5] for r in call_conditions(rows(spark, *payloads)).collect())


def test_conditions_in_reading_order_with_replies(spark):
    history = [
        {"role": "assistant", "tool_calls": [call(json.dumps(FILTERS)), call(None, "c2")]},
        {"role": "tool", "tool_call_id": "c2", "content": "{}"},
        {"role": "tool", "tool_call_id": "c1"},
        {"role": "tool", "tool_call_id": "c1"},
        {"role": "assistant", "tool_calls": [call(FILTERS, "c1")]},
    ]
    expected = [(0, 0, 0, 0, 2), (0, 0, 0, 1, 2), (0, 0, 0, 2, 2), (0, 0, 1, -1, 1), (0, 4, 0, 0, -1), (0, 4, 0, 1, -1), (0, 4, 0, 2, -1)]
    assert found(spark, payload(history)) == expected
    assert found(spark, payload(history, "messages", as_text=True)) == expected


def test_odd_shapes(spark):
    cut = '{"filters": {"and": [{"field": "a"'
    history = [
        "text", None, 5, {"role": "assistant", "tool_calls": None},
        {"role": "assistant", "function_call": {"name": "f", "arguments": {"filters": [{"field": "a", "note": None}]}}},
        {"role": "assistant", "function_call": None},
        {"role": "assistant", "tool_calls": [call(cut), call(""), call({"filters": None}), {"type": "function", "function": None}]},
    ]
    assert found(spark, payload(history)) == [(0, 4, 0, 0, -1), (0, 6, 0, -1, -1), (0, 6, 1, -1, -1), (0, 6, 2, -1, -1), (0, 6, 3, -1, -1)]
    assert found(spark, None, "", "not json", "[]", "3", payload("text"), payload(None), json.dumps({"state": None})) == []


def test_repeated_rows_empty_table_and_clashing_names(spark):
    one = payload([{"role": "assistant", "tool_calls": [call(FILTERS)]}])
    twice = rows(spark, one).union(rows(spark, one))
    assert call_conditions(twice).count() == 6
    assert call_conditions(rows(spark).limit(0)).count() == 0
    assert set(call_nodes(rows(spark, one)).columns) >= {"source_line", "msg_pos", "pre"}


def test_interval_labels_contain_children():
    made = walk_nodes({"a": [1, {"b": None}], "c": "x"}, lambda path: (path, None))
    by = {r[4] + str(r[7] or ""): r for r in made}
    root = by["$"]
    for r in made[1:]:
        assert root[0] < r[0] and r[1] < root[1]
    numbers = sorted([r[0] for r in made] + [r[1] for r in made])
    assert numbers == list(range(2 * len(made)))
    assert by["a[].b"][2] == by["a[]1"][0]


def test_deep_and_long_texts_and_lone_surrogates(spark):
    deep = {"field": "x"}
    for _ in range(300):
        deep = {"and": [deep]}
    one = payload([{"role": "assistant", "tool_calls": [call({"filters": deep})]}, {"role": "user", "content": "x" * 2_000_000}])
    assert found(spark, one) == [(0, 0, 0, 0, -1)]
    odd = '{"state": {"current_plan": ["a\\ud800b"]}}'
    assert [r["step"] for r in plan_steps(rows(spark, odd)).collect()] == ["a?b"]


def test_plan_and_result_tables(spark):
    df = spark.createDataFrame([(1, json.dumps({"state": {"current_plan": ["a", {"step": 2, "skill": "s"}]}}), json.dumps({"prediction": "p", "raw_response": json.dumps({"model": "m", "usage": {"input_tokens": 3}})}), 0, 0), (2, json.dumps({"state": {"current_plan": "one"}}), "{", 0, 0), (3, json.dumps({"state": {"current_plan": None}}), None, 0, 0)], SCHEMA)
    assert sorted((r["source_line"], r["step_pos"], r["step"], r["skill"]) for r in plan_steps(df).collect()) == [(1, 0, "a", None), (1, 1, None, "s"), (2, 0, "one", None)]
    made = {r["node_type"]: r for r in result_tables(df).collect()}
    assert made["usage"]["attrs"] == {"input_tokens": "3"} and made["raw_response"]["attrs"] == {"model": "m"}
    assert made["result"]["pre"] < made["usage"]["pre"] and made["usage"]["post"] < made["result"]["post"]


def test_required_field_prunes(spark):
    df = rows(spark, json.dumps({"a": [{"k": 1}, {"z": 1}, "text"]}))
    assert [r["pos"] for r in nodes(df, "source_line", "payload", {"e": (r"a\[\]", "k")}).collect()] == [0]
