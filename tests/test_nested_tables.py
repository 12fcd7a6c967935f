"""The tables of payloads and results keep every field, the parent's key and the position."""

import json
import os

import duckdb
import pytest

from tallyforge.operators import nested
from tallyforge.plans import oracles, queries

SF = "/root/testdata/sf0.001"
CONDITION = {"field": "a", "operator": "IN", "values": ["1", 2, {"x": None}], "note": None}
ARGUMENTS = {"fields": ["f", "g"], "filters": {"and": [CONDITION, {"or": [{"field": "b", "values": "one"}]}]}, "topn": 3}
HISTORY = [
    {"role": "user", "content": [{"type": "text", "text": "hi"}]},
    "loose",
    {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "find", "arguments": json.dumps(ARGUMENTS)}}, {"id": "c2", "function": {"name": "cut", "arguments": '{"fields": ["f"'}}], "function_call": {"name": "old", "arguments": {"topn": 1}}},
    {"role": "tool", "tool_call_id": "c1", "content": '{"code": 0}'},
]


def table(spark, state=None, result=None):
    return spark.createDataFrame([(7, None if state is None else json.dumps({"state": state}), None if result is None else json.dumps(result))], "source_line long, payload string, result string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_messages_keep_content_and_kind(spark):
    got = rows(nested.messages(table(spark, {"history": HISTORY})), "source_line", "msg_pos", "kind", "role", "content", "value")
    assert got == [(7, 0, "object", "user", '[{"type": "text", "text": "hi"}]', None), (7, 1, "string", None, None, "loose"), (7, 2, "object", "assistant", None, None), (7, 3, "object", "tool", '{"code": 0}', None)]


def test_calls_arguments_and_fields(spark):
    df = table(spark, {"history": HISTORY})
    key = ("source_line", "msg_pos", "call_kind", "call_pos")
    assert rows(nested.calls(df), *key, "call_id", "name", "n_conditions", "reply_pos") == [(7, 2, "function_call", 0, None, "old", 0, -1), (7, 2, "tool_calls", 0, "c1", "find", 2, 3), (7, 2, "tool_calls", 1, "c2", "cut", 0, -1)]
    made = nested.call_arguments(df)
    assert rows(made, *key, "kind", "fields", "topn", "value") == [(7, 2, "function_call", 0, "object", None, "1", None), (7, 2, "tool_calls", 0, "object", '["f", "g"]', "3", None), (7, 2, "tool_calls", 1, "string", None, None, '{"fields": ["f"')]
    assert json.loads(made.where("topn = '3'").first()["filters"]) == ARGUMENTS["filters"]
    assert rows(nested.argument_fields(df), *key, "field_pos", "field") == [(7, 2, "tool_calls", 0, 0, "f"), (7, 2, "tool_calls", 0, 1, "g")]


def test_conditions_keep_values_and_place(spark):
    df = table(spark, {"messages": HISTORY})
    got = rows(nested.call_conditions(df).where("cond_pos >= 0"), "cond_pos", "field", "operator", "values", "path")
    assert got == [(0, "a", "IN", '["1", 2, {"x": null}]', "filters.and[]"), (1, "b", None, "one", "filters.and[].or[]")]
    assert rows(nested.condition_values(df), "msg_pos", "call_pos", "cond_pos", "value_pos", "value") == [(2, 0, 0, 0, "1"), (2, 0, 0, 1, "2"), (2, 0, 0, 2, '{"x":null}'), (2, 0, 1, 0, "one")]


def test_states_and_steps(spark):
    df = table(spark, json.dumps({"question": "q", "trace": {"hop": 1}, "current_plan": ["a", {"step": 2, "skill": "s"}, None]}))
    assert rows(nested.states(df), "source_line", "kind", "question") == [(7, "object", "q")]
    assert nested.states(df).first()["attrs"] == {"question": "q", "trace": '{"hop": 1}'}
    assert rows(nested.plan_steps(df), "step_pos", "kind", "step", "step_no", "skill") == [(0, "string", "a", None, None), (1, "object", None, "2", "s"), (2, "null", None, None, None)]
    assert rows(nested.states(table(spark, "text")), "kind", "value") == [("string", "text")]


def test_results_keep_answers_and_dotted_names(spark):
    answers = {"v1.2": {"type": "choice", "choice": "x", "confidence": 0.5, "probabilities": {"x": 0.5, "y.z": 0.5}}, "plain": {"type": "noul"}}
    made = nested.result_tables(table(spark, None, {"prediction": "x", "confidence": 0.5, "error": None, "raw_response": json.dumps({"model": "m", "answers": answers})}))
    assert rows(made.where("node_type = 'answer'"), "answer_pos", "answer", "attrs") == [(0, "v1.2", {"type": "choice", "choice": "x", "confidence": "0.5"}), (1, "plain", {"type": "noul"})]
    assert rows(made.where("node_type = 'probabilities'"), "answer_pos", "answer", "attrs") == [(0, "v1.2", {"x": "0.5", "y.z": "0.5"})]
    assert made.where("node_type = 'result'").first()["attrs"]["confidence"] == "0.5"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_hold_every_call_and_message(spark):
    """Counts of a plain walk over the same texts."""
    known = queries.queries()
    n = dict.fromkeys(("messages", "content", "calls", "named", "arguments", "fields", "values", "states"), 0)

    def opened(x):
        try:
            return json.loads(x) if isinstance(x, str) else x
        except ValueError:
            return x

    def conditions(x):
        if isinstance(x, dict):
            n["values"] += len(x.get("values", ())) if "field" in x else 0
            x = list(x.values())
        for y in x if isinstance(x, list) else ():
            conditions(y)

    for r in spark.read.parquet(f"{SF}/disagreements.parquet").select("payload").collect():
        payload = opened(r["payload"])
        state = opened(payload["state"])
        n["states"] += 1
        for m in state.get("history", state.get("messages")) or []:
            n["messages"] += 1
            n["content"] += m.get("content") is not None
            for c in (m.get("tool_calls") or []) + [x for x in [m.get("function_call")] if x]:
                f = c.get("function", c)
                a = opened(f.get("arguments"))
                n["calls"] += 1
                n["named"] += "name" in f
                n["arguments"] += "arguments" in f
                if isinstance(a, dict):
                    n["fields"] += len(a.get("fields", ()))
                    conditions(a.get("filters"))
    run = lambda name: known[name](spark, SF)
    assert n["values"] and n["fields"] and n == {
        "messages": run("p4_messages").count(), "content": run("p4_messages").where("content is not null").count(), "calls": run("p4_calls").count(), "named": run("p4_calls").where("name is not null").count(),
        "arguments": run("p4_arguments").count(), "fields": run("p4_argument_fields").count(), "values": run("p4_condition_values").count(), "states": run("p4_states").count(),
    }


def test_responses_keep_every_answer(spark, tmp_path):
    schema = "result_no long, raw_response struct<model:string,answers:map<string,struct<type:string,choice:string,confidence:double,probabilities:map<string,double>>>,usage:struct<input_tokens:bigint,output_tokens:bigint>>"
    answers = {"q1": ("choice", "x", 0.5, {"x": 0.5, "y": 0.25}), "q2": ("noul", "n", None, {}), "q3": ("noul", "n", 1.0, None)}
    spark.createDataFrame([(1, ("m", answers, None)), (2, None)], schema).write.parquet(f"{tmp_path}/results.parquet")
    known, sql = queries.queries(), oracles.oracle_sql()
    made = known["p4_response_answers"](spark, str(tmp_path))
    assert rows(made, "result_no", "model", "question", "type", "choice", "confidence") == [(1, "m", "q1", "choice", "x", 0.5), (1, "m", "q2", "noul", "n", None), (1, "m", "q3", "noul", "n", 1.0)]
    assert rows(made, "answer_pos") == [(0,), (1,), (2,)]
    made = known["p4_response_probabilities"](spark, str(tmp_path))
    assert rows(made, "question", "option", "probability") == [("q1", "x", 0.5), ("q1", "y", 0.25), ("q2", None, None), ("q3", None, None)]
    for name in ("p4_response_answers", "p4_response_probabilities"):
        df, c = known[name](spark, str(tmp_path)), duckdb.connect()
        c.execute(f"CREATE VIEW results AS SELECT * FROM '{tmp_path}/results.parquet/*.parquet'")
        done = c.execute(sql[name])
        assert [d[0] for d in done.description] == df.columns and sorted(done.fetchall(), key=str) == rows(df, *df.columns)
