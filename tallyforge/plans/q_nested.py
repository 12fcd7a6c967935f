"""Nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import nested
from tallyforge.plans.catalog import query


def _open(j: str) -> str:
    """A JSON text that spells a container, as that container."""
    return f"CASE WHEN json_type({j}) = 'VARCHAR' AND coalesce(json_type(TRY_CAST({j} ->> '$' AS JSON)) IN ('OBJECT', 'ARRAY'), false) THEN TRY_CAST({j} ->> '$' AS JSON) ELSE {j} END"


_MESSAGES = f"""r AS (SELECT row_number() OVER () AS rec, source_line, payload AS p FROM disagreements WHERE json_valid(payload)),
s AS (SELECT rec, source_line, {_open("json_extract(p, '$.state')")} AS st FROM r),
l AS (SELECT rec, source_line, st, {_open("json_extract(st, '$.history')")} AS h, {_open("json_extract(st, '$.messages')")} AS m FROM s),
a AS (SELECT rec, source_line, CASE WHEN json_type(h) = 'ARRAY' AND json_array_length(h) > 0 THEN 'history' ELSE 'messages' END AS list, CASE WHEN json_type(h) = 'ARRAY' AND json_array_length(h) > 0 THEN h WHEN json_type(m) = 'ARRAY' THEN m END AS items FROM l),
e AS (SELECT rec, source_line, list, i AS msg_pos, {_open("json_extract(items, '$[' || i || ']')")} AS j FROM (SELECT *, unnest(range(json_array_length(items)::BIGINT)) AS i FROM a WHERE items IS NOT NULL))"""
_CALLS = f"""{_MESSAGES},
tc AS (SELECT *, {_open("json_extract(j, '$.tool_calls')")} AS many, {_open("json_extract(j, '$.function_call')")} AS one FROM e WHERE json_type(j) = 'OBJECT'),
c AS (SELECT rec, source_line, msg_pos, 'tool_calls' AS call_kind, i AS call_pos, {_open("json_extract(many, '$[' || i || ']')")} AS call FROM (SELECT *, unnest(range(json_array_length(many)::BIGINT)) AS i FROM tc WHERE json_type(many) = 'ARRAY')
    UNION ALL SELECT rec, source_line, msg_pos, 'function_call', 0, one FROM tc WHERE one IS NOT NULL AND json_type(one) <> 'NULL'),
f AS (SELECT *, {_open("json_extract(call, '$.function')")} AS fn FROM c),
k AS (SELECT *, {_open("coalesce(json_extract(fn, '$.arguments'), json_extract(call, '$.arguments'))")} AS args, call ->> '$.id' AS call_id,
    coalesce((SELECT min(e.msg_pos) FROM e WHERE e.rec = f.rec AND e.msg_pos > f.msg_pos AND json_type(e.j) = 'OBJECT' AND e.j ->> '$.role' = 'tool' AND e.j ->> '$.tool_call_id' = f.call ->> '$.id'), -1) AS reply_pos FROM f)"""
_FOUND = f"""WITH {_CALLS},
g AS (SELECT *, {_open("json_extract(args, '$.filters')")} AS filters FROM k),
x AS (SELECT rec, msg_pos, call_kind, call_pos, row_number() OVER (PARTITION BY rec, msg_pos, call_kind, call_pos ORDER BY t.id) - 1 AS cond_pos FROM g, json_tree(g.filters) t WHERE t.type = 'OBJECT' AND json_exists(t.value, '$.field'))
SELECT k.source_line, k.msg_pos, k.call_pos, coalesce(x.cond_pos, -1) AS cond_pos, k.reply_pos FROM k LEFT JOIN x USING (rec, msg_pos, call_kind, call_pos)"""


@query(_FOUND)
def p4_found(t):
    return nested.call_conditions(t.disagreements).select("source_line", "msg_pos", "call_pos", "cond_pos", "reply_pos")


@query(
    f"""WITH {_CALLS},
    g AS (SELECT *, {_open("json_extract(args, '$.filters')")} AS filters FROM k)
    SELECT source_line, msg_pos, call_kind, call_pos, row_number() OVER (PARTITION BY rec, msg_pos, call_kind, call_pos ORDER BY t.id) - 1 AS cond_pos, CASE WHEN json_type(t.value, '$.field') IN ('OBJECT', 'ARRAY') THEN '' ELSE t.value ->> '$.field' END AS field, t.value ->> '$.operator' AS operator,
    CASE WHEN json_type(t.value, '$.values') = 'ARRAY' THEN json_array_length(t.value, '$.values')::INT END AS n_values FROM g, json_tree(g.filters) t WHERE t.type = 'OBJECT' AND json_exists(t.value, '$.field')"""
)
def p4_condition_parts(t):
    """The conditions with field, operator and how many values each lists."""
    rows = nested.call_conditions(t.disagreements).where("cond_pos >= 0")
    listed = F.when(F.col("values").startswith("["), F.size(nested.entries(F.col("values"))))
    return rows.select("source_line", "msg_pos", "call_kind", "call_pos", "cond_pos", F.when(F.col("field").startswith("{") | F.col("field").startswith("["), "").otherwise(F.col("field")).alias("field"), "operator", listed.alias("n_values"))


@query(f"WITH {_MESSAGES} SELECT source_line, msg_pos, list, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, CASE WHEN json_type(j) = 'OBJECT' THEN j ->> '$.role' END AS role, CASE WHEN json_type(j) = 'OBJECT' THEN j ->> '$.tool_call_id' END AS tool_call_id FROM e")
def p4_message_links(t):
    """The messages without their contents."""
    return nested.messages(t.disagreements).select("source_line", "msg_pos", "list", "kind", "role", "tool_call_id")


@query(f"WITH {_CALLS} SELECT source_line, msg_pos, call_kind, call_pos, call_id, coalesce(fn ->> '$.name', call ->> '$.name') AS name, reply_pos FROM k")
def p4_call_links(t):
    """The calls without their arguments."""
    return nested.calls(t.disagreements).select("source_line", "msg_pos", "call_kind", "call_pos", "call_id", "name", "reply_pos")


@query(f"""WITH {_MESSAGES.split(chr(10) + 'l AS')[0]} SELECT source_line, step_pos, kind, CASE WHEN kind = 'string' THEN j ->> '$' END AS step, CASE WHEN kind = 'object' THEN j ->> '$.skill' END AS skill FROM (SELECT source_line, step_pos, j, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' ELSE 'other' END AS kind FROM (
    SELECT source_line, 0 AS step_pos, plan AS j FROM (SELECT source_line, {_open("json_extract(st, '$.current_plan')")} AS plan FROM s) WHERE json_type(plan) NOT IN ('ARRAY', 'NULL') UNION ALL
    SELECT source_line, i, {_open("json_extract(plan, '$[' || i || ']')")} FROM (SELECT source_line, plan, unnest(range(json_array_length(plan)::BIGINT)) AS i FROM (SELECT source_line, {_open("json_extract(st, '$.current_plan')")} AS plan FROM s) WHERE json_type(plan) = 'ARRAY')))""")
def p4_steps(t):
    """The plan steps as texts and skills."""
    return nested.plan_steps(t.disagreements).select("source_line", "step_pos", "kind", "step", "skill")


@query(f"WITH {_MESSAGES.split(chr(10) + 'l AS')[0]} SELECT source_line, CASE WHEN json_type(st) = 'OBJECT' THEN 'object' ELSE 'string' END AS kind, CASE WHEN json_type(st) = 'OBJECT' THEN st ->> '$.question' END AS question FROM s WHERE st IS NOT NULL")
def p4_state_questions(t):
    return nested.states(t.disagreements).select("source_line", "kind", "question")


@query("SELECT source_line, CASE WHEN source_line % 3 = 0 THEN 'null' WHEN source_line % 3 = 1 THEN 'not JSON' END AS reason FROM disagreements WHERE source_line % 3 < 2")
def p4_rejects(t):
    """Payloads of which a third is taken away and a third cut off: each comes out as a reject with its reason."""
    cut = F.when(F.col("source_line") % 3 == 1, F.expr("substring(payload, 1, length(payload) - 1)")).when(F.col("source_line") % 3 == 2, F.col("payload"))
    return nested.rejects(t.disagreements.select("source_line", cut.alias("payload")), "source_line", "payload")


@query()
def p4_conditions(t):
    return nested.call_conditions(t.disagreements)


@query()
def p4_messages(t):
    return nested.messages(t.disagreements)


@query()
def p4_states(t):
    return nested.states(t.disagreements)


@query()
def p4_calls(t):
    return nested.calls(t.disagreements)


@query()
def p4_arguments(t):
    return nested.call_arguments(t.disagreements)


_ENTRIES = "SELECT *, unnest(range(CASE WHEN json_type({0}) = 'ARRAY' THEN json_array_length({0})::BIGINT ELSE 1 END)) AS i FROM {1} WHERE {0} IS NOT NULL AND json_type({0}) <> 'NULL'".format
_ENTRY = "CASE WHEN json_type({0}) = 'ARRAY' THEN {0} ->> ('$[' || i || ']') ELSE {0} ->> '$' END".format


@query(f"""WITH {_CALLS}, c2 AS (SELECT *, {_open("json_extract(args, '$.fields')")} AS fs FROM k WHERE json_type(args) = 'OBJECT'), b AS ({_ENTRIES("fs", "c2")})
    SELECT source_line, msg_pos, call_kind, call_pos, i::INT AS field_pos, {_ENTRY("fs")} AS field FROM b""")
def p4_argument_fields(t):
    return nested.argument_fields(t.disagreements)


@query(f"""WITH {_CALLS}, g AS (SELECT *, {_open("json_extract(args, '$.filters')")} AS filters FROM k),
    c2 AS (SELECT source_line, msg_pos, call_kind, call_pos, row_number() OVER (PARTITION BY rec, msg_pos, call_kind, call_pos ORDER BY t.id) - 1 AS cond_pos, {_open("json_extract(t.value, '$.values')")} AS vs FROM g, json_tree(g.filters) t WHERE t.type = 'OBJECT' AND json_exists(t.value, '$.field')), b AS ({_ENTRIES("vs", "c2")})
    SELECT source_line, msg_pos, call_kind, call_pos, cond_pos, i::INT AS value_pos, {_ENTRY("vs")} AS value FROM b""")
def p4_condition_values(t):
    return nested.condition_values(t.disagreements)


@query()
def p4_plan_steps(t):
    return nested.plan_steps(t.disagreements)


@query(
    """WITH r AS (SELECT source_line, result, json_extract_string(result, '$.raw_response') x FROM disagreements WHERE json_valid(result)), u AS (SELECT *, CASE WHEN json_valid(x) THEN json_extract_string(x, '$.usage') END y FROM r)
    SELECT source_line, json_extract_string(result, '$.prediction') AS prediction, CASE WHEN json_valid(x) THEN json_extract_string(x, '$.model') END AS model,
    CASE WHEN json_valid(y) THEN json_extract_string(y, '$.input_tokens')::BIGINT END AS input_tokens, CASE WHEN json_valid(y) THEN json_extract_string(y, '$.output_tokens')::BIGINT END AS output_tokens FROM u"""
)
def p4_results(t):
    rows = nested.result_tables(t.disagreements)
    of = lambda kind, field: F.max(F.when(F.col("node_type") == kind, F.col("attrs")[field]))
    return rows.groupBy("source_line", "record").agg(
        of("result", "prediction").alias("prediction"), of("raw_response", "model").alias("model"), of("usage", "input_tokens").cast("long").alias("input_tokens"), of("usage", "output_tokens").cast("long").alias("output_tokens")
    ).drop("record")


@query(
    """SELECT source_line, json_extract_string(result, '$.id') AS id, json_extract_string(result, '$.prediction') AS prediction, json_extract_string(result, '$.confidence')::DOUBLE AS confidence,
    json_extract_string(result, '$.latency_ms')::DOUBLE AS latency_ms, json_extract_string(result, '$.attempts')::BIGINT AS attempts, json_extract_string(result, '$.error') AS error FROM disagreements WHERE json_valid(result)"""
)
def p4_result_records(t):
    attrs = F.col("attrs")
    rows = nested.result_tables(t.disagreements).where("node_type = 'result'")
    return rows.select("source_line", attrs["id"].alias("id"), attrs["prediction"].alias("prediction"), *(F.expr(f"try_cast(attrs['{c}'] AS {kind})").alias(c) for c, kind in (("confidence", "double"), ("latency_ms", "double"), ("attempts", "long"))), attrs["error"].alias("error"))


_RESPONSE = "r AS (SELECT source_line, json_extract_string(result, '$.raw_response') x FROM disagreements WHERE json_valid(result)), a AS (SELECT source_line, json_extract(x, '$.answers') y, unnest(json_keys(x, '$.answers')) question, generate_subscripts(json_keys(x, '$.answers'), 1) - 1 answer_pos FROM r WHERE json_valid(x)), b AS (SELECT source_line, answer_pos, question, json_extract(y, '$.\"' || question || '\"') z FROM a)"


@query(
    f"""WITH {_RESPONSE} SELECT source_line, answer_pos, question, json_extract_string(z, '$.type') AS type, json_extract_string(z, '$.choice') AS choice, json_extract_string(z, '$.confidence')::DOUBLE AS confidence FROM b"""
)
def p4_result_answers(t):
    attrs = F.col("attrs")
    rows = nested.result_tables(t.disagreements).where("node_type = 'answer'")
    return rows.select("source_line", "answer_pos", F.col("answer").alias("question"), attrs["type"].alias("type"), attrs["choice"].alias("choice"), F.expr("try_cast(attrs['confidence'] AS double)").alias("confidence"))


@query(
    f"""WITH {_RESPONSE}, p AS (SELECT source_line, answer_pos, question, json_extract(z, '$.probabilities') q, unnest(json_keys(z, '$.probabilities')) "option", generate_subscripts(json_keys(z, '$.probabilities'), 1) - 1 option_pos FROM b)
    SELECT source_line, answer_pos, question, option_pos::INT AS option_pos, "option", json_extract_string(q, '$."' || "option" || '"')::DOUBLE AS probability FROM p"""
)
def p4_result_probabilities(t):
    rows = nested.result_tables(t.disagreements).where("node_type = 'probabilities'")
    return rows.select("source_line", "answer_pos", F.col("answer").alias("question"), F.posexplode("attrs").alias("option_pos", "option", "p")).select("source_line", "answer_pos", "question", "option_pos", "option", F.expr("try_cast(p AS double)").alias("probability"))


@query(
    """WITH r AS (SELECT source_line, json_extract_string(result, '$.raw_response') x FROM disagreements WHERE json_valid(result)), u AS (SELECT source_line, json_extract(x, '$.usage') y FROM r WHERE json_valid(x))
    SELECT source_line, json_extract_string(y, '$.input_tokens')::BIGINT AS input_tokens, json_extract_string(y, '$.output_tokens')::BIGINT AS output_tokens FROM u WHERE json_type(y) = 'OBJECT'"""
)
def p4_result_usage(t):
    rows = nested.result_tables(t.disagreements).where("node_type = 'usage' AND kind = 'object'")
    return rows.select("source_line", *(F.expr(f"try_cast(attrs['{c}'] AS long)").alias(c) for c in ("input_tokens", "output_tokens")))


@query(
    """SELECT result_no, raw_response.model AS model, unnest(map_keys(raw_response.answers)) AS question, NULL::VARCHAR AS option FROM results WHERE false
    UNION ALL SELECT result_no, model, question, unnest(map_keys(probabilities)) FROM (SELECT result_no, raw_response.model AS model, unnest(map_keys(raw_response.answers)) AS question, unnest(map_values(raw_response.answers)).probabilities AS probabilities FROM results)"""
)
def p4_answers(t):
    return nested.response_answers(t.results).where("option is not null").select("result_no", "model", "question", "option")


@query(
    """SELECT result_no, (p - 1)::INT AS answer_pos, model, e[p].key AS question, e[p].value.type AS type, e[p].value.choice AS choice, e[p].value.confidence AS confidence
    FROM (SELECT result_no, raw_response.model AS model, map_entries(raw_response.answers) e, unnest(range(1, len(map_entries(raw_response.answers)) + 1)) p FROM results)"""
)
def p4_response_answers(t):
    return nested.answer_rows(t.results).drop("probabilities")


@query(
    """WITH a AS (SELECT result_no, map_entries(raw_response.answers) e, unnest(range(1, len(map_entries(raw_response.answers)) + 1)) p FROM results), o AS (SELECT result_no, (p - 1)::INT AS answer_pos, e[p].key AS question, map_entries(e[p].value.probabilities) e FROM a),
    x AS (SELECT *, unnest(CASE WHEN len(e) > 0 THEN range(1, len(e) + 1) ELSE [NULL] END) p FROM o)
    SELECT result_no, answer_pos, question, (p - 1)::INT AS option_pos, e[p].key AS "option", e[p].value AS probability FROM x"""
)
def p4_response_probabilities(t):
    """An answer without probabilities has one row whose option is null."""
    return nested.response_answers(t.results).select("result_no", "answer_pos", "question", "option_pos", "option", "probability")


@query("SELECT result_no, raw_response.model AS model, raw_response.usage.input_tokens AS input_tokens, raw_response.usage.output_tokens AS output_tokens FROM results WHERE raw_response.usage IS NOT NULL")
def p4_usage(t):
    return nested.response_usage(t.results)
