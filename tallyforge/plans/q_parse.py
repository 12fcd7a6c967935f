"""Parsing and rewriting of logs, answers and records; files read and written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyforge.functions import parse as pr
from tallyforge.functions import stats
from tallyforge.operators import validate as va
from tallyforge.operators.stages import shared_folder
from tallyforge.plans.catalog import query
from tallyforge.sources import jsonl

_TEXT = lambda c: F.to_json(F.struct(F.lit(0).alias("index"), F.struct(c.alias("content")).alias("delta")))


def _stream(first, second, done: bool = True):
    """An event stream that says two texts, with CRLF line ends, a comment and a usage event."""
    event = lambda c: F.concat(F.lit('data: {"choices": ['), _TEXT(c), F.lit("]}\r\n\r\n"))
    usage = F.concat(F.lit('data: {"choices": [], "usage": {"prompt_tokens": 7, "completion_tokens": '), F.length(first).cast("string"), F.lit("}}\r\n\r\n"))
    return F.concat(F.lit(": keep-alive\r\n\r\n"), event(first), event(second), usage, F.lit("data: [DONE]\r\n\r\n" if done else ""))


@query("SELECT gold_no, question AS content, 7.0::DOUBLE AS prompt_tokens, (length(question) // 2)::DOUBLE AS completion_tokens FROM gold_template WHERE question IS NOT NULL")
def streamed_answers(t):
    q, half = F.col("question"), F.floor(F.length("question") / 2).cast("int")
    rows = t.gold_template.where(q.isNotNull()).withColumn("body", _stream(F.substring(q, F.lit(1), half), F.substring(q, half + 1, F.length(q))))
    folded = rows.withColumn("r", pr.fold_events(pr.events(F.col("body"))))
    return folded.select("gold_no", "r.content", "r.prompt_tokens", "r.completion_tokens")


@query("SELECT gold_no, 3::INT AS events, gold_no % 2 = 0 AS complete FROM gold_template WHERE question IS NOT NULL")
def stream_events(t):
    q = F.col("question")
    body = F.when(F.col("gold_no") % 2 == 0, _stream(q, F.lit("x"))).otherwise(_stream(q, F.lit("x"), done=False))
    rows = t.gold_template.where(q.isNotNull()).withColumn("body", body)
    return rows.select("gold_no", F.size(pr.sse_texts(F.col("body"))).alias("events"), pr.sse_complete(F.col("body")).alias("complete"))


@query("SELECT gold_no, question AS task, 'the plan' AS plan, CASE WHEN phase = 'initial' THEN 'initial' ELSE 'followup' END AS phase FROM gold_template WHERE question IS NOT NULL")
def task_texts(t):
    none = F.lit(None).cast("string")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"), none.alias("tool_call_id"), F.lit(None).cast(f"array<{pr.CALL}>").alias("tool_calls"))
    user = message("user", F.concat(F.lit("Plan it.\n<task>"), F.col("question"), F.lit("</task>\nthe plan")))
    messages = F.when(F.col("phase") == "initial", F.array(message("system", F.lit("You route.")), user)).otherwise(F.array(user, message("assistant", F.lit("Next."))))
    rows = t.gold_template.where("question is not null").withColumn("m", messages)
    return rows.select("gold_no", pr.task_text(F.col("m")).alias("task"), pr.after_task(F.col("m")).alias("plan"), pr.phase(F.col("m")).alias("phase"))


@query(
    """SELECT result_no, CASE WHEN error IS NOT NULL OR raw_response IS NULL THEN NULL WHEN prediction = 'none_of_these' THEN '__no_skill__' ELSE prediction END AS label FROM results"""
)
def baseline_labels(t):
    names = F.when((F.col("prediction") != "none_of_these") & F.col("prediction").isNotNull(), F.array("prediction", "prediction")).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("error").isNull() & F.col("raw_response").isNotNull(), 200).otherwise(500)
    content = F.when(F.col("prediction") == "none_of_these", F.lit("nothing to call"))
    return t.results.select("result_no", pr.baseline_label(names, content, status).alias("label"))


@query("""SELECT source_line, len(regexp_extract_all(payload, '"name":"([^"]+)"', 1))::INT AS names, regexp_extract_all(replace(payload, '"name": "', '"name":"'), '"name":"([^"]+)"', 1) AS spaced FROM disagreements WHERE payload IS NOT NULL""")
def called_tools(t):
    rows = t.disagreements.where("payload is not null")
    return rows.select("source_line", F.size(pr.tool_names(F.col("payload"))).alias("names"), pr.tool_names(F.replace("payload", F.lit('"name": "'), F.lit('"name":"'))).alias("spaced"))


@query("SELECT source_line, json_extract_string(result, '$.raw_response.usage.input_tokens')::DOUBLE AS prompt, json_extract_string(result, '$.raw_response.usage.output_tokens')::DOUBLE AS completion FROM disagreements")
def usage_numbers(t):
    usage = F.get_json_object("result", "$.raw_response.usage")
    return t.disagreements.select("source_line", pr.usage_tokens(usage, "prompt").alias("prompt"), pr.usage_tokens(usage, "completion").alias("completion"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS queue, l_extendedprice AS model, round(l_quantity + l_extendedprice, 6) AS total FROM lineitem")
def timing_headers(t):
    header = F.concat(F.lit("queue;dur="), F.col("l_quantity").cast("string"), F.lit(", model;dur="), F.col("l_extendedprice").cast("string"))
    m = pr.timing_header(header)
    return t.lineitem.select("l_orderkey", "l_linenumber", m["queue"].alias("queue"), m["model"].alias("model"), F.round(m["queue"] + m["model"], 6).alias("total"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')))::INT AS tokens FROM documents WHERE text IS NOT NULL")
def token_sets(t):
    return t.documents.where("text is not null").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0))).alias("tokens"))


@query(
    """SELECT record_no, CASE WHEN k = 'choice' AND json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') WHEN k = 'noul' AND json_type(x) = 'BOOLEAN' THEN x::VARCHAR WHEN k = 'score' AND json_type(x) IN ('UBIGINT', 'BIGINT') THEN x::VARCHAR END AS target_key
    FROM (SELECT record_no, input.questions['decision'].type k, CASE WHEN json_valid(reference.target) THEN reference.target::JSON END x FROM decision_records)"""
)
def target_keys(t):
    return t.decision_records.select("record_no", pr.target_key(F.col("reference.target"), F.col("input.questions")["decision"]["type"]).alias("target_key"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS family FROM documents WHERE text IS NOT NULL")
def short_hashes(t):
    return t.documents.where("text is not null").select("doc_id", pr.short_hash(F.col("text")).alias("family"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> '') AS cells FROM part")
def split_cells(t):
    return t.part.select("p_partkey", pr.csv_cell(F.concat("p_name", F.lit(", ,"), "p_type")).alias("cells"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') / count(*) AS a, count(*) FILTER (l_returnflag = 'N') / count(*) AS n, count(*) FILTER (l_returnflag = 'R') / count(*) AS r FROM lineitem GROUP BY 1")
def vote_shares(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("votes")).withColumn("s", pr.vote_share(F.col("votes"), ["A", "N", "R"]))
    return rows.select("l_orderkey", *(F.col("s")[x].alias(x.lower()) for x in "ANR"))


@query("SELECT l_orderkey, l_linenumber, (greatest(0, least(4, floor(l_quantity / 10 + 0.5) - 1)))::INT AS level, l_discount >= 0.05 AS target FROM lineitem")
def levels_and_cuts(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", stats.half_up_level(F.col("l_quantity") / 10).alias("level"), pr.binarise(F.col("l_discount"), 0.05)["target"].alias("target"))


@query("SELECT record_no, list_transform(list_sort(list_transform(json_keys(input.questions['decision'].criteria), lambda c: {'k': sha256('11:' || id || ':' || c), 'c': c})), lambda x: x.c) AS choices FROM decision_records WHERE input.questions['decision'].type = 'choice'")
def permuted_choices(t):
    rows = t.decision_records.where(F.col("input.questions")["decision"]["type"] == "choice")
    return rows.select("record_no", pr.permuted(F.json_object_keys(F.col("input.questions")["decision"]["criteria"]), F.col("id"), 11).alias("choices"))


@query("SELECT record_no, list_transform(range(len(k)), lambda i: chr((65 + i)::INT) || '=' || k[i + 1]) AS codes FROM (SELECT record_no, json_keys(input.questions['decision'].criteria) k FROM decision_records WHERE input.questions['decision'].type = 'choice')")
def letter_codes(t):
    rows = t.decision_records.where(F.col("input.questions")["decision"]["type"] == "choice")
    codes = pr.letter_codes(F.json_object_keys(F.col("input.questions")["decision"]["criteria"]))
    return rows.select("record_no", F.transform(codes, lambda x: F.concat(x["letter"], F.lit("="), x["choice"])).alias("codes"))


@query("SELECT result_no, CASE WHEN list_contains(['find_cells', 'read_kpi'], prediction) THEN prediction END AS label, CASE WHEN list_contains(['find_cells', 'read_kpi'], prediction) THEN round(confidence, 9) END AS confidence FROM results WHERE prediction IS NOT NULL AND confidence BETWEEN 0 AND 1")
def label_answers(t):
    text = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("prediction").alias("label"), (F.col("confidence") * 100).alias("confidence"))), F.lit("\n```"))
    rows = t.results.where("prediction is not null and confidence between 0 and 1").withColumn("a", pr.label_answer(text, F.array(F.lit("find_cells"), F.lit("read_kpi"))))
    return rows.select("result_no", "a.label", F.round("a.confidence", 9).alias("confidence"))


@query("SELECT result_no, CASE WHEN prediction IS NOT NULL AND attempts = 1 THEN 'b' END AS choice FROM results")
def letter_answers(t):
    return t.results.select("result_no", pr.letter_answer(F.when(F.col("prediction").isNotNull(), " B ").otherwise("none"), F.when(F.col("attempts") == 1, "stop").otherwise("length"), F.array(F.lit("a"), F.lit("b"))).alias("choice"))


@query(
    """WITH e AS (SELECT vec_id, embedding e FROM embeddings) SELECT vec_id, (list_position(e, list_max(e)) - 1)::INT AS level, (e[1] > 0.5)::VARCHAR AS yes, round(exp(e[1] - list_max(e)) / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS p0 FROM e"""
)
def decoded_predictions(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = t.embeddings.withColumn("e", e)
    return rows.select("vec_id", pr.predict(F.lit("score"), F.lit(None), F.col("e")).cast("int").alias("level"), pr.predict(F.lit("noul"), F.lit(None), F.col("e")).alias("yes"), F.round(F.get(stats.softmax(F.col("e")), 0), 6).alias("p0"))


@query("SELECT doc_id, replace(replace(text, 'the', '[REDACTED]'), chr(10), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def redacted_documents(t):
    return t.documents.where("text is not null").select("doc_id", pr.redact(F.col("text"), "the").alias("text"))


@query("SELECT source_line, coalesce(nullif(trim(baseline_skill), ''), nullif(trim(question), ''), id) AS first FROM disagreements")
def first_nonblank(t):
    return t.disagreements.select("source_line", pr.first_nonblank(F.col("baseline_skill"), F.col("question"), F.col("id")).alias("first"))


@query("SELECT doc_id, CASE WHEN (length(text) - length(replace(text, 'agreement', ''))) = 9 THEN replace(text, 'agreement', 'assent') END AS edited FROM documents WHERE text IS NOT NULL")
def span_edits(t):
    return t.documents.where("text is not null").select("doc_id", pr.span_edit(F.col("text"), F.lit("agreement"), F.lit("assent")).alias("edited"))


@query("SELECT source_line, CASE WHEN json_type(payload, '$.model') = 'VARCHAR' THEN json_extract_string(payload, '$.model') END AS model FROM disagreements WHERE json_valid(payload)")
def path_texts(t):
    return t.disagreements.where(F.try_parse_json("payload").isNotNull()).select("source_line", pr.text_at(F.col("payload"), "$.model").alias("model"))


@query("SELECT api_url, count(*) FILTER (error IS NULL) AS accepted, count(*) FILTER (error IS NOT NULL) AS rejected FROM results GROUP BY api_url")
def success_split(t):
    good = va.success(F.lit(None).cast("int"), F.col("error"), F.lit(None).cast("string"))
    return t.results.groupBy("api_url").agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"))


@query(
    """WITH r AS (SELECT input.questions['decision'].type AS kind, input.questions['decision'].criteria AS c, reference.target AS t, reference.distribution AS d FROM decision_records),
    j AS (SELECT kind, CASE WHEN json_valid(c) THEN c END AS c, CASE WHEN json_valid(t) THEN t END AS t, d FROM r),
    o AS (SELECT kind, d, CASE WHEN kind = 'score' THEN CASE WHEN json_type(c) = 'ARRAY' AND json_array_length(c) > 0 THEN list_transform(range(0, json_array_length(c)::BIGINT), lambda i: i::VARCHAR) END WHEN json_type(c) = 'OBJECT' THEN json_keys(c) END AS options,
    CASE WHEN kind = 'noul' AND json_type(t) = 'BOOLEAN' OR kind = 'score' AND json_type(t) IN ('UBIGINT', 'BIGINT') OR kind = 'choice' AND json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') END AS key FROM j)
    SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT coalesce(kind IN ('choice', 'noul', 'score'), false) THEN 'type' END, CASE WHEN NOT coalesce(len(options) > 0, false) THEN 'criteria' END, CASE WHEN NOT coalesce(list_contains(options, key), false) THEN 'target' END,
    CASE WHEN d IS NOT NULL AND NOT coalesce(list_sort(map_keys(d)) = list_sort(options), false) THEN 'distribution keys' END, CASE WHEN d IS NOT NULL AND NOT coalesce(abs(list_sum(map_values(d)) - 1) <= 1e-6, false) THEN 'distribution sum' END], lambda x: x IS NOT NULL)) AS reason FROM o) GROUP BY reason"""
)
def record_quarantine_reasons(t):
    """Records that break any of the record rules."""
    q = F.col("input.questions")["decision"]
    _, rejected = va.quarantine(t.decision_records, va.record_rules(q["type"], q["criteria"], F.col("reference.target"), F.col("reference.distribution")))
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows FROM lineitem WHERE l_quantity BETWEEN 1 AND 50")
def demanded_rows(t):
    return va.demand(t.lineitem, {"quantity": F.col("l_quantity").between(1, 50)}).agg(F.count("*").alias("rows"))


@query("SELECT n_nationkey, n_name, n_regionkey, (n_nationkey + 1)::BIGINT AS line FROM nation")
def lines_round_trip(t):
    """Nations written as JSON lines in order of their key and read back with line numbers."""
    path = f"{shared_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    jsonl.write_jsonl(t.nation.repartition(1).sortWithinPartitions("n_nationkey"), path)
    rows, _ = jsonl.read_with_rejects(t.spark, path, t.nation.schema)
    return rows.select("n_nationkey", "n_name", "n_regionkey", "line")


@query("SELECT id, arg_max(struct_pack(p := prediction), result_no).p AS prediction FROM results GROUP BY id")
def latest_results(t):
    return jsonl.latest_by_id(t.results.select("id", "result_no", "prediction"), "id", "result_no").select("id", "prediction")
