"""Deeply nested JSON records as flat node tables, linked by interval labels.

A depth-first traversal numbers every node of a record: ``pre`` on entering,
``post`` on leaving, from one counter, so node A lies inside node B exactly if
``B.pre < A.pre`` and ``A.post < B.post``.  A record is one row of the input
and already lives in one task; the traversal runs in Arrow batches and keeps
its own stack, so depth is bounded only by the JSON text.

JSON text inside JSON (an object or array spelt as a string, also when quoted
twice) is opened in place.  Texts that do not parse stay scalar nodes.

``node_types`` names the node types to emit, each by a regular expression on
the node's path, in which fields are joined by ``.`` and array elements are
written ``[]`` (``state.history[].tool_calls[]``), and ``.`` and ``[`` in a
field's own name ``?``; a pair of expression and field asks for objects which
have that field.  Other nodes are numbered but not emitted: column pruning for
node types.  ``attrs`` holds the scalar fields of an object and, for the node
types in ``whole``, its other fields too, as JSON text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import dump_json, load_json
from tallyforge.operators.stages import spread

NODE_FIELDS = "record long, pre long, post long, parent_pre long, depth int, node_type string, path string, name string, pos long, kind string, value string, attrs map<string,string>"
_ROWS = 20_000
_PATH = 4_096


def _opened(value):
    """The container inside a text, else the value itself."""
    for _ in range(4):
        if not isinstance(value, str):
            return value
        head = value.lstrip()[:1]
        if head not in ("{", "[", '"'):
            return value
        try:
            inner = load_json(value)
        except ValueError:
            return value
        if isinstance(inner, (dict, list)):
            return inner
        if not isinstance(inner, str) or inner.lstrip()[:1] not in ("{", "[", '"'):
            return value
        value = inner
    return value


def _kind(value) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, bool):
        return "boolean"
    if value is None:
        return "null"
    return "string" if isinstance(value, str) else "number"


def _scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return dump_json(value)


def _encodable(value):
    """``value`` with ``?`` for what UTF-8 can't hold."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    return [tuple(map(_encodable, pair)) for pair in value] if isinstance(value, list) else value


def _attrs(value: dict, apart: Mapping[str, type] | None) -> list[tuple]:
    """Scalar fields, and with ``apart`` all fields but those it names with the type they have."""
    if apart is None:
        return [(k, _scalar(v)) for k, v in value.items() if not isinstance(v, (dict, list))]
    return [(k, _scalar(v)) for k, v in value.items() if k not in apart or not isinstance(v, apart[k])]


def _longer(path: str, sep: str, step: str) -> str:
    """The path of a child; paths of over _PATH characters end in ``…`` and stay as they are, so that memory doesn't grow with the square of the depth."""
    if len(path) > _PATH:
        return path if path.endswith("…") else path + "…"
    return path + sep + step


def walk_nodes(root, type_of, whole: Mapping[str, Mapping[str, type]] = {}) -> list[list]:
    """Node rows of one record, in pre-order; ``type_of(path)`` gives None or a node's type and the field it must have."""
    rows: list[list] = []
    counter = 0
    stack: list[tuple] = [(root, "$", None, None, None, 0, None)]
    while stack:
        value, path, name, pos, parent, depth, leaving = stack.pop()
        if leaving is not None:
            if leaving >= 0:
                rows[leaving][1] = counter
            counter += 1
            continue
        value = _opened(value)
        pre, counter = counter, counter + 1
        kind, typed, at = _kind(value), type_of(path), -1
        if typed is not None and (typed[1] is None or kind == "object" and typed[1] in value):
            node_type = typed[0]
            attrs = _attrs(value, whole.get(node_type)) if kind == "object" else []
            at = len(rows)
            rows.append([pre, None, parent, depth, node_type, path, name, pos, kind, None if kind in ("object", "array") else _scalar(value), attrs])
        if kind == "object":
            stack.append((None, None, None, None, None, 0, at))
            for key, child in reversed(value.items()):
                step = key if "." not in key and "[" not in key else key.replace(".", "?").replace("[", "?")
                stack.append((child, step if path == "$" else _longer(path, ".", step), key, None, pre, depth + 1, None))
        elif kind == "array":
            stack.append((None, None, None, None, None, 0, at))
            inner = _longer(path, "", "[]")
            for i in range(len(value) - 1, -1, -1):
                stack.append((value[i], inner, None, i, pre, depth + 1, None))
        else:
            if at >= 0:
                rows[at][1] = counter
            counter += 1
    return rows


def nodes(df: DataFrame, key: str, json_column: str, node_types: Mapping[str, str | tuple[str, str]], whole: Mapping[str, Mapping[str, type]] = {}) -> DataFrame:
    """The node table ``key + NODE_FIELDS`` of a JSON text column; ``record`` tells input rows of one key apart.

    Null, empty and unparsable texts give no nodes, but rows of ``rejects``; a text that is a JSON scalar gives its root if typed.  Repeated
    input rows repeat their nodes.  Only ``key`` and ``json_column`` are read, so other columns can't clash.  ``whole`` names, for each
    node type whose objects and arrays belong into attrs, the fields that don't, as they have nodes of their own, and their type.
    """
    source = spread(df.select(F.col(key).alias("key"), F.col(json_column).cast("string").alias("doc")).where(F.col("doc").isNotNull())).withColumn("record", F.monotonically_increasing_id())
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {NODE_FIELDS}"
    patterns = [(name, re.compile(rx if isinstance(rx, str) else rx[0]), None if isinstance(rx, str) else rx[1]) for name, rx in node_types.items()]
    arrow = pa.schema([("record", pa.int64()), ("pre", pa.int64()), ("post", pa.int64()), ("parent_pre", pa.int64()), ("depth", pa.int32()), ("node_type", pa.string()), ("path", pa.string()), ("name", pa.string()), ("pos", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]):
        known: dict[str, tuple | None] = {}

        def type_of(path):
            if path not in known:
                if len(known) > 100_000:
                    known.clear()
                known[path] = next(((name, field) for name, rx, field in patterns if rx.fullmatch(path)), None)
            return known[path]

        def flush(keys, rows, like):
            columns = list(zip(*rows))
            try:
                made = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            except UnicodeEncodeError:  # a lone surrogate spelt as an escape
                made = [pa.array([_encodable(x) for x in c], f.type) for c, f in zip(columns, arrow)]
            return pa.RecordBatch.from_arrays([pa.array(keys, like), *made], names=[key, *arrow.names])

        for batch in batches:
            like, keys, out = batch.schema.field(0).type, [], []
            for k, doc, record in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    root = load_json(doc)
                except ValueError:  # these are the rows of rejects()
                    continue
                own = walk_nodes(root, type_of, whole)
                out += [(record, *x) for x in own]
                keys += [k] * len(own)
                if len(out) >= _ROWS:
                    yield flush(keys, out, like)
                    keys, out = [], []
            if out:
                yield flush(keys, out, like)

    return source.mapInArrow(run, schema)


def rejects(df: DataFrame, key: str, json_column: str) -> DataFrame:
    """(key, reason) of the rows that ``nodes`` has nothing of: ``null``, ``empty`` or ``not JSON``, with one row for each input row.  Depth is no reason."""
    kind = df.schema[key].dataType.simpleString()
    source = spread(df.select(F.col(key).alias("key"), F.col(json_column).cast("string").alias("doc")))

    def reason(doc: str | None) -> str | None:
        if doc is None:
            return "null"
        if not doc.strip():
            return "empty"
        try:
            load_json(doc)
        except ValueError:
            return "not JSON"

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            reasons = [reason(doc) for doc in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string())], names=[key, "reason"])

    return source.mapInArrow(run, f"`{key}` {kind}, reason string").where("reason is not null")


def enclosing(key: str, node_type: str, column: str = "pre") -> Column:
    """``column`` of the innermost node of ``node_type`` around the current one, for types that do not nest in themselves.

    A merge along pre-order: the last such node to open is the only candidate, and it encloses the current node if
    it closes later.  One sort per record serves all ancestor types; no node is compared with any other.
    """
    order = Window.partitionBy(key, "record").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("node_type") == node_type, F.struct(F.col("post").alias("post"), F.col(column).alias("it"))), ignorenulls=True).over(order)
    return F.when(last["post"] > F.col("post"), last["it"])


_CALL = r"state\.(?:history|messages)\[\]\.(?:tool_calls\[\]|function_call)"
_ARGUMENTS = r"state\.(?:history|messages)\[\]\.(?:tool_calls\[\](?:\.function)?|function_call)\.arguments"
CALL_TYPES = {"message": r"state\.(?:history|messages)\[\]", "call": _CALL, "condition": (_ARGUMENTS + r"\.filters(?:[.\[].*)?", "field")}
ARGUMENT_TYPES = CALL_TYPES | {"function": _CALL + r"\.function", "arguments": _ARGUMENTS}
CALL_WHOLE: dict[str, dict[str, type]] = {"message": {"tool_calls": list, "function_call": dict}, "call": {"function": dict, "arguments": dict}, "function": {"arguments": dict}, "arguments": {}, "condition": {}}
CALL_KEY = ("msg_pos", "call_kind", "call_pos")


def call_nodes(df: DataFrame, key: str = "source_line", payload: str = "payload", node_types: Mapping[str, str | tuple[str, str]] = CALL_TYPES) -> DataFrame:
    """Messages, calls and conditions of the payloads, with ``ARGUMENT_TYPES`` functions and arguments too, each row with the position of its message and call.

    Columns: key, node_type, pre, post, list (history or messages), path, kind, value (of nodes that are no object or array),
    msg_pos, call_kind (tool_calls or function_call; a message may have both), call_pre (a call's own, else the enclosing call's),
    call_pos, cond_pos (reading order within the call from 0; null unless a condition), n_conditions of the call, role, ref (id of
    a call, tool_call_id of a message), reply_pos (of calls and what is in them: first later message of role ``tool`` that refers
    to the call, -1 without one), attrs.  One exchange on the key serves every link.

    A message list that is no array, filters that can't be read: no row for them; a null ``function_call`` is no call.  Where a
    record has both ``history`` and ``messages``, ``history`` counts.
    """
    record = Window.partitionBy(key, "record")
    typed = (
        nodes(df, key, payload, node_types, CALL_WHOLE)
        .where(~((F.col("node_type") == "call") & (F.col("kind") == "null") & F.col("pos").isNull()))
        .withColumn("in_history", F.col("path").startswith("state.history"))
        .withColumn("has_history", F.max("in_history").over(record))
        .where(F.col("in_history") | ~F.col("has_history"))
    )
    is_call, is_message = F.col("node_type") == "call", F.col("node_type") == "message"
    linked = typed.select(
        key, "record", "node_type", "pre", "post", "path", "kind", "value", "attrs",
        F.when(F.col("in_history"), "history").otherwise("messages").alias("list"),
        F.when(is_message, F.col("pos")).otherwise(enclosing(key, "message", "pos")).alias("msg_pos"),
        F.when(~is_message, F.regexp_extract("path", r"^state\.[a-z]+\[\]\.(tool_calls|function_call)", 1)).alias("call_kind"),
        F.when(is_call, F.col("pre")).otherwise(enclosing(key, "call", "pre")).alias("call_pre"),
        F.when(is_call, F.coalesce("pos", F.lit(0))).otherwise(F.coalesce(enclosing(key, "call", "pos"), F.lit(0))).cast("long").alias("call_pos"),
        F.when(is_message, F.col("attrs")["role"]).alias("role"),
        F.when(is_call, F.col("attrs")["id"]).when(is_message, F.col("attrs")["tool_call_id"]).alias("ref"),
    )
    later = Window.partitionBy(key, "record", "ref").orderBy(F.col("msg_pos").desc()).rangeBetween(Window.unboundedPreceding, -1)
    call = Window.partitionBy(key, "record", "call_pre")
    reading = call.orderBy("pre")
    is_condition = F.col("node_type") == "condition"
    return (
        linked.withColumn("reply", F.when(is_call & F.col("ref").isNotNull(), F.min(F.when(F.col("role") == "tool", F.col("msg_pos"))).over(later)))
        .withColumn("reply_pos", F.when(F.col("call_pre").isNotNull(), F.coalesce(F.first("reply").over(reading), F.lit(-1))))
        .withColumn("cond_pos", F.when(is_condition, F.count(F.when(is_condition, 1)).over(reading) - 1))
        .withColumn("n_conditions", F.when(F.col("call_pre").isNotNull(), F.count(F.when(is_condition, 1)).over(call)))
        .drop("reply")
    )


def call_conditions(df: DataFrame, key: str = "source_line", payload: str = "payload") -> DataFrame:
    """One row for each condition of each call, and one with cond_pos -1 for a call without readable conditions.

    ``values`` is the field's text, of an array its JSON text; ``path`` tells the condition's place in the filters; attrs holds all fields.
    """
    rows = call_nodes(df, key, payload).where((F.col("node_type") == "condition") & F.col("call_pre").isNotNull() | (F.col("node_type") == "call") & (F.col("n_conditions") == 0))
    of = lambda c: F.when(F.col("node_type") == "condition", c)
    attrs = F.col("attrs")
    return rows.select(
        key, "msg_pos", "call_pos", F.coalesce("cond_pos", F.lit(-1)).cast("long").alias("cond_pos"), "reply_pos", of(attrs["field"]).alias("field"), of(attrs["operator"]).alias("operator"),
        "call_kind", of(attrs["values"]).alias("values"), of(F.regexp_extract("path", r"arguments\.(filters.*)", 1)).alias("path"), of(attrs).alias("attrs"),
    )


def entries(text: Column) -> Column:
    """The elements of a JSON array's text, as texts; another text is its only element, null has none."""
    return F.when(text.isNotNull(), F.coalesce(F.from_json(text, "array<string>"), F.array(text)))


def condition_values(df: DataFrame, key: str = "source_line", payload: str = "payload") -> DataFrame:
    """One row for each of a condition's ``values``: key, position of message, call and condition, value_pos, value."""
    return call_conditions(df, key, payload).select(key, *CALL_KEY, "cond_pos", F.posexplode(entries(F.col("values"))).alias("value_pos", "value"))


def messages(df: DataFrame, key: str = "source_line", payload: str = "payload") -> DataFrame:
    """Entries of the message list.  ``content`` is the field's text, of an object or array its JSON text; ``value`` is that of an entry that is
    no object; attrs holds all fields but the calls."""
    rows = call_nodes(df, key, payload).where("node_type = 'message'")
    return rows.select(key, "msg_pos", "role", F.col("ref").alias("tool_call_id"), "list", "kind", F.col("attrs")["content"].alias("content"), "value", "attrs")


def calls(df: DataFrame, key: str = "source_line", payload: str = "payload") -> DataFrame:
    """Calls with id, name, number of conditions and reply; attrs and function_attrs hold all fields of the call and its ``function`` but the arguments that are objects."""
    call = Window.partitionBy(key, "record", "call_pre").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = call_nodes(df, key, payload, ARGUMENT_TYPES).withColumn("function_attrs", F.first(F.when(F.col("node_type") == "function", F.col("attrs")), ignorenulls=True).over(call))
    return rows.where("node_type = 'call'").select(key, *CALL_KEY, "kind", F.col("ref").alias("call_id"), F.coalesce(F.col("function_attrs")["name"], F.col("attrs")["name"]).alias("name"), "n_conditions", "reply_pos", "value", "attrs", "function_attrs")


def call_arguments(df: DataFrame, key: str = "source_line", payload: str = "payload") -> DataFrame:
    """Arguments of the calls that have any.  ``value`` is the text of arguments that are no object, such as one cut off; attrs holds all fields, objects and arrays as JSON text."""
    attrs = F.col("attrs")
    return call_nodes(df, key, payload, ARGUMENT_TYPES).where("node_type = 'arguments'").select(key, *CALL_KEY, "kind", attrs["fields"].alias("fields"), attrs["filters"].alias("filters"), attrs["topn"].alias("topn"), "value", "attrs")


def argument_fields(df: DataFrame, key: str = "source_line", payload: str = "payload") -> DataFrame:
    """One row for each of the arguments' ``fields``: key, position of message and call, field_pos, field."""
    return call_arguments(df, key, payload).select(key, *CALL_KEY, F.posexplode(entries(F.col("fields"))).alias("field_pos", "field"))


STATE_TYPES = {"state": r"state"}
STATE_WHOLE: dict[str, dict[str, type]] = {"state": {"current_plan": list, "history": list, "messages": list}}
PLAN_TYPES = {"step": r"state\.current_plan(?:\[\])?"}
RESULT_TYPES = {"result": r"\$", "raw_response": r"raw_response", "answer": r"raw_response\.answers\.[^.\[]*", "probabilities": r"raw_response\.answers\.[^.\[]*\.probabilities", "usage": r"raw_response\.usage"}
RESULT_WHOLE: dict[str, dict[str, type]] = {"result": {"raw_response": dict}, "raw_response": {"answers": dict, "usage": dict}, "answer": {"probabilities": dict}, "probabilities": {}, "usage": {}}


def states(df: DataFrame, key: str = "source_line", payload: str = "payload") -> DataFrame:
    """``state`` of the payloads.  ``value`` is the text of a state that is no object; attrs holds all fields but the arrays of plan steps and messages."""
    return nodes(df, key, payload, STATE_TYPES, STATE_WHOLE).select(key, "kind", F.col("attrs")["question"].alias("question"), "value", "attrs")


def plan_steps(df: DataFrame, key: str = "source_line", payload: str = "payload") -> DataFrame:
    """Steps of ``state.current_plan``: key, step_pos, kind, step text, skill, and of a step that is an object its field ``step`` as step_no and all fields as attrs.

    A plan that is one text is one step at 0; a null or empty plan has none.
    """
    typed = nodes(df, key, payload, PLAN_TYPES, {"step": {}}).where(F.col("pos").isNotNull() | ~F.col("kind").isin("array", "null"))
    return typed.select(key, F.coalesce("pos", F.lit(0)).cast("long").alias("step_pos"), "kind", F.col("value").alias("step"), F.col("attrs")["skill"].alias("skill"), F.col("attrs")["step"].alias("step_no"), "attrs")


def result_tables(df: DataFrame, key: str = "source_line", result: str = "result") -> DataFrame:
    """Result, answer, probability and usage nodes of a result text; select one ``node_type`` for a flat table.

    ``answer`` is the name of the enclosing answer for probabilities, and answer_pos its position; attrs holds the fields of each node but those with nodes of their own.
    """
    is_answer = F.col("node_type") == "answer"
    reading = Window.partitionBy(key, "record").orderBy("pre")
    typed = nodes(df, key, result, RESULT_TYPES, RESULT_WHOLE).withColumn("answer_pos", F.when(is_answer | (F.col("node_type") == "probabilities"), F.count(F.when(is_answer, 1)).over(reading) - 1))
    return typed.select(key, "record", "node_type", "pre", "post", "parent_pre", F.coalesce(enclosing(key, "answer", "name"), F.when(is_answer, F.col("name"))).alias("answer"), "answer_pos", "kind", "value", "attrs")


def answer_rows(results: DataFrame, key: str = "result_no") -> DataFrame:
    """``raw_response`` of typed result rows as one row for each answer, with its position; the shape is fixed, so the interval labels are too
    and the explode stays in the JVM.  Rows without a response give none."""
    answers = results.select(key, F.col("raw_response.model").alias("model"), F.posexplode("raw_response.answers").alias("answer_pos", "question", "answer"))
    return answers.select(key, "answer_pos", "model", "question", F.col("answer.type").alias("type"), F.col("answer.choice").alias("choice"), F.col("answer.confidence").alias("confidence"), F.col("answer.probabilities").alias("probabilities"))


def response_answers(results: DataFrame, key: str = "result_no") -> DataFrame:
    """One row for each answer and option, with their positions; an answer without probabilities gives one row."""
    return answer_rows(results, key).select(key, "answer_pos", "model", "question", "type", "choice", "confidence", F.posexplode_outer("probabilities").alias("option_pos", "option", "probability"))


def response_usage(results: DataFrame, key: str = "result_no") -> DataFrame:
    """``raw_response.usage``: one row for each response that reports usage; missing fields stay null."""
    return results.where(F.col("raw_response.usage").isNotNull()).select(key, F.col("raw_response.model").alias("model"), F.col("raw_response.usage.input_tokens").alias("input_tokens"), F.col("raw_response.usage.output_tokens").alias("output_tokens"))
