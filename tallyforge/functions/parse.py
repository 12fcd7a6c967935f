"""Parsing and rewriting of logged requests, responses and records, as column expressions.

Logged JSON is handled as text with ``get_json_object`` and ``from_json`` or as VARIANT; null and missing both read as null.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.text import dump_json, load_json

NO_SKILL = "__no_skill__"
FAILED = "__error_or_missing__"

CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_call_id:string,tool_calls:array<{CALL}>>"
DELTA = "struct<role:string,content:string,reasoning:string,reasoning_content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>,function_call:struct<name:string,arguments:string>>"
EVENT = f"struct<choices:array<struct<index:int,delta:{DELTA},message:{DELTA},finish_reason:string>>,usage:struct<prompt_tokens:double,completion_tokens:double,input_tokens:double,output_tokens:double>,model:string>"


def strip(text: Column) -> Column:
    """A text without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# -- events and responses --------------------------------------------------


def sse_texts(body: Column) -> Column:
    """Payload texts of a recorded event stream, up to ``[DONE]``; a body that is one JSON object is its own only payload.

    Line ends are unified, blocks end at blank lines, the ``data`` lines of a block lose one leading space and join with line feeds; comments and
    other fields are passed over.
    """
    unified = F.regexp_replace(body, r"\r\n?", "\n")
    blocks = F.split(unified, r"\n\n+")
    data = F.transform(
        blocks,
        lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda line: (line == "data") | line.startswith("data:")), lambda line: F.regexp_replace(F.substring(line, 6, 1 << 30), "^ ", "")), "\n"),
    )
    present = F.filter(data, lambda d: d != "")
    done = F.array_position(present, "[DONE]")
    events = F.when(done > 0, F.slice(present, F.lit(1), (done - 1).cast("int"))).otherwise(present)
    return F.when(F.ltrim(body).startswith("{"), F.array(body)).otherwise(events)


def sse_complete(body: Column) -> Column:
    """Whether a body is one JSON object or a stream closed by ``[DONE]``."""
    return F.ltrim(body).startswith("{") | body.rlike(r"(?m)^data: ?\[DONE\]\s*$")


def events(body: Column) -> Column:
    """Parsed events of a body in order."""
    return F.transform(sse_texts(body), lambda t: F.from_json(t, EVENT))


def delta_text(delta: Column) -> Column:
    """All text a delta carries: content, reasoning, names and arguments of calls."""
    calls = F.transform(F.coalesce(delta["tool_calls"], F.from_json(F.lit("[]"), "array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>")), lambda c: F.concat_ws("", c["function"]["name"], c["function"]["arguments"]))
    return F.concat_ws("", delta["content"], delta["reasoning"], delta["reasoning_content"], delta["function_call"]["name"], delta["function_call"]["arguments"], F.array_join(calls, ""))


def valid_number(x: Column) -> Column:
    """Finite and not negative."""
    return x.isNotNull() & ~F.isnan(x) & (x < float("inf")) & (x >= 0)


def only_valid(x: Column) -> Column:
    return F.when(valid_number(x.cast("double")), x)


def fold_events(parsed: Column) -> Column:
    """struct(content, arguments, prompt_tokens, completion_tokens, model, finish_reason) of a response's events.

    Deltas of the first choice are concatenated, a whole message replaces what came before, arguments of all calls are concatenated, and for
    each usage field the last valid number counts.
    """
    first = F.struct(F.lit("").alias("content"), F.lit("").alias("arguments"), F.lit(None).cast("double").alias("prompt_tokens"), F.lit(None).cast("double").alias("completion_tokens"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("finish_reason"))

    def step(acc: Column, e: Column) -> Column:
        choice = F.get(e["choices"], 0)
        calls = F.coalesce(F.array_join(F.transform(choice["delta"]["tool_calls"], lambda c: F.coalesce(c["function"]["arguments"], F.lit(""))), ""), F.array_join(F.transform(choice["message"]["tool_calls"], lambda c: F.coalesce(c["function"]["arguments"], F.lit(""))), ""), F.lit(""))
        usage = e["usage"]
        return F.struct(
            F.coalesce(choice["message"]["content"], F.concat(acc["content"], F.coalesce(choice["delta"]["content"], F.lit("")))).alias("content"),
            F.concat(acc["arguments"], calls).alias("arguments"),
            F.coalesce(only_valid(F.coalesce(usage["prompt_tokens"], usage["input_tokens"])), acc["prompt_tokens"]).alias("prompt_tokens"),
            F.coalesce(only_valid(F.coalesce(usage["completion_tokens"], usage["output_tokens"])), acc["completion_tokens"]).alias("completion_tokens"),
            F.coalesce(e["model"], acc["model"]).alias("model"),
            F.coalesce(choice["finish_reason"], acc["finish_reason"]).alias("finish_reason"),
        )

    return F.aggregate(parsed, first, step)


def tool_names(body: Column) -> Column:
    """Every ``"name":"..."`` of a raw response, in order."""
    return F.regexp_extract_all(body, F.lit('"name":"([^"]+)"'), 1)


def usage_tokens(usage: Column, which: str = "prompt") -> Column:
    """prompt_tokens or, without it, input_tokens (completion: output_tokens) of a usage text; null unless finite."""
    old, new = {"prompt": ("prompt_tokens", "input_tokens"), "completion": ("completion_tokens", "output_tokens")}[which]
    return only_valid(F.coalesce(F.get_json_object(usage, f"$.{old}").try_cast("double"), F.get_json_object(usage, f"$.{new}").try_cast("double")))


def timing_header(header: Column) -> Column:
    """``name;dur=value`` pairs of a server-timing header as map<string,double>."""
    return F.transform_values(F.str_to_map(header, F.lit(", ?"), F.lit(";dur=")), lambda _, v: v.try_cast("double"))


# -- requests and tasks ----------------------------------------------------


def task_text(messages: Column, marker: str = "task") -> Column:
    """Text within the marker of the last user message that has it, over several lines; null without one."""
    pattern = f"(?s)<{marker}>(.*?)</{marker}>"
    holding = F.filter(messages, lambda m: (m["role"] == "user") & m["content"].rlike(pattern))
    raw = F.regexp_extract(F.try_element_at(holding, F.lit(-1))["content"], pattern, 1)
    # a task may be one JSON string
    decoded = F.from_json(F.concat(F.lit('{"v":'), strip(raw), F.lit("}")), "v string")["v"]
    return F.when(F.size(holding) > 0, F.when(strip(raw).rlike('(?s)^".*"$'), F.coalesce(decoded, raw)).otherwise(raw))


def after_task(messages: Column, marker: str = "task") -> Column:
    """What follows the closing marker in the message that ``task_text`` reads."""
    holding = F.filter(messages, lambda m: (m["role"] == "user") & m["content"].rlike(f"(?s)<{marker}>(.*?)</{marker}>"))
    content = F.try_element_at(holding, F.lit(-1))["content"]
    return strip(F.regexp_replace(content, f"(?s)^.*?<{marker}>.*?</{marker}>", ""))


def baseline_label(names: Column, content: Column, status: Column, many: str = "null") -> Column:
    """The one tool a response calls; NO_SKILL if it only has content; null if it failed or is empty.

    Several different tools give null, or an error with ``many="raise"``.
    """
    distinct = F.array_distinct(F.filter(names, lambda n: n.isNotNull()))
    several = F.raise_error(F.lit("more than one tool in a response")).cast("string") if many == "raise" else F.lit(None).cast("string")
    return F.when(F.coalesce(status, F.lit(0)) != 200, None).when(F.size(distinct) > 1, several).when(F.size(distinct) == 1, F.get(distinct, 0)).when(strip(content) != "", NO_SKILL)


def phase(messages: Column) -> Column:
    """``followup`` if an assistant, tool or function has spoken, else ``initial``."""
    return F.when(F.exists(messages, lambda m: m["role"].isin("assistant", "tool", "function")), "followup").otherwise("initial")


def route_payload(names: Column, descriptions: Column, question: Column, plan: Column, model: str, mode: str = "compact") -> Column:
    """The routing request of a question: a choice among the tools and NO_SKILL, with the plan unless the mode is ``question``."""
    options = F.map_concat(F.map_from_arrays(names, F.transform(descriptions, lambda d: F.coalesce(d, F.lit("")))), F.create_map(F.lit(NO_SKILL), F.lit("no tool is needed")))
    fields = [question.alias("question")] + ([] if mode == "question" else [plan.alias("current_plan")])
    choice = F.struct(F.lit("choice").alias("type"), F.lit("Choose the skill for the coming step.").alias("instructions"), options.alias("criteria"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.struct(*fields).alias("state"), F.struct(choice.alias("skill")).alias("questions")))


def arguments_or_empty(text: Column) -> Column:
    """A JSON object as text; ``{}`` for anything that does not parse as one."""
    return F.when(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), text).otherwise("{}")


def first_nonblank(*candidates: Column) -> Column:
    """The first candidate that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.when(strip(c) != "", strip(c)) for c in candidates))


def redact(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("[REDACTED]")) if secret else text


# -- answers ---------------------------------------------------------------


def answer_json(text: Column) -> Column:
    """The JSON object of an answer: without code fences, whole or the widest brace pair in it."""
    bare = strip(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    parses = lambda t: F.try_parse_json(t).isNotNull() & t.startswith("{")
    return F.when(parses(bare), bare).when(parses(inner), inner)


def label_answer(text: Column, labels: Column) -> Column:
    """struct(label, confidence, error): the label must be one of ``labels``, the confidence within 0..100 and finite, given back within 0..1."""
    found = answer_json(text)
    label, confidence = F.get_json_object(found, "$.label"), F.get_json_object(found, "$.confidence").try_cast("double")
    error = F.when(found.isNull(), "no JSON object").when(label.isNull() | ~F.array_contains(labels, label), "unknown label").when(~F.coalesce(valid_number(confidence) & (confidence <= 100), F.lit(False)), "bad confidence")
    return F.struct(F.when(error.isNull(), label).alias("label"), F.when(error.isNull(), confidence / 100).alias("confidence"), error.alias("error"))


def letter_answer(content: Column, finish_reason: Column, choices: Column) -> Column:
    """The choice behind a single letter A-Z; null unless the response stopped by itself and the letter is in use."""
    letter = strip(content)
    place = F.ascii(letter) - 64
    return F.when((finish_reason == "stop") & letter.rlike("^[A-Z]$") & (place <= F.size(choices)), F.get(choices, place - 1))


def target_key(target: Column, kind: Column) -> Column:
    """A JSON target as comparable text: false/true for noul, the level for score, the option for choice; null if the type does not fit.

    ``true`` and ``"true"`` differ, as do 1, 1.0 and "1".
    """
    form = F.schema_of_variant(F.try_parse_json(target))
    plain = F.try_variant_get(F.try_parse_json(target), "$", "string")
    return F.when((kind == "noul") & (form == "BOOLEAN"), plain).when((kind == "score") & (form == "BIGINT"), plain).when((kind == "choice") & (form == "STRING"), plain)


def criteria_options(criteria: Column, kind: Column) -> Column:
    """Options in their order: keys of an object, levels of an array as texts."""
    n = F.json_array_length(criteria)
    levels = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda i: i.cast("string")))
    return F.when(kind == "score", levels).otherwise(F.json_object_keys(criteria))


def decode_target(value: Column, kind: Column, options: Column) -> Column:
    """A typed target key from a text; a choice may be given by the letter before its dash if only one option fits."""
    exact = F.array_contains(options, value)
    lettered = F.filter(options, lambda o: o.startswith(F.concat(value, F.lit(" — "))))
    choice = F.when(exact, value).when(F.size(lettered) == 1, F.get(lettered, 0))
    level = F.when(value.rlike(r"^\d+$") & F.array_contains(options, value), value)
    return F.when(kind == "noul", F.when(F.lower(value).isin("true", "false"), F.lower(value))).when(kind == "score", level).otherwise(choice)


def predict(kind: Column, choice: Column, p: Column) -> Column:
    """The prediction of an answer: the choice; true only above 0.5; the most probable level, the lowest of equal ones."""
    best = F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    return F.when(kind == "choice", choice).when(kind == "noul", (F.get(p, 0) > 0.5).cast("string")).when(kind == "score", (-best["i"]).cast("string"))


def _share_of(votes: Column, option: str) -> Column:
    return F.size(F.filter(votes, lambda v: v == option))


def vote_share(votes: Column, options: Iterable[str]) -> Column:
    """Share of votes for each option; null without votes."""
    n = F.size(votes).cast("double")
    return F.when(n > 0, F.map_from_arrays(F.array(*map(F.lit, options)), F.array(*(_share_of(votes, o) / n for o in options))))


def modal(shares: Column, gold: Column) -> Column:
    """Whether the gold option has the largest share."""
    return F.element_at(shares, gold) == F.array_max(F.map_values(shares))


def binarise(x: Column, threshold: float = 0.5) -> Column:
    """struct(target, distribution) of a score cut at a threshold."""
    return F.struct((x >= threshold).alias("target"), F.create_map(F.lit("false"), 1 - x, F.lit("true"), x).alias("distribution"))


def short_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def csv_cell(text: Column) -> Column:
    """Trimmed, non-blank parts of a comma-separated cell."""
    return F.filter(F.transform(F.split(text, ","), lambda x: strip(x)), lambda x: x != "")


def letter_codes(choices: Column) -> Column:
    """(letter, choice) of up to 26 choices, angle brackets escaped; null for more."""
    escape = lambda c: F.replace(F.replace(c, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))
    return F.when(F.size(choices) <= 26, F.transform(choices, lambda c, i: F.struct(F.char(i + 65).alias("letter"), escape(c).alias("choice"))))


def permuted(choices: Column, row_id: Column, seed: int) -> Column:
    """The choices in an order fixed by seed and row."""
    keyed = F.transform(choices, lambda c: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), row_id, c), 256).alias("k"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def gold_at(choices: Column, gold: Column, place: Column, row_id: Column, seed: int) -> Column:
    """The choices in an order fixed by seed and row, with ``gold`` at the 0-based ``place``, or at the end if there are fewer; null if gold is no choice."""
    others = F.filter(permuted(choices, row_id, seed), lambda c: c != gold)
    at = F.least(place, F.size(others))
    return F.when(F.array_contains(choices, gold), F.concat(F.slice(others, F.lit(1), at), F.array(gold), F.slice(others, at + 1, F.size(others))))


def legend_matches(legend: Column, levels: Column) -> Column:
    """Whether a map of level to text spells exactly the levels in order."""
    expected = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(levels) - 1), lambda i: i.cast("string")), levels)
    return F.array_sort(F.map_entries(legend)) == F.array_sort(F.map_entries(expected))


def renamed(column: Column, names: dict[str, str]) -> Column:
    """Old names by their new ones, others as they are."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[column], column) if names else column


def span_edit(text: Column, old: Column, new: Column) -> Column:
    """``text`` with its one occurrence of ``old`` replaced; null unless there is exactly one."""
    count = F.when(F.length(old) > 0, (F.length(text) - F.length(F.replace(text, old))) / F.length(old))
    return F.when(count == 1, F.replace(text, old, new))


def text_at(json_text: Column, path: str) -> Column:
    """The text at a fixed path; null if it is missing or no text."""
    return F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_text), path, "variant")) == "STRING", F.try_variant_get(F.try_parse_json(json_text), path, "string"))


def token_set(text: Column) -> Column:
    """Distinct lower-case words, Unicode letters, numbers and underscore.  Letters are lowered one by one: a final sigma as any other, a dotted I as an i."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.translate(text, "\u03a3\u0130", "\u03c3i")), F.lit(r"[\p{L}\p{N}_]+"), 0))


def canonical_state(text: Column) -> Column:
    """Words of a state joined by single blanks, the key of exact duplicates."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), 0), " ")


def _json_string(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _once_each(quotes: Column, text: Column) -> Column:
    """Exactly two non-empty quotes, each once in the text."""
    once = lambda q: (F.length(q) > 0) & (F.length(text) - F.length(F.replace(text, q)) == F.length(q))
    return (F.size(quotes) == 2) & F.forall(quotes, once)


def wrap_paragraph(state: Column, original: Column, quotes: Column) -> Column:
    """A state that is one JSON string put into an object under ``context``, where the original state was an object and both quotes are found; else as it is."""
    paragraph = F.when(strip(state).startswith('"') & F.try_parse_json(state).isNotNull(), F.try_variant_get(F.try_parse_json(state), "$", "string"))
    fits = strip(original).startswith("{") & F.try_parse_json(original).isNotNull() & (strip(paragraph) != "") & _once_each(quotes, paragraph)
    return F.when(fits, F.to_json(F.struct(paragraph.alias("context")))).otherwise(state)


def encode_literal(state: Column, original_is_text: Column, quotes: Column) -> Column:
    """A bare paragraph as a JSON string, where the original state was a text; JSON, and what looks like broken JSON or a fence, stays as it is."""
    bare = F.try_parse_json(state).isNull() & (strip(state) != "") & ~F.ltrim(state).rlike(r'^\s*([{\["]|```)')
    return F.when(original_is_text & bare & _once_each(quotes, state), _json_string(state)).otherwise(state)


def adapt_input(state: Column, kind: Column, instructions: Column, criteria: Column) -> Column:
    """struct(context, type, choices, description) of a question for a scorer: only what a model may see; unknown kinds stop."""
    options = criteria_options(criteria, kind)
    choices = F.when(kind == "noul", F.array(F.lit("false"), F.lit("true"))).when(kind.isin("choice", "score"), options).otherwise(F.raise_error(F.concat(F.lit("unsupported question type: "), F.coalesce(kind, F.lit("null")))).cast("array<string>"))
    return F.struct(state.alias("context"), F.when(kind == "noul", "boolean").otherwise("enum").alias("type"), choices.alias("choices"), instructions.alias("description"))


# -- what needs Python, in Arrow batches -----------------------------------


@F.pandas_udf(T.StringType())
def match_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility-normalised letters and digits in lower case, without blanks, marks and punctuation."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).lower() if unicodedata.category(c)[0] in "LN"))


def _sorted_json(text: str | None) -> str | None:
    def refuse(name: str):
        raise ValueError(name)

    if text is None:
        return None
    try:
        return json.dumps(json.loads(text, parse_constant=refuse), sort_keys=True, ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON with sorted names and the usual separators, 1 and 1.0 kept apart; null if it does not parse or holds NaN or infinity."""
    for texts in batches:
        yield texts.map(_sorted_json)


def fingerprint(text: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(text), 256)


def _flat(value) -> Iterator[str]:
    stack = [value]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        elif isinstance(item, dict):
            stack.extend(reversed(item.values()))
        elif isinstance(item, list):
            stack.extend(reversed(item))


def _loaded(text: str | None):
    try:
        return load_json(text) if text is not None else None
    except ValueError:
        return text


@F.pandas_udf(T.StringType())
def flat_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All texts of a nested value, joined by line feeds; a text that is no JSON is itself."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else "\n".join(_flat(_loaded(t))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Distinct field names at any depth, sorted."""

    def keys(text):
        found, stack = set(), [_loaded(text)]
        while stack:
            item = stack.pop()
            if isinstance(item, dict):
                found.update(item)
                stack.extend(item.values())
            elif isinstance(item, list):
                stack.extend(item)
        return sorted(found)

    for texts in batches:
        yield texts.map(keys)


@F.pandas_udf(T.StringType())
def text_on_path(json_texts: pd.Series, paths: pd.Series) -> pd.Series:
    """The text at a path given as an array of steps for each row; null if it is missing or no text."""

    def walk(text, path):
        value = _loaded(text)
        for step in path if path is not None else ():
            if isinstance(value, dict):
                value = value.get(step)
            elif isinstance(value, list) and str(step).isdigit() and int(step) < len(value):
                value = value[int(step)]
            else:
                return None
        return value if isinstance(value, str) else None

    return pd.Series([walk(t, p) for t, p in zip(json_texts, paths)], dtype=object)


@F.pandas_udf(T.StringType())
def edit_at(states: pd.Series, paths: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """A state with the one occurrence of ``old`` in the text at a path replaced by ``new``; all else keeps its place and kind.

    An empty or null path is the state itself, as plain text.  Null where the path leads to no text, ``old`` is blank, equal to ``new`` or not there
    exactly once.
    """

    def edit(state, path, a, b):
        if state is None or a is None or b is None or not a.strip() or a == b:
            return None
        steps = list(path) if path is not None else []
        if not steps:
            return state.replace(a, b) if state.count(a) == 1 else None
        root = node = _loaded(state)
        around, place = None, None
        for step in steps:
            around = node
            if isinstance(node, dict) and step in node:
                place = step
            elif isinstance(node, list) and step.isdigit() and int(step) < len(node):
                place = int(step)
            else:
                return None
            node = node[place]
        if not isinstance(node, str) or node.count(a) != 1:
            return None
        around[place] = node.replace(a, b)
        return dump_json(root)

    return pd.Series([edit(*x) for x in zip(states, paths, old, new)], dtype=object)


@F.pandas_udf(T.IntegerType())
def changed_words(left: pd.Series, right: pd.Series) -> pd.Series:
    """Most words removed or added between two texts, over whitespace tokens."""
    from difflib import SequenceMatcher

    def size(a, b):
        if a is None or b is None:
            return None
        a, b = a.split(), b.split()
        removed = added = 0
        for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if kind != "equal":
                removed, added = removed + j - i, added + m - k
        return max(removed, added)

    return pd.Series([size(a, b) for a, b in zip(left, right)], dtype="Int32")


@F.pandas_udf(T.BooleanType())
def python_parses(code: pd.Series) -> pd.Series:
    """Whether a code text parses as Python."""
    import ast

    def ok(text):
        if text is None:
            return None
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError):
            return False

    return code.map(ok)


@F.pandas_udf(T.BooleanType())
def repeated_names(json_texts: pd.Series) -> pd.Series:
    """Whether any object of a JSON text has one name twice; null if it does not parse."""

    def check(text):
        seen = []

        def pairs(items):
            seen.append(len(items) != len({k for k, _ in items}))
            return None

        try:
            json.loads(text, object_pairs_hook=pairs)
        except (ValueError, TypeError, RecursionError):
            return None
        return any(seen)

    return json_texts.map(check)


@F.pandas_udf(T.StringType())
def with_distractor(states: pd.Series, extra: pd.Series) -> pd.Series:
    """A state with one more passage: a paragraph of a text, a last turn or item of a list, a ``note`` of an object."""

    def add(state, text):
        if state is None or text is None:
            return state
        value = _loaded(state)
        if isinstance(value, list):
            item = text
            if value and isinstance(value[-1], dict):
                field = next((k for k in ("text", "content") if k in value[-1]), None)
                item = {**value[-1], field: text} if field else {"note": text}
            return json.dumps([*value, item], ensure_ascii=False)
        if isinstance(value, dict):
            name = "note"
            while name in value:
                name += "_"
            return json.dumps({**value, name: text}, ensure_ascii=False)
        return f"{state}\n\n{text}"

    return pd.Series([add(s, t) for s, t in zip(states, extra)], dtype=object)

