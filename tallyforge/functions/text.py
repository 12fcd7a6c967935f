"""Text and JSON helpers for Arrow-batched workers.

"Words" are runs of letters or digits, lower-cased; "bare text" is a text
with everything but letters and digits removed, lower-cased.  Python's
``str.isalnum`` class equals the Unicode classes L and N, which the SQL side
writes as ``[\\p{L}\\p{N}]``.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_NAMED = {"null": None, "true": True, "false": False}
_CONSTANTS = ("NaN", "Infinity", "-Infinity")


def load_json(text: str, parse_int=int, parse_float=float, parse_constant=float):
    """A JSON text of any depth; ValueError for anything else."""
    try:
        return json.loads(text, parse_int=parse_int, parse_float=parse_float, parse_constant=parse_constant)
    except RecursionError:
        return _load_deep(text, parse_int, parse_float, parse_constant)


def _scalar_at(text: str, at: int, parse_int, parse_float, parse_constant):
    """(value, place after it) of the scalar that begins at ``at``."""
    if text.startswith('"', at):
        return scanstring(text, at + 1, True)
    for name, value in _NAMED.items():
        if text.startswith(name, at):
            return value, at + len(name)
    for name in _CONSTANTS:
        if text.startswith(name, at):
            return parse_constant(name), at + len(name)
    found = _NUMBER.match(text, at)
    if not found:
        raise ValueError(f"no value at {at}")
    return (parse_float if found[2] or found[3] else parse_int)(found[0]), found.end()


def _load_deep(text: str, *parsers):
    """As ``json.loads``, with a stack of its own in place of recursion."""
    skip = lambda i: _SPACE.match(text, i).end()

    def name_at(i: int):
        if not text.startswith('"', i):
            raise ValueError(f"no field name at {i}")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if not text.startswith(":", i):
            raise ValueError(f"no colon at {i}")
        return name, skip(i + 1)

    inside: list = []
    names: list = []
    at = skip(0)
    while True:
        head = text[at : at + 1]
        if head in ("{", "["):
            value = {} if head == "{" else []
            at = skip(at + 1)
            if not text.startswith("}" if head == "{" else "]", at):
                inside.append(value)
                names.append(None)
                if head == "{":
                    names[-1], at = name_at(at)
                continue
            at += 1
        else:
            value, at = _scalar_at(text, at, *parsers)
        while True:
            at = skip(at)
            if not inside:
                if at != len(text):
                    raise ValueError(f"more after the value at {at}")
                return value
            around = inside[-1]
            if isinstance(around, dict):
                around[names[-1]] = value
            else:
                around.append(value)
            if text.startswith(",", at):
                at = skip(at + 1)
                if isinstance(around, dict):
                    names[-1], at = name_at(at)
                break
            if not text.startswith("}" if isinstance(around, dict) else "]", at):
                raise ValueError(f"no end of a container at {at}")
            value = inside.pop()
            names.pop()
            at += 1


def dump_json(value) -> str:
    """A value as JSON text, whatever its depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple] = [(value, False)]
    while todo:
        item, is_text = todo.pop()
        if is_text:
            out.append(item)
        elif isinstance(item, dict):
            out.append("{")
            todo.append(("}", True))
            pairs = [x for i, (k, v) in enumerate(item.items()) for x in ((f"{', ' if i else ''}{json.dumps(k, ensure_ascii=False)}: ", True), (v, False))]
            todo.extend(reversed(pairs))
        elif isinstance(item, list):
            out.append("[")
            todo.append(("]", True))
            todo.extend(reversed([x for i, v in enumerate(item) for x in ((", " if i else "", True), (v, False))]))
        else:
            out.append(json.dumps(item, ensure_ascii=False))
    return "".join(out)


def words(text: str | None) -> list[str]:
    """The words of a text in reading order; none for null."""
    return WORD.findall(text.lower()) if text else []


def bare(text: str | None) -> str:
    """The bare text; empty for null."""
    return "".join(WORD.findall(text.lower())) if text else ""


def parse_container(text: str | None):
    """The object or array that a text spells out, with numbers kept as typed; None for anything else."""
    if not text:
        return None
    head = text.lstrip()[:1]
    if head not in ("{", "["):
        return None
    try:
        return load_json(text, str, str, str)
    except ValueError:
        return None


def scalar_text(value) -> str:
    """A JSON scalar as the text a writer would have typed."""
    if value is None:
        return "null"
    if value is True:
        return "true"
    if value is False:
        return "false"
    return str(value)


def leaf_texts(value):
    """Field names and scalar values of a parsed container, in reading order, without recursion."""
    stack = [value]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            for name, child in reversed(item.items()):
                stack.append(child)
                stack.append(name)
        elif isinstance(item, list):
            stack.extend(reversed(item))
        else:
            yield scalar_text(item)


def state_words(text: str | None) -> list[str]:
    """Words of a state: those of field names and values where it is JSON, else of the text."""
    value = parse_container(text)
    return words(text) if value is None else words(" ".join(leaf_texts(value)))
