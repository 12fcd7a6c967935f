import json
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions.text import bare
from tallyforge.llm import copies as cp


def structure(value):
    """The normalised structure, by plain recursion."""
    if isinstance(value, dict):
        return ("o", tuple(sorted((bare(k), structure(v)) for k, v in value.items()))) if True else None
    if isinstance(value, list):
        return ("a", tuple(structure(v) for v in value))
    return ("l", bare({None: "null", True: "true", False: "false"}[value] if value is None or value is True or value is False else str(value)))


def key(value):
    return repr(structure(value))


leaves = st.one_of(st.none(), st.booleans(), st.integers(-20, 20), st.text(alphabet="aB1 -_.", max_size=4))
values = st.recursive(leaves, lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(st.text(alphabet="aB -", max_size=3), inner, max_size=3)), max_leaves=8)
containers = st.one_of(st.lists(values, max_size=3), st.dictionaries(st.text(alphabet="aB -", max_size=3), values, max_size=3))


@settings(max_examples=300, deadline=None)
@given(containers, containers)
def test_forms_are_equal_exactly_where_structures_are(a, b):
    one, two = cp.normal_form(json.dumps(a)), cp.normal_form(json.dumps(b))
    if one and two:
        assert (one == two) == (key(a) == key(b))
        assert (one[0] == two[0]) == (one[1] == two[1])


def shuffled(value):
    if isinstance(value, dict):
        return {f" {k.upper()}-": shuffled(v) for k, v in reversed(value.items())}
    if isinstance(value, list):
        return [shuffled(v) for v in value]
    return f"  {value.upper()}!! " if isinstance(value, str) else value


@settings(max_examples=200, deadline=None)
@given(containers)
def test_formatting_does_not_matter(a):
    b = shuffled(a)
    assert key(a) == key(b) or len(b) != len(a)
    one, two = cp.normal_form(json.dumps(a)), cp.normal_form(" " + json.dumps(b, indent=3))
    if key(a) == key(b):
        assert one == two


def test_what_counts_as_a_copy(spark):
    rows = [
        (1, "Hello, World"), (2, "hello world"), (3, "HELLOWORLD"), (4, "hello worlds"), (5, '{"a": [1, 2], "b": "x"}'), (6, '{"B": "X.", "A": [1,2]}'), (7, '{"a": [2, 1], "b": "x"}'), (8, "{}"), (9, ""), (10, None), (11, " -- "),
        (12, '{"broken": '), (13, "broken"), (14, '["", "-"]'), (15, '{"a": null}'), (16, '{"a": "null"}'), (None, "hello world"), (17, '{"a": [1, 2], "b": "x", "c": null}'), (2, "hello world"),
    ]
    df = spark.createDataFrame(rows, "n long, t string").withColumns({"no": F.lit(0), "digest": F.lit(0), "form": F.lit(0), "text": F.lit("")})
    forms = cp.forms(df, "n", "t")
    got = sorted(map(tuple, cp.copy_pairs(forms).collect()))
    assert got == [(1, 2), (1, 2), (1, 3), (5, 6), (12, 13), (15, 16)]
    groups = {r["kept_no"]: r["copies"] for r in cp.copy_groups(forms).collect()}
    assert groups[1] == 4 and groups[5] == 2 and groups[7] == 1 and 8 not in groups and 14 not in groups
    assert cp.copy_pairs(cp.forms(df.limit(0), "n", "t")).count() == 0


def test_deep_and_long_records(spark):
    deep = "[" * 900 + '"x"' + "]" * 900
    df = spark.createDataFrame([(1, deep), (2, deep.replace("x", "X ")), (3, "a b " * 300_000), (4, "A,b" * 300_000)], "n long, t string")
    assert sorted(map(tuple, cp.copy_pairs(cp.forms(df, "n", "t")).collect())) == [(1, 2), (3, 4)]
    assert defaultdict(int)[0] == 0


def test_a_hot_group_of_copies_is_spread_and_whole(spark, monkeypatch):
    from tallyforge.operators import skew

    monkeypatch.setattr(skew, "LEAST", 5)
    df = spark.createDataFrame([(i, "Same  Text!" if i % 2 else f"text {i}") for i in range(400)] + [(500, "text 0"), (501, "TEXT-0")], "no long, t string")
    got = {tuple(r) for r in cp.copy_pairs(cp.forms(df, "no", "t")).collect()}
    assert got == {(1, i) for i in range(3, 400, 2)} | {(0, 500), (0, 501)}
