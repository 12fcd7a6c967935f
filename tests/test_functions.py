import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import parse as pr
from tallyforge.functions import stats
from tallyforge.functions.rolling import code_points, joined_windows, window_runs, windows
from tallyforge.functions.text import bare, state_words, words


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_interval_and_paired_test_values(spark):
    w = one(spark, stats.wilson(F.lit(2), F.lit(4)).alias("w"))["w"]
    assert w["low"] == pytest.approx(0.15004, abs=1e-5) and w["high"] == pytest.approx(0.84996, abs=1e-5)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0)).alias("w"))["w"] is None
    p = lambda b, c: one(spark, stats.mcnemar(F.lit(b), F.lit(c)).alias("p"))["p"]
    assert p(3, 0) == pytest.approx(0.25) and p(0, 0) == 1
    assert round(p(18, 6), 4) == 0.0227 and round(p(11, 9), 4) == 0.8238
    assert p(5000, 5000) == 1 and 0 < p(3000, 4000) < 1e-30


def test_divergences(spark):
    half, sure, other = arr(0.5, 0.5), arr(1, 0), arr(0, 1)
    r = one(spark, stats.jensen_shannon(sure, sure).alias("a"), stats.jensen_shannon(sure, other).alias("b"), stats.jensen_shannon(sure, half).alias("c"), stats.total_variation(sure, half).alias("d"), stats.entropy(half).alias("e"))
    assert (r["a"], r["b"], r["d"], r["e"]) == (0, 1, 0.5, 1) and r["c"] == pytest.approx(0.311278124459133)


def test_bins_argmax_levels(spark):
    ps = [0.0, 0.0999, 0.1, 0.8999999999999999, 0.9, 1.0]
    assert list(one(spark, F.array(*(stats.calibration_bin(F.lit(p)) for p in ps)).alias("b"))["b"]) == [0, 0, 1, 8, 9, 9]
    assert one(spark, stats.argmax(arr(0.4, 0.4, 0.2)).alias("i"))["i"] == 0
    assert list(one(spark, F.array(*(stats.half_up_level(F.lit(m)) for m in (4.67, 2.5, 1.0, 5.0))).alias("l"))["l"]) == [4, 2, 0, 4]
    assert one(spark, stats.normalise(arr(0, 0)).alias("p"))["p"] is None


def test_acceptance(spark):
    r = one(spark, stats.acceptance(F.array(*map(F.lit, (4, 2, 1))), 3).alias("a"), stats.acceptance(F.array(F.lit(5)), 3).alias("b"))
    assert [round(x, 3) for x in r["a"]] == [0.667, 0.333, 0.333] and r["b"] is None


def test_event_stream(spark):
    body = ": keep\r\n\r\n" + "\r\n\r\n".join(["data: " + e for e in ('{"choices":[{"delta":{"role":"assistant"}}]}', '{"choices":[{"delta":{"content":"完"}}]}', '{"choices":[{"delta":{"content":"成"}}]}', '{"choices":[],"usage":{"completion_tokens":4}}', "[DONE]", '{"choices":[{"delta":{"content":"late"}}]}')]) + "\r\n\r\n"
    whole = '{"choices": [{"message": {"content": "all"}}], "usage": {"input_tokens": 3, "output_tokens": -1}}'
    df = spark.createDataFrame([(1, body), (2, whole), (3, ""), (4, None)], "i int, body string").withColumn("r", pr.fold_events(pr.events(F.col("body")))).withColumn("done", pr.sse_complete(F.col("body")))
    got = {r["i"]: r for r in df.collect()}
    assert got[1]["r"]["content"] == "完成" and got[1]["r"]["completion_tokens"] == 4 and got[1]["done"]
    assert got[2]["r"]["content"] == "all" and got[2]["r"]["prompt_tokens"] == 3 and got[2]["r"]["completion_tokens"] is None
    assert got[3]["r"]["content"] == "" and got[4]["r"] is None


def test_labels_and_targets(spark):
    rows = [("noul", "true", "true"), ("noul", '"true"', None), ("score", "2", "2"), ("score", "2.5", None), ("score", '"2"', None), ("choice", '"a"', "a"), ("choice", "1", None), ("choice", None, None)]
    df = spark.createDataFrame(rows, "kind string, target string, expected string").select("expected", pr.target_key(F.col("target"), F.col("kind")).alias("k"))
    assert all(r["k"] == r["expected"] for r in df.collect())
    names = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    r = one(spark, pr.baseline_label(names("a", "a"), F.lit(None).cast("string"), F.lit(200)).alias("one"), pr.baseline_label(names("a", "b"), F.lit("x"), F.lit(200)).alias("many"), pr.baseline_label(names(), F.lit("text"), F.lit(200)).alias("none"), pr.baseline_label(names("a"), F.lit("x"), F.lit(500)).alias("failed"), pr.baseline_label(names(), F.lit(" "), F.lit(200)).alias("empty"))
    assert (r["one"], r["many"], r["none"], r["failed"], r["empty"]) == ("a", None, pr.NO_SKILL, None, None)
    with pytest.raises(Exception, match="more than one tool"):
        one(spark, pr.baseline_label(names("a", "b"), F.lit("x"), F.lit(200), "raise").alias("x"))


def test_predictions_and_decoding(spark):
    r = one(spark, pr.predict(F.lit("score"), F.lit(None), arr(0.35, 0.2, 0.45)).alias("s"), pr.predict(F.lit("score"), F.lit(None), arr(0.4, 0.4)).alias("tie"), pr.predict(F.lit("noul"), F.lit(None), arr(0.5)).alias("n"))
    assert (r["s"], r["tie"], r["n"]) == ("2", "0", "false")
    options = F.array(F.lit("A — yes"), F.lit("B — no"))
    d = one(spark, pr.decode_target(F.lit("A"), F.lit("choice"), options).alias("a"), pr.decode_target(F.lit("C"), F.lit("choice"), options).alias("c"), pr.decode_target(F.lit("True"), F.lit("noul"), options).alias("t"))
    assert (d["a"], d["c"], d["t"]) == ("A — yes", None, "true")


def test_answers(spark):
    texts = ['```json\n{"label": "a", "confidence": 50}\n```', 'I say {"label": "a", "confidence": 100}.', '{"label": "z", "confidence": 1}', '{"label": "a", "confidence": 101}', "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pr.label_answer(F.col("t"), F.array(F.lit("a"))).alias("x"))
    got = {r["i"]: tuple(r["x"]) for r in df.collect()}
    assert got[0] == ("a", 0.5, None) and got[1] == ("a", 1.0, None)
    assert [got[i][2] for i in (2, 3, 4, 5)] == ["unknown label", "bad confidence", "no JSON object", "no JSON object"]


def test_python_backed_functions(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": [{"c": "x"}, "y"]}', "Ａ b-C！", "a b c", "a x c d"), ("{", None, None, "x"), (None, "", "", "")], "j string, t string, l string, r string")
    got = df.select(pr.canonical_json("j").alias("c"), pr.flat_text("j").alias("f"), pr.nested_keys("j").alias("k"), pr.match_key("t").alias("m"), pr.changed_words("l", "r").alias("d"), pr.repeated_names("j").alias("n"), pr.with_distractor("j", F.lit("more")).alias("w"), pr.python_parses("t").alias("p")).collect()
    assert got[0]["c"] == '{"a": [{"c": "x"}, "y"], "b": 1.0}' and got[0]["f"] == "x\ny" and list(got[0]["k"]) == ["a", "b", "c"]
    assert got[0]["m"] == "abc" and got[0]["d"] == 2 and got[0]["n"] is False and '"note": "more"' in got[0]["w"]
    assert got[1]["c"] is None and got[1]["f"] == "{" and got[2]["c"] is None and got[2]["w"] is None
    assert one(spark, pr.repeated_names(F.lit('{"a": 1, "a": 2}')).alias("n"))["n"]
    assert one(spark, pr.text_on_path(F.lit('{"a": [{"b": "x"}]}'), F.array(F.lit("a"), F.lit("0"), F.lit("b"))).alias("n"))["n"] == "x"


def test_requests(spark):
    array = lambda *xs: F.array(*map(F.lit, xs))
    r = one(
        spark,
        pr.wrap_paragraph(F.lit('"The sky is blue."'), F.lit('{"a": 1}'), array("sky", "blue")).alias("w"), pr.wrap_paragraph(F.lit('"sky sky"'), F.lit('{"a": 1}'), array("sky", "blue")).alias("v"),
        pr.encode_literal(F.lit('Say "hi" now'), F.lit(True), array("Say", "now")).alias("e"), pr.encode_literal(F.lit('{"broken'), F.lit(True), array("b", "k")).alias("b"), pr.encode_literal(F.lit("Say now"), F.lit(False), array("Say", "now")).alias("n"),
        pr.adapt_input(F.lit("s"), F.lit("score"), F.lit("i"), F.lit('["low", "high"]')).alias("a"), pr.adapt_input(F.lit("s"), F.lit("choice"), F.lit("i"), F.lit('{"x": "1", "y": "2"}')).alias("c"),
        pr.route_payload(array("f"), array("does f"), F.lit("q"), F.lit("plan"), "m", "question").alias("q"),
    )
    assert r["w"] == '{"context":"The sky is blue."}' and r["v"] == '"sky sky"' and r["e"] == '"Say \\"hi\\" now"' and r["b"] == '{"broken' and r["n"] == "Say now"
    assert list(r["a"]["choices"]) == ["0", "1"] and list(r["c"]["choices"]) == ["x", "y"] and r["a"]["type"] == "enum"
    assert '"current_plan"' not in r["q"] and pr.NO_SKILL in r["q"]
    with pytest.raises(Exception, match="unsupported question type"):
        one(spark, pr.adapt_input(F.lit("s"), F.lit("essay"), F.lit("i"), F.lit("{}")).alias("x"))


def test_small_expressions(spark):
    r = one(
        spark, pr.span_edit(F.lit("a.b.a"), F.lit("b"), F.lit("c")).alias("e"), pr.span_edit(F.lit("aa"), F.lit("a"), F.lit("c")).alias("n"), pr.csv_cell(F.lit(" a, ,b ")).alias("c"),
        pr.legend_matches(F.create_map(F.lit("0"), F.lit("low"), F.lit("1"), F.lit("high")), F.array(F.lit("low"), F.lit("high"))).alias("l"), pr.first_nonblank(F.lit(" "), F.lit(None).cast("string"), F.lit(" x ")).alias("f"),
        pr.arguments_or_empty(F.lit("{bad")).alias("a"), pr.renamed(F.lit("old"), {"old": "new"}).alias("r"), pr.text_at(F.lit('{"a": {"b": "x"}}'), "$.a.b").alias("t"), pr.text_at(F.lit('{"a": 1}'), "$.a").alias("u"),
    )
    assert (r["e"], r["n"], list(r["c"]), r["l"], r["f"], r["a"], r["r"], r["t"], r["u"]) == ("a.c.a", None, ["a", "b"], True, "x", "{}", "new", "x", None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=12), max_size=5), st.integers(1, 4))
def test_rolling_windows_equal_exactly_where_texts_do(texts, width):
    hashes, owner, position = joined_windows([code_points(t) for t in texts], width)
    assert len(hashes) == sum(max(0, len(t) - width + 1) for t in texts)
    seen = {}
    for h, o, p in zip(hashes.tolist(), owner.tolist(), position.tolist()):
        assert seen.setdefault(texts[o][p : p + width], h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=30), max_size=5), st.integers(1, 4), st.integers(1, 7))
def test_runs_hold_the_same_windows(texts, width, most):
    parts = [code_points(t) for t in texts]
    whole = list(zip(*(x.tolist() for x in joined_windows(parts, width))))
    runs = [w for run in window_runs(parts, width, most=most) for w in zip(*(x.tolist() for x in run))]
    assert [(o, p) for _, o, p in runs] == [(o, p) for _, o, p in whole] and [h for h, _, _ in runs] == [h for h, _, _ in whole]


def test_rolling_windows_do_not_depend_on_place():
    a, b = windows(code_points("xxhello"), 5), windows(code_points("hello"), 5)
    assert a[2] == b[0] and len(windows(code_points("abc"), 4)) == 0


def test_words_and_bare_text():
    assert words("A-b_C 1é中文!") == ["a", "b", "c", "1é中文"] and words(None) == [] and bare(" -- ") == ""
    assert state_words('{"Key_1": ["a b", true, null, 1.5]}') == ["key", "1", "a", "b", "true", "null", "1", "5"]
    assert state_words('{"broken": ') == ["broken"]
    assert math.isclose(1, 1)
