import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators import aggregates as ag
from tallyforge.operators import joins, latency


def test_latency_percentiles_match_a_sort(spark):
    rng = random.Random(1)
    values = [("a", rng.lognormvariate(5, 2)) for _ in range(501)] + [("b", 7.0)] * 300 + [("b", 8.0)] * 20 + [("c", None), ("c", float("nan")), ("c", float("inf")), ("c", -1.0), (None, 3.0)]
    df = spark.createDataFrame(values, "k string, v double")
    nearest = {r["k"]: r for r in latency.latency_nearest(df, "v", ["k"]).collect()}
    linear = {r["k"]: r for r in latency.latency_linear(df, "v", ["k"]).collect()}
    for k in "ab":
        xs = sorted(v for g, v in values if g == k)
        n = len(xs)
        assert nearest[k]["n"] == n and nearest[k]["p95"] == xs[-(-95 * n // 100) - 1]
        assert nearest[k]["p50"] == pytest.approx(statistics.median(xs)) and linear[k]["median"] == pytest.approx(statistics.median(xs))
        at = 0.95 * (n - 1)
        assert linear[k]["p95"] == pytest.approx(xs[int(at)] + (xs[min(n - 1, int(at) + 1)] - xs[int(at)]) * (at - int(at)))
    assert nearest["c"]["n"] == 0 and nearest["c"]["p95"] is None and nearest[None]["p95"] == 3.0


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 40, 41, 100, 1000])
def test_nearest_rank_definition(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v"))
    r = latency.latency_nearest_both(df, "v").first()
    assert (r["p50"], r["p95"]) == (-(-n // 2), -(-95 * n // 100))


def test_latency_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert latency.latency_nearest(df, "v", ["k"]).count() == 0
    assert latency.latency_nearest(df, "v").first()["n"] == 0


def test_replay_summary(spark):
    rows = [(True, 100.0, 10.0, 1000, 20), (True, 300.0, 30.0, 2000, 0), (True, 200.0, None, None, None), (False, 9999.0, 900.0, 9999, 9999)]
    df = spark.createDataFrame(rows, "success boolean, total_duration_ms double, ttft_ms double, prompt_tokens long, completion_tokens long").withColumns({"decode_latency_ms": F.lit(None).cast("double"), "decode_tokens": F.lit(None).cast("double")})
    r = ag.replay_summary(df).first()
    assert (r["successful"], r["failed"], r["ttft"], r["avg_task"], r["avg_prefill"], r["avg_output"], r["output_n"], r["tpot"]) == (3, 1, 20, 200, 1500, 10, 2, None)
    assert ag.replay_summary(df.where("not success")).first()["avg_task"] is None


def test_decode_stats(spark):
    df = spark.createDataFrame([("x", 10.0, 2.0, [1.0, 0.5], 4, 40.0), ("x", 30.0, 3.0, [0.5, 0.0], 6, 120.0), ("y", None, None, None, None, None)], "c string, ttft double, segment_length double, rates array<double>, decode_tokens long, decode_latency_ms double")
    got = {r["c"]: r for r in ag.decode_stats(df, "c").collect()}
    assert (got["x"]["ttft"], got["x"]["tpot"], got["x"]["segment_length"]) == (20, 16, 2.5) and got["[OVERALL]"]["n"] == 3 and got["y"]["tpot"] is None
    assert [r["acceptance"] for r in ag.mean_positions(df, "rates").orderBy("position").collect()] == [0.75, 0.25]


def test_calibration_and_auroc(spark):
    df = spark.createDataFrame([(0.75, True), (0.25, False)], "p double, y boolean")
    assert ag.calibration_error(df, "p", "y").first()["ece"] == pytest.approx(0.25)
    ties = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False), (None, True)], "p double, y boolean")
    assert ag.auroc(ties, "p", "y").first()["auroc"] == pytest.approx(0.875)
    assert ag.auroc(ties.where("y"), "p", "y").first()["auroc"] is None


def test_question_and_family_metrics(spark):
    rows = [("clean", "f", "yes", True, None), ("clean", "f", "yes", False, "e"), ("permuted", "g", "no", False, None)]
    df = spark.createDataFrame(rows, "variant string, family string, gold string, correct boolean, error string").withColumn("ae", F.lit(None).cast("double"))
    got = {(r["grouping"], r["key"]): r for r in ag.grouped(df, ["variant"], ag.question_metrics(F.col("correct"), F.col("error"), F.col("ae"))).collect()}
    assert got[("all", "all")]["accuracy"] == pytest.approx(1 / 3) and got[("variant", "clean")]["accuracy"] == 0.5 and got[("variant", "clean")]["n"] == 2
    assert ag.family_balanced(df, "family", "gold", "correct").first()["family_balanced_accuracy"] == 0.25


def two_runs(spark):
    rows = [("A", 1, "f1", True), ("A", 2, "f1", True), ("A", 3, "f2", False), ("A", 4, "f2", True), ("B", 1, "f1", True), ("B", 2, "f1", False), ("B", 3, "f2", False), ("B", 4, "f2", None)]
    return spark.createDataFrame(rows, "run string, id int, family string, correct boolean").withColumn("kind", F.lit("choice"))


def test_two_run_comparison(spark):
    made = joins.compare_runs(two_runs(spark), "id", "run", "correct", "family", "kind")
    accuracy = {(r["run"], r["type"]): r["accuracy"] for r in made["accuracy"].collect()}
    assert accuracy[("A", "all")] == 0.75 and accuracy[("B", "choice")] == 0.25
    assert {r["run"]: r["complete"] for r in made["families"].collect()} == {"A": 1, "B": 0}
    p = made["pairs"].first()
    assert (p["both"], p["left_only"], p["right_only"], p["neither"], p["p_value"]) == (1, 2, 0, 1, 0.5)


def test_agreement_denominators(spark):
    df = spark.createDataFrame([("a", "a", False), ("a", "b", False), ("a", None, True), (None, "a", False)], "b string, p string, failed boolean")
    r = ag.agreement(df, [], "b", "p", F.col("failed")).first()
    assert (r["rows"], r["comparable"], r["agreement"], r["successes"], r["agreement_success_only"]) == (4, 3, 1 / 3, 2, 0.5)
    empty = ag.agreement(df.limit(0), [], "b", "p", F.col("failed")).first()
    assert empty["agreement"] is None and empty["rows"] == 0


def test_assess_and_complete_mean(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2], 0), ([0.0, 1.0, 0.0], 0)], "p array<double>, r int")
    rows = df.select(*ag.assess(F.col("p"), F.col("r"), F.lit("score"))).collect()
    assert rows[0]["correct"] and rows[0]["expected_score"] == pytest.approx(0.8) and rows[1]["negative_log_likelihood"] == pytest.approx(34.538776)
    part = spark.createDataFrame([(1.0,), (None,)], "x double").agg(ag.complete_mean(F.col("x")).alias("m")).first()
    assert part["m"] is None


def test_pivot_budget_and_usage(spark):
    calls = spark.createDataFrame([(1, "s", 1, 5.0), (1, "s", 2, 6.0), (2, "s", 1, 7.0)], "q int, stage string, k int, ms double")
    wide = {r["q"]: r.asDict() for r in ag.dynamic_pivot(calls, "q", "stage", "k", ["ms"], ["s", "t"]).collect()}
    assert wide[1] == {"q": 1, "s_1_ms": 5.0, "s_2_ms": 6.0, "t_1_ms": None} and wide[2]["s_2_ms"] is None
    spend = spark.createDataFrame([(i, 1.0) for i in range(1, 30_001)], "i long, x double")
    assert ag.budget_breach(spend, "i", "x", 25_000).first()["first_over"] == 25_001
    assert ag.budget_breach(spend, "i", "x", 1e9).first()["first_over"] is None
    use = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), (None, 2, 2), (None, 2, 2)], "id string, i long, o long")
    r = ag.usage_cost(use, "id", "i", "o", 4.0, 20.0).first()
    assert (r["responses"], r["input_tokens"], round(r["cost"] * 1e6, 6)) == (3, 5, 120)
    drift = ag.drift(spark.createDataFrame([(1, {"a": 0.9, "b": 0.1}, "a")], "id int, p map<string,double>, x string"), spark.createDataFrame([(1, {"a": 0.4, "b": 0.6}, "b")], "id int, p map<string,double>, x string"), "id", "p", "x").first()
    assert drift["flips"] == 1 and drift["max_difference"] == pytest.approx(0.5)
    assert stats.BINS == 10
