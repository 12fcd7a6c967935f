import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import percentiles as pc

NAN, INF = float("nan"), float("inf")


def exact(xs, q):
    return sorted(xs)[math.floor(q * (len(xs) - 1))]


@pytest.mark.parametrize("error", [0.1, 0.01, 0.001])
def test_error_bound_holds(spark, error):
    rng = random.Random(1)
    values = [("a", rng.lognormvariate(3, 4)) for _ in range(3000)] + [("b", rng.uniform(0, 1e-300)) for _ in range(300)] + [("c", 5.0)] * 50 + [("d", 0.0)] * 5 + [("d", 1e308)]
    df = spark.createDataFrame(values, "k string, x double")
    got = {r["k"]: r for r in pc.percentiles(pc.sketch(df, "x", ["k"], error), ["k"], (0.0, 0.5, 0.95, 1.0)).collect()}
    for k in "abcd":
        xs = [x for g, x in values if g == k]
        assert got[k]["n"] == len(xs)
        for q, name in ((0.0, "p0"), (0.5, "p50"), (0.95, "p95"), (1.0, "p100")):
            v = exact(xs, q)
            assert abs(got[k][name] - v) <= error * abs(v) + 5e-324


def test_days_combine_into_the_whole(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randrange(9), rng.choice("uv"), rng.lognormvariate(5, 1)) for _ in range(2000)], "day int, k string, x double")
    days = pc.sketch(df, "x", ["day", "k"])
    merged = sorted(map(tuple, pc.merge(days, ["k"]).collect()))
    assert merged == sorted(map(tuple, pc.sketch(df, "x", ["k"]).collect()))
    halves = pc.merge(pc.sketch(df.where("day < 4"), "x", ["k"]).unionByName(pc.sketch(df.where("day >= 4"), "x", ["k"])), ["k"])
    assert sorted(map(tuple, halves.collect())) == merged


def test_invalid_values_groups_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None), ("a", NAN), ("a", INF), ("a", -INF), ("a", -2.0), (None, 4.0), (None, 4.0)], "k string, x double").withColumn("n", F.lit(1)).withColumn("sign", F.lit(1)).withColumn("bucket", F.lit(1))
    got = pc.percentiles(pc.sketch(df, "x", ["k"]), ["k"]).collect()
    assert [(r["k"], r["n"]) for r in got] == [(None, 2)] and abs(got[0]["p50"] - 4) <= 0.04
    assert pc.percentiles(pc.sketch(df.limit(0), "x", ["k"]), ["k"]).count() == 0


def test_negative_values_keep_their_order(spark):
    xs = [-100.0, -10.0, -1.0, 0.0, 1.0, 10.0, 100.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    points = tuple(i / 6 for i in range(7))
    row = pc.percentiles(pc.sketch(df, "x", [], negatives=True), [], points).first()
    marks = [row[i + 1] for i in range(7)]
    assert marks == sorted(marks) and all(abs(m - x) <= 0.01 * abs(x) for m, x in zip(marks, xs))


def test_bad_bound():
    with pytest.raises(ValueError):
        pc.gamma(0)


@pytest.mark.parametrize("error", [0.3, 0.01, 0.0001])
def test_marks_of_the_largest_doubles_are_finite(spark, error):
    largest = 1.7976931348623157e308
    values = [largest, largest * 0.999, 1.79e308, 1e308, 2.3e-308, 5e-324]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(values)] + [("n", -largest)], "k string, x double")
    for r in pc.percentiles(pc.sketch(df, "x", ["k"], error, negatives=True), ["k"]).collect():
        x = -largest if r["k"] == "n" else values[int(r["k"])]
        assert math.isfinite(r["p50"]) and abs(r["p50"] - x) <= error * abs(x) + 5e-324 and r["error_bound"] == error


def test_sketches_of_different_bounds_do_not_mix(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, x double")
    both = pc.merge(pc.sketch(df, "x", ["k"], 0.01).unionByName(pc.sketch(df, "x", ["k"], 0.02)), ["k"])
    with pytest.raises(Exception, match="different error bounds"):
        pc.percentiles(both, ["k"]).collect()
    with pytest.raises(ValueError, match="rename"):
        pc.sketch(df.withColumnRenamed("k", "n"), "x", ["n"])
