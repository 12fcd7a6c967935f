"""Records nested deeper than any recursion goes, and joins with a hot key."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.text import _load_deep, dump_json, load_json, parse_container
from tallyforge.operators.nested import nodes, rejects
from tallyforge.operators import skew
from tallyforge.operators.skew import MOST, heavy_keys, hot_keys, spread_join

DEEP = 200_000


def test_deep_texts_load_and_dump():
    text = '{"a": [' * DEEP + "1.50" + "]}" * DEEP
    value = load_json(text)
    assert dump_json(value).replace(" ", "") == text.replace(" ", "").replace("1.50", "1.5")
    assert parse_container(text) is not None
    with pytest.raises(ValueError):
        load_json("[" * DEEP)


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\u00e9\\n", null, true, false, {}], "b": {"c": [[], [{}]]}, "a": 2}', " [ ] ", '"x"', "12", "-0", "NaN", "-Infinity"])
def test_own_parser_agrees(text):
    a, b = json.loads(text), _load_deep(text, int, float, float)
    assert repr(a) == repr(b)


@pytest.mark.parametrize("text", ["", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "[1]]", "01", "{1:2}", "[", '{"a":', "nul", "+1"])
def test_own_parser_refuses(text):
    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(ValueError):
        _load_deep(text, int, float, float)


def test_deep_record_has_its_nodes_and_rejects_are_told(spark):
    deep = '{"state": ' + '{"x": [' * 20_000 + '"end"' + "]}" * 20_000 + "}"
    df = spark.createDataFrame([(1, deep), (2, "[1"), (3, None), (4, " "), (5, "{}")], "no long, doc string")
    got = nodes(df, "no", "doc", {"state": "state", "all": ".*"}).groupBy("no").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max(F.length("path")).alias("path")).collect()
    assert {r["no"]: (r["n"], r["depth"]) for r in got} == {1: (40_002, 40_001), 5: (1, 0)}
    assert max(r["path"] for r in got) < 5000
    assert {tuple(r) for r in rejects(df, "no", "doc").collect()} == {(2, "not JSON"), (3, "null"), (4, "empty")}


def test_hot_key_is_spread_and_rows_stay(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 3000)).alias("k"), "id")
    counts = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    assert hot_keys(counts, ["k"], "n") is None
    hot = hot_keys(counts, ["k"], "n", least=100)
    assert [r[0] for r in hot.collect()] == ["hot"] and MOST > 1
    skew.LEAST, kept = 100, skew.LEAST
    assert [r[0] for r in heavy_keys(rows.where("k is not null"), ["k"], 20_000).collect()] == ["hot"]
    skew.LEAST = kept
    right = counts.select("k", F.col("n").alias("right"))
    joined = spread_join(rows, right, ["k"], hot, "id")
    assert joined.count() == rows.where("k is not null").count() and joined.select("id").distinct().count() == joined.count()
    assert spread_join(rows, right, ["k"], hot, "id", "left").count() == 20_000 and spread_join(rows, right, ["k"], None, "id").count() == joined.count()
    # no task of the join has the half of the rows that the hot key has
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shares = [r["count"] for r in spread_join(rows, right, ["k"], hot, "id").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", plain)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(shares) < 0.3 * sum(shares)
