import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import components as co

SCHEMA = "record_no long, split string, family string, source_family string, value int, node int, set_no int"


def clean(v):
    return None if v is None else v.strip().lower().replace("_", "-")


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, _, f, s in rows:
        values = [clean(v) for v in (f, s) if v is not None]
        for v in values:
            parent[find(values[0])] = find(v)
    sets = defaultdict(list)
    for no, split, f, s in rows:
        v = clean(f) if f is not None else clean(s) if s is not None else None
        if v is not None and no is not None:
            sets[find(v)].append((no, (split or "").strip().lower()))
    return {no: min(n for n, _ in members) for members in sets.values() for no, _ in members}, {no for members in sets.values() if len({s for _, s in members} & {"train", "validation", "eval", "test"}) > 1 for no, _ in members}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    name = lambda: rng.choice([None, f"F_{rng.randrange(60)}", f" f-{rng.randrange(60)} ", "hot"] if rng.random() < 0.3 else [f"f-{rng.randrange(400)}"])
    made = [(i, rng.choice(["train", "Train ", "eval", "TEST", None, "unassigned", "validation"]), name(), name()) for i in range(400)]
    chain = [(1000 + i, "train", f"c{i}", f"c{i + 1}") for i in range(40)] + [(2000, "test", "C40", None)]
    return made + chain + [(3000, "train", None, None), (3001, "train", "", " "), (3002, "test", " ", None)]


def test_sets_equal_union_find(spark, rows):
    sets, torn = brute(rows)
    df = frame(spark, rows)
    assert {r["record_no"]: r["set_no"] for r in co.torn_records(df).collect()} == {no: sets[no] for no in torn}
    assert sets[2000] == 1000 and 2000 in torn


def test_assignment_keeps_sets_together_and_near_the_weights(spark):
    rows = [(i, None, f"f{i // 3}", None) for i in range(6000)] + [(10_000 + i, None, "hot", f"h{i}") for i in range(2000)]
    df = frame(spark, rows)
    got = co.assign_splits(df, {"train": 0.7, "eval": 0.2, "test": 0.1, "none": 0}, large_share=0.005)
    assert got.count() == 8000
    assert got.groupBy("set_no").agg(F.count_distinct("new_split").alias("n")).where("n > 1").count() == 0
    shares = {r[0]: r[1] / 8000 for r in got.groupBy("new_split").count().collect()}
    assert abs(shares["train"] - 0.7) < 0.03 and abs(shares["eval"] - 0.2) < 0.03 and "none" not in shares
    with pytest.raises(ValueError):
        co.rendezvous(F.lit(1), {"a": 0})


def test_empty_and_null_inputs(spark):
    empty = frame(spark, []).limit(0)
    assert co.torn_records(empty).count() == 0 and co.assign_splits(empty, {"a": 1}).count() == 0
    nulls = frame(spark, [(None, "train", "f", None), (1, "test", "f", None), (2, None, None, None)])
    assert co.torn_records(nulls).count() == 0
    assert {r["record_no"] for r in co.assign_splits(nulls, {"a": 1}).collect()} == {1, 2}


def test_repeated_rows(spark):
    rows = [(1, "train", "f", None), (1, "train", "f", None), (2, "test", "F ", None)]
    assert sorted(map(tuple, co.torn_records(frame(spark, rows)).collect())) == [(1, 1), (2, 1)]


def test_weighted_rendezvous_moves_little(spark):
    keys = spark.range(20_000)
    one = keys.select("id", co.rendezvous(F.col("id"), {"a": 0.5, "b": 0.5}).alias("s"))
    two = keys.select("id", co.rendezvous(F.col("id"), {"a": 0.5, "b": 0.5, "c": 0.25}).alias("t"))
    moved = one.join(two, "id").where("s <> t")
    assert moved.where("t <> 'c'").count() == 0 and abs(moved.count() / 20_000 - 0.2) < 0.02
    assert re.match("a|b", one.first()["s"])


def test_other_records_do_not_move_a_set(spark):
    rows = [(i, None, f"f{i // 3}", None) for i in range(900)]
    more = rows + [(10_000 + i, None, "hot", None) for i in range(3000)]
    weights = {"train": 0.7, "eval": 0.3}
    one, two = (co.assign_splits(frame(spark, r), weights).select("record_no", "set_no", "new_split") for r in (rows, more))
    assert one.exceptAll(two).count() == 0
    assert [tuple(r)[:2] for r in co.large_sets(frame(spark, more), share=0.5).collect()] == [(10_000, 3000)]


def test_hot_values_are_spread(spark, monkeypatch, rows):
    from tallyforge.operators import skew

    monkeypatch.setattr(skew, "LEAST", 3)
    test_sets_equal_union_find(spark, rows)
    star = [(i, "train" if i % 2 else "test", "hub", f"leaf{i}") for i in range(500)]
    assert {tuple(r) for r in co.torn_records(frame(spark, star)).collect()} == {(i, 0) for i in range(500)}
