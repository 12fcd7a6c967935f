import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.text import state_words
from tallyforge.llm import bits
from tallyforge.llm import overlap as ov

VOCABULARY = [f"w{i}" for i in range(3000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "no long, side string, state string").withColumns({"key": F.lit(1), "cls": F.lit(2), "words": F.lit("x"), "bucket": F.lit(3), "text": F.lit("t")})


def pairs(df):
    return {(r["t"], r["e"]) for r in ov.CrossSplitOverlap(df, "no", "state", F.col("side")).record_pairs().collect()}


def brute(rows):
    sets = {no: (side, frozenset(state_words(s))) for no, side, s in rows if side and s}
    t = [(n, w) for n, (s, w) in sets.items() if s == "t" and w]
    e = [(n, w) for n, (s, w) in sets.items() if s == "e" and w]
    return {(a, b) for a, x in t for b, y in e if len(x & y) >= 0.8 * len(x | y)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = [rng.sample(VOCABULARY, rng.randrange(12, 60)) for _ in range(150)]
    made = [(i, "t", " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        kept = [x for x in w if rng.random() > rng.choice([0, 0.05, 0.1, 0.3])]
        rng.shuffle(kept)
        text = " ".join(kept).upper() if i % 2 else json.dumps({kept[0]: {kept[1]: kept[2:]}}) if len(kept) > 2 else "x"
        made.append((1000 + i, "e", text))
    copies = [(2000 + i, "t" if i % 3 else "e", "same words everywhere again") for i in range(30)]
    return made + copies + [(3000, "t", ""), (3001, "e", None), (3002, None, made[0][2]), (3003, "e", "  ...  "), (3004, "t", None), (3005, "e", "{}")]


def test_pairs_equal_brute_force(spark, rows):
    expected = brute(rows)
    assert len(expected) > 250
    assert pairs(frame(spark, rows)) == expected


def test_counts_equal_the_pairs(spark, rows):
    got = {r["e"]: r["pairs"] for r in ov.CrossSplitOverlap(frame(spark, rows), "no", "state", F.col("side")).held_counts().collect()}
    expected = {}
    for _, e in brute(rows):
        expected[e] = expected.get(e, 0) + 1
    assert got == expected


def test_empty_sides(spark, rows):
    df = frame(spark, rows)
    assert pairs(df.where("side = 't'")) == set() and pairs(df.limit(0)) == set()


def test_very_long_texts(spark):
    text = " ".join(f"a{i}" for i in range(200_000))
    assert pairs(frame(spark, [(1, "t", text), (2, "e", text + " b"), (3, "e", "a1 a2")])) == {(1, 2)}


def test_near_the_threshold_few_pairs_are_missed():
    rng = np.random.default_rng(3)
    missed = trials = 0
    for _ in range(300):
        common, own = 40, 5  # 40 / 50 = 0.8 exactly
        values = rng.choice(1 << 32, size=common + 2 * own, replace=False).astype(np.uint32)
        keys = ov.band_keys(ov.signatures([values[: common + own], np.concatenate([values[:common], values[common + own :]])]))
        missed += not (keys[:, 0] == keys[:, 1]).any()
        trials += 1
    assert missed / trials < 0.01


def test_signatures_do_not_depend_on_the_other_sets():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 32, rng.integers(1, 90), dtype=np.uint32) for _ in range(700)] + [rng.integers(0, 1 << 32, 100_000, dtype=np.uint32)]
    together = ov.signatures(sets)
    for i in (0, 13, 699, 700):
        assert (together[:, i] == ov.signatures([sets[i]])[:, 0]).all()
        assert (together[7, i] == ((sets[i] ^ ov.XORS[7]) * ov.ODDS[7]).min()).all()


def test_bit_array_never_forgets(spark, monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    array = bits.packed(list(bits.bit_positions(hashes, bits.bits_for(100_000))), bits.bits_for(100_000))
    assert bits.maybe_present(array, hashes).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert bits.maybe_present(array, others).mean() < 0.05
    values = spark.range(5000).select((F.col("id") * F.lit(0x1E3779B97F4A7C15 % (1 << 40))).alias("h"))
    for parts, most in ((1, 1 << 27), (5, 1 << 27), (7, 1 << 16)):
        monkeypatch.setattr(bits, "MOST", most)
        built = bits.build(values.repartition(parts), bits.column, 5000)
        assert bits.maybe_present(built.value, np.array([r[0] for r in values.collect()], np.int64).view(np.uint64)).all()
    monkeypatch.setattr(bits, "MOST", 1 << 12)
    assert bits.build(values, bits.column, 5000) is None
    assert bits.bits_for(0) and not bits.maybe_present(bits.build(values.limit(0), bits.column, 0).value, hashes).any()


def test_pairs_are_the_same_without_a_bit_array_and_with_hot_keys(spark, rows, monkeypatch):
    from tallyforge.operators import skew

    monkeypatch.setattr(bits, "MOST", 1)
    monkeypatch.setattr(skew, "LEAST", 3)
    assert pairs(frame(spark, rows)) == brute(rows)


def test_classes_and_members_say_what_the_pairs_say(spark, rows):
    made = ov.CrossSplitOverlap(frame(spark, rows), "no", "state", F.col("side"))
    side, cls = {}, {}
    for r in made.members().collect():
        side[r["key"]], cls[r["key"]] = r["side"], r["cls"]
    linked = {(r["cls_t"], r["cls_e"]) for r in made.linked_classes().collect()}
    assert {(a, b) for a in cls for b in cls if side[a] == "t" and side[b] == "e" and (cls[a], cls[b]) in linked} == brute(rows)
    assert len({c for k, c in cls.items() if 2000 <= k < 3000}) == 1


def test_numbers_are_sent_short_and_come_back():
    for n in (0, 1, 5, 100_000, 1_000_000):
        numbers = np.unique(np.random.default_rng(n).integers(0, 1 << 21, n, dtype=np.uint32))
        assert (bits.lengthened(bits.shortened(numbers, 1 << 21), 1 << 21) == bits.packed([numbers], 1 << 21)).all()


@pytest.mark.parametrize("held", [1 << 23, 100])
def test_what_was_given_twice(spark, monkeypatch, held):
    monkeypatch.setattr(bits, "_HELD", held)
    once = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 4000, dtype=np.int64)
    rows = [(int(x),) for x in [*once, *once[:700]]]
    for parts in (1, 5):
        built = bits.build(spark.createDataFrame(rows, "h long").repartition(parts), bits.column, len(rows), twice=True).value
        assert bits.maybe_present(built[0], once.view(np.uint64)).all() and bits.maybe_present(built[1], once[:700].view(np.uint64)).all()
        assert bits.maybe_present(built[1], once[700:].view(np.uint64)).mean() < 0.05
