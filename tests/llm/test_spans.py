import random
from collections import defaultdict

import pytest

from tallyforge.llm import spans as sp


def brute(docs):
    holders = defaultdict(set)
    for d, t in docs:
        if t and d is not None:
            for i in range(len(t) - sp.SPAN + 1):
                holders[t[i : i + sp.SPAN]].add(d)
    out = {}
    for d, t in docs:
        if not t or d is None:
            continue
        covered = [False] * len(t)
        for i in range(len(t) - sp.SPAN + 1):
            if len(holders[t[i : i + sp.SPAN]]) > 1:
                covered[i : i + sp.SPAN] = [True] * sp.SPAN
        solid = [i for i, c in enumerate(t) if not c.isspace()]
        n = sum(covered[i] for i in solid)
        if any(covered):
            out[d] = "whole" if n == len(solid) else "most" if 2 * n >= len(solid) else "part"
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    letters = "abcdefgh \n中é😀"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [text(rng.choice([149, 150, 151, 200, 330])) for _ in range(12)]
    made = []
    for i in range(90):
        t = text(rng.randrange(0, 400))
        for _ in range(rng.randrange(3)):
            piece = rng.choice(pool)
            at = rng.randrange(len(t) + 1)
            t = t[:at] + piece + t[at:]
        made.append((i, t))
    whole = text(500)
    return made + [(200, whole), (201, whole), (202, whole[:250] + " " * 30), (203, None), (204, ""), (205, "ab" * 400), (206, "ab" * 300), (207, "x" * 1000), (208, text(30_000) + whole)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 0, 0, 0) for d, t in docs], "doc_id long, text string, cls int, doc int, hash int")


def test_extents_equal_brute_force(spark, docs):
    got = {r["doc_id"]: r["extent"] for r in sp.SharedSpans(frame(spark, docs)).extents().collect()}
    assert got == brute(docs)


def test_stretches_are_maximal(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    a, b = text(300), text(160)
    docs = [(1, text(50) + "#" + a + "#" + text(40)), (2, "%" + a + "%" + b + "!"), (3, b), (4, a[:155] + "?"), (5, a[:155] + "?")]
    got = sorted(map(tuple, sp.SharedSpans(frame(spark, docs)).document_stretches().collect()))
    assert got == [(1, 51, 351), (2, 1, 301), (2, 302, 462), (3, 0, 160), (4, 0, 156), (5, 0, 156)]


def test_empty_and_short(spark):
    assert sp.SharedSpans(frame(spark, []).limit(0)).extents().count() == 0
    short = [(1, "a" * 149), (2, "a" * 149), (None, "a" * 200), (3, "a" * 200)]
    assert sp.SharedSpans(frame(spark, short)).extents().count() == 0


def test_repeated_row_is_not_another_document(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh") for _ in range(400))
    assert sp.SharedSpans(frame(spark, [(1, t), (1, t)])).extents().count() == 0


def test_copies_that_no_third_text_shares_have_counts(spark):
    t = "".join(chr(97 + i * i % 23) + " \x1c\u3000\n"[i % 5 :][:1] for i in range(200))
    got = {tuple(r) for r in sp.SharedSpans(frame(spark, [(1, t), (2, t), (3, "z" * 10)])).extents().collect()}
    n = sum(not c.isspace() for c in t)
    assert got == {(1, "whole", n, n), (2, "whole", n, n)}


@pytest.mark.parametrize("most", [1 << 27, 1 << 16, 1])
def test_small_pieces_and_no_bit_array_change_nothing(spark, docs, monkeypatch, most):
    from tallyforge.llm import bits
    from tallyforge.operators import skew

    monkeypatch.setattr(bits, "MOST", most)
    if most == 1 << 16:  # too few bits for hits, enough for a filter
        monkeypatch.setattr(sp, "_RATIO", 1 << 16)
    monkeypatch.setattr(skew, "LEAST", 3)
    monkeypatch.setattr(sp, "_MOST_HOT", 20)
    few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["doc_id"]: r["extent"] for r in sp.SharedSpans(frame(spark, docs)).extents().collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
    assert got == brute(docs)


def test_block_hashes_are_windows_at_their_places():
    import numpy as np

    from tallyforge.functions.rolling import code_points, windows

    text = code_points("".join(chr(97 + i * i % 23) for i in range(400)))
    hashes, part = sp.block_hashes([text[:74], text, text[:150]])
    assert part.tolist() == [1] * 5 + [2] * 2
    assert (hashes[:5] == windows(text, sp.BLOCK)[:: sp.BLOCK][:5]).all() and (hashes[5:] == hashes[:2]).all()
    assert np.unique(hashes[:5]).size == 5


def test_copies_of_a_text_in_many_batches_are_one_text(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    a, b = text(400), text(300)
    docs = [(i, a) for i in range(40)] + [(100, text(50) + b), (101, b + text(50)), (102, text(500))]
    few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {tuple(r) for r in sp.SharedSpans(frame(spark, docs)).extents().collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
    assert got == {(i, "whole", 400, 400) for i in range(40)} | {(100, "most", 300, 350), (101, "most", 300, 350)}
