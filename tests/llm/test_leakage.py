import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.text import bare, words
from tallyforge.llm import leakage as lk

DOC = "doc_id long, text string, item_id int, begin int, end int, spans int"
ITEM = "item_id long, lang string, text string, doc_id int"


def grams(tokens, n):
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def brute(docs, items):
    out = set()
    for d, text in docs:
        if text is None:
            continue
        w, b = grams(words(text), lk.WORDS), grams(bare(text), lk.CHARACTERS)
        for i, lang, t in items:
            if t and (grams(bare(t), lk.CHARACTERS) & b if lang == "zh" else grams(words(t), lk.WORDS) & w):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of"]) if rng.random() < 0.3 else f"w{rng.randrange(400)}"
    items = [(i, rng.choice(["en", "de", None]), " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(40)]
    items += [(100 + i, "zh", "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(rng.randrange(10, 80)))) for i in range(20)]
    items += [(200, "en", items[0][2]), (201, "en", ""), (202, "zh", None)]
    docs = []
    for i in range(120):
        text = " ".join(word() for _ in range(60))
        _, lang, t = rng.choice(items)
        if i % 3 and t:
            tokens = t if lang == "zh" else t.split(" ")
            n = rng.choice([11, 12, 13, 29, 30, 31, 80])
            part = tokens[: n] if rng.random() < 0.5 else tokens[-n:]
            part = part if lang == "zh" else ",\n".join(part).upper()
            text = f"{text} {'。'.join(part) if lang == 'zh' else part}! {text}"
        docs.append((i, text))
    return docs + [(900, None), (901, ""), (902, "İ" * 50 + " " + items[3][2]), (903, "x " * 400_000 + items[5][2])], items


def test_leaks_equal_brute_force(spark, data):
    docs, items = data
    d = spark.createDataFrame([(*x, 0, 0, 0, 0) for x in docs], DOC)
    i = spark.createDataFrame([(*x, 0) for x in items], ITEM)
    assert {tuple(r) for r in lk.leaks(d, i).collect()} == brute(docs, items)


def test_blocks_of_items_change_nothing(spark, data, monkeypatch):
    docs, items = data
    d, i = spark.createDataFrame([(*x, 0, 0, 0, 0) for x in docs], DOC), spark.createDataFrame([(*x, 0) for x in items], ITEM)
    monkeypatch.setattr(lk, "BLOCK_CHARS", 900)
    assert {tuple(r) for r in lk.leaks(d, i).collect()} == brute(docs, items)


def test_cleaned_documents_leak_no_more(spark, data):
    docs, items = data
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, 0) for x in items], ITEM)
    clean = lk.without_leaks(d, i)
    assert clean.count() == len(docs)
    rows = {r["doc_id"]: r for r in clean.collect()}
    leaking = {a for a, _ in brute(docs, items)}
    for n, text in docs:
        if n not in leaking:
            assert rows[n]["text"] == text and (rows[n]["removed_chars"] in (0, None))
        else:
            assert rows[n]["removed_chars"] == len(text) - len(rows[n]["text"]) > 0
    one = "keep this. " + items[6][2].upper().replace(" ", " - ") + " and this"
    got = lk.without_leaks(spark.createDataFrame([(1, one)], "doc_id long, text string"), i).first()
    if len(items[6][2].split()) >= lk.WORDS:
        assert got["text"] == "keep this.  and this"


def test_empty_tables(spark, data):
    _, items = data
    d, i = spark.createDataFrame([], DOC), spark.createDataFrame([(*x, 0) for x in items], ITEM)
    assert lk.leaks(d, i).count() == 0 and lk.leaks(d, i.limit(0)).count() == 0
    assert lk.leaks(d, i.withColumn("text", F.lit("too short"))).count() == 0
