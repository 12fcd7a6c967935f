from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing, sampling

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

R = "id string, domain string, qtype string, subtopic string, k int, start double, rate double"
T = "domain string, qtype string, subtopic string, target_permille int, min_rows int"


def records(spark, *groups):
    return spark.createDataFrame([(f"{d}{s}{i}", d, "choice", s, 0, 0.0, 0.0) for d, s, n in groups for i in range(n)], R)


def targets(spark, *rows):
    return spark.createDataFrame([(d, "choice", s, p, m) for d, s, p, m in rows], T)


def test_shares_floors_and_unmet(spark):
    df = records(spark, ("a", "x", 6000), ("b", "y", 3000), ("c", "z", 900), ("d", "q", 100), (" A", " X ", 1000))
    t = targets(spark, ("a", "x", 300, 1), ("b", "y", 300, 1), ("c", "z", 395, 1), ("d", "q", 5, 20), ("e", "none", 0, 1))
    made = sampling.TargetSample(df.unionByName(df.limit(50)), t)
    assert made.size == 1100
    got = Counter((r["domain"]) for r in made.rows().collect())
    assert abs(got["a"] - 330) <= 1 and abs(got["b"] - 330) <= 1 and abs(got["c"] - 434.5) <= 1 and got["d"] == 20
    assert {r["domain"] for r in made.unmet().collect()} == {"e"}
    ids = [r["id"] for r in made.rows().collect()]
    assert len(ids) == len(set(ids))
    again = {r["id"] for r in sampling.TargetSample(df, t).rows().collect()}
    assert again == set(ids)
    report = {r["domain"]: r for r in made.report().collect()}
    assert report["d"]["sampled"] == 20 and report["e"]["sampled"] == 0 and not report["e"]["met"]


def test_short_category_gives_all_it_has(spark):
    df = records(spark, ("a", "x", 100), ("b", "y", 5000))
    made = sampling.TargetSample(df, targets(spark, ("a", "x", 800, 1), ("b", "y", 200, 1)))
    got = Counter(r["domain"] for r in made.rows().collect())
    assert got["a"] == 100 and [r["domain"] for r in made.unmet().collect()] == ["a"]


def test_nulls_and_empty_tables(spark):
    df = records(spark, ("a", "x", 30)).unionByName(spark.createDataFrame([(None, "a", "choice", "x", 0, 0.0, 0.0), ("n", "a", None, "x", 0, 0.0, 0.0), ("m", "a", "choice", None, 0, 0.0, 0.0)], R))
    made = sampling.TargetSample(df, targets(spark, ("a", "x", 1000, None), ("b", "y", None, None)))
    assert made.size == 3 and made.rows().count() == 3 and made.unmet().count() == 0
    empty = sampling.TargetSample(df.limit(0), targets(spark, ("a", "x", 1000, 2)))
    assert empty.rows().count() == 0 and empty.unmet().count() == 1
    assert sampling.TargetSample(df, targets(spark).limit(0)).rows().count() == 0


@pytest.mark.parametrize("run_rows", [50_000, 7])
def test_ranks_cover_each_group_once(spark, monkeypatch, run_rows):
    monkeypatch.setattr(sampling, "RUN_ROWS", run_rows)
    df = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else f"g{i % 7}", i) for i in range(900)] + [("hot", 4), ("hot", None)], "g string, i int")
    got = sampling.ranked(df, ["g"], "i", 3)
    sizes = Counter(r["g"] for r in df.collect())
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r["g"], []).append(r["k"])
    assert {g: sorted(ks) for g, ks in ranks.items()} == {g: list(range(1, n + 1)) for g, n in sizes.items()}
    assert sampling.ranked(df.limit(0), ["g"], "i").count() == 0


D = "doc_id long, text string, source string, tokens long, copies long, rate double"
M = "source string, target_permille int, max_repeats int"


def test_mix_reaches_targets_within_repeats(spark):
    docs = [(i, "alpha beta gamma " * 5, "Big ", 0, 0, 0.0) for i in range(400)] + [(1000 + i, "alpha beta gamma " * 5, "small", 0, 0, 0.0) for i in range(50)] + [(5000, None, "small", 0, 0, 0.0), (5001, "", None, 0, 0, 0.0), (5002, "x", "unlisted", 0, 0, 0.0)]
    df = spark.createDataFrame(docs, D)
    mix = mixing.SourceMix(df, spark.createDataFrame([("big", 500, 1), ("small", 300, 3), ("gone", 10, 2), ("free", 0, None)], M), TOKENIZER)
    copies = sorted(mix.copies().collect(), key=lambda r: -r["tokens"])
    by = Counter()
    for r in copies:
        by[r["source"]] += r["copies"] * r["tokens"] / copies[0]["tokens"] if r["tokens"] else 0
    assert abs(by["big"] - 225) <= 1 and abs(by["small"] - 135) <= 2
    assert max(r["copies"] for r in copies if r["source"] == "small") <= 3 and len({r["doc_id"] for r in copies}) == len(copies)
    assert [r["source"] for r in mix.short_sources().collect()] == ["gone"]
    shares = {r["source"]: r for r in mix.shares().collect()}
    assert shares["gone"]["mixed_tokens"] == 0 and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    tight = mixing.SourceMix(df, spark.createDataFrame([("big", 100, 1), ("small", 900, 2)], M), TOKENIZER)
    assert [r["source"] for r in tight.short_sources().collect()] == ["small"]
    assert all(r["copies"] == 2 for r in tight.copies().where("source = 'small'").collect())


def test_mix_of_empty_tables(spark):
    docs = spark.createDataFrame([], D)
    t = spark.createDataFrame([("a", 1000, 1)], M)
    mix = mixing.SourceMix(docs, t, TOKENIZER)
    assert mix.copies().count() == 0 and mix.shares().first()["actual_share"] is None
    assert mixing.SourceMix(docs, t.limit(0), TOKENIZER).shares().count() == 0


def test_token_counts_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "中文" * 1000)], "i int, text string").withColumn("_text", F.lit("no"))
    got = {r["i"]: r["tokens"] for r in mixing.token_counts(df, ["i"], TOKENIZER).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 500


def test_ids_of_two_categories_count_where_they_are_placed(spark):
    df = records(spark, ("a", "x", 600), ("b", "y", 400)).unionByName(spark.createDataFrame([(f"ax{i}", "b", "choice", "y", 0, 0.0, 0.0) for i in range(300)], R))
    made = sampling.TargetSample(df, targets(spark, ("a", "x", 500, 1), ("b", "y", 500, 1)))
    assert made.size == 100 and Counter(r["domain"] for r in made.rows().collect()) == {"a": 50, "b": 50}
    scarce = records(spark, ("a", "x", 100), ("b", "y", 5)).unionByName(spark.createDataFrame([(f"ax{i}", "b", "choice", "y", 0, 0.0, 0.0) for i in range(50)], R))
    report = {r["domain"]: r for r in sampling.TargetSample(scarce, targets(spark, ("a", "x", 500, 1), ("b", "y", 500, 20))).report().collect()}
    assert report["b"]["eligible"] == 55 and report["b"]["sampled"] == 5 and not report["b"]["met"] and report["a"]["met"]


def sizes(spark, *sources):
    return spark.createDataFrame([(i * 10 + j, name, size) for j, (name, n, size) in enumerate(sources) for i in range(n)], "doc_id long, c_source string, tokens long")


def test_totals_beyond_32_bits(spark):
    df = sizes(spark, ("a", 2000, 9_000_000), ("b", 500, 40_000_000), ("c", 10, 1))
    shares = {r["source"]: r for r in mixing.SourceMix.of_sizes(df, spark.createDataFrame([("a", 300, 1), ("b", 400, 1), ("c", 300, 1000)], M)).shares().collect()}
    total = 2000 * 9_000_000 + 500 * 40_000_000 + 10
    assert abs(shares["a"]["mixed_tokens"] - 0.3 * total) <= 9_000_000 and abs(shares["b"]["mixed_tokens"] - 0.4 * total) <= 40_000_000
    assert shares["c"]["short"] and shares["c"]["mixed_tokens"] == 10_000 and not shares["a"]["short"]
    assert abs(shares["a"]["share_of_total"] - 0.3) < 0.001 and shares["a"]["actual_share"] > 0.42


def test_shares_of_unequal_documents_stay_near(spark):
    rows = [(i, "a", 1 + i * i % 4001) for i in range(3000)] + [(10_000 + i, "b", 50) for i in range(100_000)]
    df = spark.createDataFrame(rows, "doc_id long, c_source string, tokens long")
    shares = {r["source"]: r for r in mixing.SourceMix.of_sizes(df, spark.createDataFrame([("a", 100, 1), ("b", 500, 3)], M)).shares().collect()}
    assert all(abs(r["mixed_tokens"] - r["target_tokens"]) <= r["largest"] + 0.01 * r["target_tokens"] for r in shares.values())


def test_short_source_without_tokens(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 10)], "doc_id long, c_source string, tokens long")
    shares = {r["source"]: r for r in mixing.SourceMix.of_sizes(df, spark.createDataFrame([("a", 500, 3), ("b", 500, 1)], M)).shares().collect()}
    assert shares["a"]["short"] and shares["a"]["copies"] == 6 and not shares["b"]["short"]


def test_report_tells_what_the_sample_has(spark):
    df = records(spark, ("a", "x", 6000), ("b", "y", 3000), ("c", "z", 20))
    made = sampling.TargetSample(df, targets(spark, ("a", "x", 500, 1), ("b", "y", 333, 1), ("c", "z", 167, 1)))
    report = {r["domain"]: r for r in made.report().collect()}
    assert report["c"]["sampled"] == 20 and not report["c"]["met"] and report["c"]["missing"] == report["c"]["needed"] - 20
    for r in report.values():
        assert r["met"] == (r["sampled"] >= r["least_rows"]) and r["missing"] == max(0, r["needed"] - r["sampled"])
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert [r["domain"] for r in made.unmet().collect()] == ["c"]
