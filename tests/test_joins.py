import random
import re
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import joins, selection, sets, windows
from tallyforge.operators import validate as va
from tallyforge.operators.validate import InvalidRows
from tallyforge.plans import oracles, queries


def tokens(t):
    return frozenset(re.findall(r"\w+", t.lower()))


def test_jaccard_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(6)) for _ in range(12)) for _ in range(25)]
    texts = base + [" ".join(b.split()[:-1] + ["new"]) for b in base] + base[:5] + ["", None, "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("side", F.lit(1)).withColumn("a", F.lit(2))
    sets_ = {i: tokens(t) for i, t in enumerate(texts) if t and tokens(t)}
    first = {}
    for i, s in sets_.items():
        first.setdefault(s, i)
    reps = sorted(first.values())
    expected = {(a, b) for a in reps for b in reps if a < b and len(sets_[a] & sets_[b]) >= 0.8 * len(sets_[a] | sets_[b])} | {(first[s], i) for i, s in sets_.items() if first[s] < i}
    assert {(r["a"], r["b"]) for r in joins.jaccard_pairs(df, "k", "t").collect()} == expected
    prior = df.where("k < 25")
    got = {(r["a"], r["b"]) for r in joins.jaccard_pairs(df.where("k >= 25"), "k", "t", prior=prior).collect()}
    assert got == {(a, b) for a in reps if a < 25 for b in sorted({min(i for i in sets_ if sets_[i] == sets_[j] and i >= 25) for j in sets_ if j >= 25}) if len(sets_[a] & sets_[b]) >= 0.8 * len(sets_[a] | sets_[b])}


def test_jaccard_pairs_of_common_words_drop_what_is_apart_before_the_shuffle(spark, monkeypatch):
    rng = random.Random(11)
    sets_ = [set(rng.sample(range(160), 40)) for _ in range(300)]
    sets_ += [(s - set(rng.sample(sorted(s), 3))) | {500 + i} for i, s in enumerate(sets_[:20])]
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in s)) for i, s in enumerate(sets_)], "k int, t string")
    counts = {}
    write = joins.stage

    def kept(frame, label="stage", *more):
        made = write(frame, label, *more)
        counts[label] = made.count()
        return made

    monkeypatch.setattr(joins, "stage", kept)
    expected = {(a, b) for b in range(len(sets_)) for a in range(b) if len(sets_[a] & sets_[b]) >= 0.8 * len(sets_[a] | sets_[b])}
    for common in (joins.COMMON, 7):
        monkeypatch.setattr(joins, "COMMON", common)
        assert {(r["a"], r["b"]) for r in joins.jaccard_pairs(df, "k", "t").collect()} == expected and len(expected) >= 20
        assert len(expected) <= counts.pop("candidates") < 400


def test_similar_documents_pairs_every_copy(spark, tmp_path, monkeypatch):
    rng = random.Random(29)
    base = [[f"w{x}" for x in rng.sample(range(300), 20)] for _ in range(12)]
    texts = [" ".join(b) for b in base for _ in range(4)] + [" ".join(reversed(b)).upper() for b in base[:6]]
    texts += [" ".join([*b[1:], "new"]) for b in base for _ in range(3)] + ["solo", None, "", "..."]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, i % 3 > 0) for i, t in enumerate(texts)], "doc_id long, text string, later boolean")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    sets_ = {i: tokens(t) for i, t in enumerate(texts) if t and tokens(t)}
    alike = {(a, b): round(len(sets_[a] & sets_[b]) / len(sets_[a] | sets_[b]), 9) for a in sets_ for b in sets_}
    alike = {p: x for p, x in alike.items() if x >= 0.8}
    split = lambda rows: sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in rows)
    query = queries.queries()["similar_documents"]
    for shared in (joins.SHARED, 1):  # at 1, all classes are joined in shares
        monkeypatch.setattr(joins, "SHARED", shared)
        assert split(query(spark, str(tmp_path)).collect()) == sorted((a, b, x) for (a, b), x in alike.items() if a < b)
        got = joins.jaccard_pairs(df.where("later"), "doc_id", "text", prior=df.where("not later"), copies=True).collect()
        assert split(got) == sorted((a, b, x) for (a, b), x in alike.items() if a % 3 == 0 and b % 3 > 0)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(oracles.oracle_sql()["similar_documents"]).fetchall()) == sorted((a, b, x) for (a, b), x in alike.items() if a < b)


def test_similar_documents_have_the_words_of_their_sql(spark, tmp_path):
    texts = ["cafe\u0301 a b", "cafe\u0300 a b", "c\u203fd e f", "c d e f", "g\u0130h i", "gih i", "\u039f\u0394\u039f\u03a3 j", "\u03bf\u03b4\u03bf\u03c3 j", "k\u00b2 l", "k l", "\u00bd m n o p", "m n o p", "\u0928\u092e\u0938\u094d\u200d\u0924\u0947 q", "\u0928\u092e\u0938\u094d \u0924\u0947 q"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["a"], r["b"], r["similarity"]) for r in queries.queries()["similar_documents"](spark, str(tmp_path)).collect())
    assert got == [(0, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0), (6, 7, 1.0), (10, 11, 0.8), (12, 13, 1.0)]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(oracles.oracle_sql()["similar_documents"]).fetchall()) == got


def test_longest_match_and_blocks(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "say abc and abcd"), (2, "nothing"), (3, None), (4, "xy zz")], "k int, t string")
    needles = spark.createDataFrame([(10, "abc"), (11, "abcd"), (9, "zz"), (8, "xy"), (7, None), (6, "")], "i int, n string")
    expected = {1: (11, 4), 4: (8, 2)}
    read = lambda: {r["key"]: (r["needle_id"], r["length"]) for r in joins.longest_match(texts, "t", needles, "n", "i", "k").collect()}
    assert read() == expected
    monkeypatch.setattr(joins, "NEEDLE_BYTES", 3)
    assert read() == expected
    assert joins.longest_match(texts, "t", needles.limit(0), "n", "i", "k").count() == 0


def test_asof_equals_brute_force(spark):
    rng = random.Random(5)
    start = datetime(2026, 1, 1)
    moment = lambda: start + timedelta(minutes=rng.randrange(0, 60 * 24 * 6, 30))
    calls = [(i, rng.choice("uv"), moment()) for i in range(120)]
    questions = [(100 + i, rng.choice("uv"), moment()) for i in range(40)]
    c = spark.createDataFrame(calls, "id int, u string, ts timestamp_ntz")
    q = spark.createDataFrame(questions, "q int, u string, at timestamp_ntz")

    def best(ts, user=None):
        near = [(t, -i) for i, u, t in questions if t <= ts and user in (None, u)]
        return -max(near)[1] if near else None

    got = {r["id"]: r["matched_q"] for r in joins.asof(c, q, "ts", "at", ["q"], ["u"], "q").collect()}
    assert got == {i: best(t, u) for i, u, t in calls}
    got = {r["id"]: r["matched_q"] for r in joins.asof(c, q.drop("u"), "ts", "at", ["q"], tie="q").collect()}
    assert got == {i: best(t) for i, u, t in calls}


def test_cascade(spark):
    calls = spark.createDataFrame([(1, "x How many CELLS?", "2026-01-01 10:00:00"), (2, "x how—many cells", "2026-01-01 10:00:00"), (3, "other", "2026-01-01 10:00:00"), (4, "other", "2025-01-01 10:00:00")], "k int, t string, s string").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    questions = spark.createDataFrame([(7, "How many CELLS?", "2026-01-01 09:00:00"), (8, "zzzzzzzz", "2026-01-01 09:30:00")], "q int, n string, s string").withColumn("at", F.col("s").cast("timestamp_ntz"))
    got = {r["k"]: (r["q"], r["method"]) for r in joins.cascade(calls, questions, "k", "t", "n", "q", "ts", "at").collect()}
    assert got == {1: (7, "raw"), 2: (7, "normalised"), 3: (8, "as-of"), 4: (None, "unmatched")}


def test_guards(spark):
    rows = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "id int, family string")
    with pytest.raises(InvalidRows, match="part of a family"):
        joins.select_ids(rows, rows.where("id = 1"), "id", "family")
    with pytest.raises(InvalidRows, match="without a record"):
        joins.select_ids(rows, spark.createDataFrame([(9,)], "id int"))
    assert joins.select_ids(rows, rows.where("family = 'f'"), "id", "family").count() == 2
    with pytest.raises(InvalidRows, match="repeated key"):
        va.demand_unique(rows.union(rows), "id")
    with pytest.raises(InvalidRows, match="no rows"):
        va.demand_unique(rows.limit(0), "id")
    with pytest.raises(InvalidRows, match="do not cover"):
        joins.exact_cover({"a": rows, "b": rows.where("id < 3")}, "id", ["family"])
    with pytest.raises(InvalidRows, match="do not cover"):
        joins.exact_cover({"a": rows, "b": rows.withColumn("family", F.lit("z"))}, "id", ["family"])
    gold = spark.createDataFrame([(1, "x"), (1, "y")], "id int, g string")
    with pytest.raises(InvalidRows, match="repeated gold"):
        joins.with_gold(rows, gold, "id", "g")
    with pytest.raises(InvalidRows, match="vocabulary"):
        joins.with_gold(rows, gold.limit(1), "id", "g", spark.createDataFrame([("q",)], "g string"))
    with pytest.raises(InvalidRows, match="keys differ"):
        joins.positional(spark.createDataFrame([(0, 1)], "i int, k int"), spark.createDataFrame([(0, 2)], "i int, k int"), "i", "k")
    with pytest.raises(InvalidRows, match="both sides"):
        sets.demand_separate(rows.where("id = 1"), rows.where("id = 2"), ["id", "family"])
    sets.demand_separate(rows.where("id = 1"), rows.where("id = 3"), ["id", "family"])
    with pytest.raises(Exception, match="rule broken: positive"):
        va.demand(rows, {"positive": F.col("id") > 1}).collect()
    with pytest.raises(InvalidRows, match="settings differ"):
        va.check_settings({"a": 1}, {"a": 2}, ["a"])
    assert joins.same_rows(rows, rows).count() == 0 and joins.same_rows(rows, rows.where("id < 3")).count() == 1


def test_teacher_and_record_rules(spark):
    ok = lambda rules: spark.range(1).select(va.reasons(rules).alias("r")).first()["r"]
    labels = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    p = lambda *xs: F.array(*map(F.lit, xs))
    assert ok(va.teacher_rules(labels, p(0.33, 0.33, 0.33), labels, F.lit(0.99), F.lit(0.5))) == []
    assert ok(va.teacher_rules(labels, p(0.333, 0.333, 0.33), labels, F.lit(None).cast("double"), F.lit(2.0))) == ["sum", "confidence"]
    rules = va.record_rules(F.lit("choice"), F.lit('{"a": "x", "b": "y"}'), F.lit('"c"'), F.create_map(F.lit("a"), F.lit(0.5)))
    assert ok(rules) == ["target", "distribution keys", "distribution sum"]
    assert ok(va.quote_rules(F.array(F.lit("ab"), F.lit("zz")), F.lit("abc"))) == ["literal"]
    code = "text\n```python\n" + "\n".join(f"x = {i}" for i in range(7)) + "\n```"
    r = spark.range(1).select(va.code_block(F.lit(code)).isNotNull().alias("a"), va.code_block(F.lit(code * 2)).isNotNull().alias("b")).first()
    assert r["a"] and not r["b"]


def test_windows(spark):
    df = spark.createDataFrame([(1, "q", "s", 10), (2, "q", "s", 30), (3, None, "s", 5), (4, None, "s", 7)], "id int, q string, st string, t int").withColumn("ts", F.timestamp_seconds(F.col("t") * 50_000))
    assert {r["id"]: r["role"] for r in windows.call_roles(df.where("q is not null"), "q", "ts", "id").collect()} == {1: "exec #1", 2: "summary"}
    assert {r["id"]: (r["q"], r["occurrence"]) for r in windows.occurrences(df, "q", "st", "ts", "id").collect()} == {1: ("q", 1), 2: ("q", 2), 3: ("UNMATCHED", 1), 4: ("UNMATCHED", 2)}
    chunks = spark.createDataFrame([("r", 10.0), ("r", 30.0), ("r", 60.0), ("s", 5.0)], "r string, a double")
    assert [x["latency"] for x in windows.inter_arrival(chunks.where("r = 'r'"), "r", "a", "a").orderBy("a").collect()] == [10, 20, 30]
    got = {x["r"]: (x["ttft"], x["mean_interval"]) for x in windows.output_intervals(chunks, "r", "a").collect()}
    assert got == {"r": (10, 25), "s": (5, None)}


def test_label_blind_selection(spark):
    rng = random.Random(2)
    rows = [(i, f"f{rng.randrange(30)}", rng.choice("xyz"), rng.choice("ab")) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, family string, domain string, label string")
    other = df.withColumn("label", F.lit("q"))
    for sample in (lambda d: selection.family_sample(d, "family", "domain", 60, 4), lambda d: selection.stratified_sample(d, "domain", "family", "id", 10, 4), lambda d: selection.simple_sample(d, "id", 20, 4)):
        one, two = ({r["id"] for r in sample(d).collect()} for d in (df, other))
        assert one == two and one
    chosen = selection.family_sample(df, "family", "domain", 60, 4)
    assert chosen.count() <= 60
    picked = [r["family"] for r in chosen.select("family").distinct().collect()]
    assert chosen.count() == df.where(F.col("family").isin(picked)).count()
    assert selection.family_sample(df, "family", "domain", 0, 4).count() == 0


def brute_subset(families, count, seed):
    import hashlib
    from itertools import combinations

    names = sorted(families, key=lambda f: hashlib.sha256(f"{seed}:{f}".encode()).hexdigest())
    best = None
    for r in range(1, len(names) + 1):
        for chosen in combinations(range(len(names)), r):
            of = [families[names[i]] for i in chosen]
            if sum(sum(k.values()) for _, k in of) == count:
                totals = [sum(k.get(t, 0) for _, k in of) for t in ("choice", "noul", "score")]
                key = (-len({d for d, _ in of}), sum((3 * n - count) ** 2 for n in totals), chosen)
                best = min(best or key, key)
    return None if best is None else sorted(names[i] for i in best[2])


def test_exact_subset_equals_all_subsets(spark):
    for seed in range(25):
        rng = random.Random(seed)
        families = {f"f{i}": (rng.choice("uvwx"), {"choice": rng.randrange(4), "noul": rng.randrange(4), "score": rng.randrange(1, 4)}) for i in range(rng.randrange(1, 11))}
        for count in (1, 5, 12, 20):
            expected = brute_subset(families, count, seed)
            if expected is None:
                with pytest.raises(ValueError):
                    selection.exact_subset(families, count, seed)
            else:
                assert selection.exact_subset(families, count, seed) == expected
    many = {f"f{i:02}": (f"d{i % 9}", {"choice": i % 3, "noul": 1 + i % 2, "score": i % 4}) for i in range(48)}
    chosen = selection.exact_subset(many, 60, 1)
    assert sum(sum(many[f][1].values()) for f in chosen) == 60 and len({many[f][0] for f in chosen}) == 9
    df = spark.createDataFrame([("a", "x", "choice"), ("a", "x", "noul"), ("b", "y", "score"), ("c", "y", "other"), (None, "y", "noul")], "f string, d string, k string")
    assert {r["f"] for r in selection.exact_family_split(df, "f", "d", "k", 3, 1).collect()} in ({"a", "b"}, {"a", "c"})
    with pytest.raises(ValueError):
        selection.exact_family_split(df, "f", "d", "k", 3, 1, most=2)


def test_one_hot_group_meets_in_no_task(spark):
    from tallyforge.operators import ordered

    df = spark.range(8000).select(F.when(F.col("id") < 6000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id", (F.col("id") % 3 == 0).alias("y"))
    got = ordered.numbered(df, ["k"], ["id"], "n")
    expected = df.toPandas().groupby("k").cumcount() + 1
    assert dict(zip(df.toPandas()["id"], expected)) == {r["id"]: r["n"] for r in got.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shares = [r["count"] for r in ordered.spans(df, ["k"], ["id"]).groupBy(ordered.SPAN).count().collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(shares) < 0.3 * sum(shares)
    sums = ordered.running(df, ["k"], ["id"], {"s": F.col("y").cast("int")}, inclusive=False).where("k = 'hot'").orderBy("id").collect()
    assert [r["s"] for r in sums] == [(i + 2) // 3 for i in range(6000)]


def test_asof_without_times_and_with_maps(spark):
    calls = spark.createDataFrame([(1, None, {"a": 1}), (2, 5, {}), (3, 0, None)], "id int, t int, m map<string,int>")
    questions = spark.createDataFrame([(9, 1), (8, None), (7, 4), (6, 4)], "q int, at int")
    assert {r["id"]: r["matched_q"] for r in joins.asof(calls, questions, "t", "at", ["q"], tie="q").collect()} == {1: None, 2: 6, 3: None}
