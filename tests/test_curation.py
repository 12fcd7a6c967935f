import io
import json
import random
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import curation as cu
from tallyforge.operators import skew
from tallyforge.operators.validate import InvalidRows
from tallyforge.plans import queries
from tallyforge.sources import adapters, jsonl


def test_unknown_is_not_refuted_and_conflicts_show(spark):
    rules = cu.rule_literal([({"a": "refuted"}, "no"), ({"a": "supported", "b": "supported"}, "yes"), ({"b": "supported"}, "maybe")])
    df = spark.createDataFrame([(1, {"a": "unknown", "b": "refuted"}), (2, {"a": "refuted", "b": "refuted"}), (3, {"a": "supported", "b": "supported"}), (4, {}), (5, None)], "i int, f map<string,string>")
    got = {r["i"]: (r["outcome"], r["target"]) for r in cu.decide(df, "f", rules).collect()}
    plain = [({"a": "refuted"}, "no"), ({"a": "supported", "b": "supported"}, "yes"), ({"b": "supported"}, "maybe")]
    assert {r["i"]: (r["outcome"], r["target"]) for r in cu.decide(df, "f", plain).collect()} == got
    assert got == {1: ("abstain", None), 2: ("decided", "no"), 3: ("conflict", None), 4: ("abstain", None), 5: ("abstain", None)}


def test_pairwise_overlap_agrees_with_enumeration(spark):
    rules = [({"a": "supported"}, "x"), ({"a": "refuted", "b": "supported"}, "y"), ({"b": "refuted"}, "y"), ({"a": "unknown"}, "x")]
    df = spark.createDataFrame([(1, i, t, w) for i, (w, t) in enumerate(rules)], "plan int, rule int, target string, `when` map<string,string>")
    overlapping = {(r["left"], r["right"]) for r in cu.overlapping_rules(df, "plan").collect()}
    assert overlapping == {(0, 2), (2, 3)}
    every = cu.decide(cu.facts_of(cu.assignments(spark, ["a", "b"]), "assignment"), "facts", cu.rule_literal(rules))
    assert every.count() == 9 and every.where("outcome = 'conflict'").count() == 2


def test_overlaps_equal_brute_force_also_in_shares(spark, monkeypatch):
    rng = random.Random(5)
    rules = [(rng.choice("pq"), i, rng.choice(["x", "y", "z", None]), rng.choice([None, {}, {a: rng.choice(["supported", "refuted"]) for a in rng.sample("abc", rng.randrange(1, 3))}])) for i in range(120)]
    clash = lambda v, w: any(v[k] != w[k] for k in set(v or {}) & set(w or {}))
    expected = sorted((p, i, j) for p, i, s, v in rules for q, j, t, w in rules if p == q and i < j and s and t and s != t and not clash(v, w))
    df = spark.createDataFrame(rules, "plan string, rule int, target string, `when` map<string,string>")
    assert sorted(map(tuple, cu.overlapping_rules(df, "plan").collect())) == expected
    monkeypatch.setattr(cu, "PAIRS", 10)
    monkeypatch.setattr(skew, "LEAST", 2)
    assert sorted(map(tuple, cu.overlapping_rules(df, "plan").collect())) == expected


def test_rules_that_never_meet_cost_no_pairs(spark):
    side = F.col("id") % 2 == 0
    df = spark.range(60_000).select(F.lit("p").alias("plan"), F.col("id").alias("rule"), F.when(side, "x").otherwise("y").alias("target"), F.create_map(F.lit("a"), F.when(side, "supported").otherwise("refuted")).alias("when"))
    began = time.monotonic()
    assert cu.overlapping_rules(df, "plan").count() == 0
    assert time.monotonic() - began < 60


def test_plan_audit_and_facts(spark):
    lit_map = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    rules = cu.rule_literal([({"a": "supported"}, "yes"), ({"a": "refuted"}, "no")])
    base, counter = {"a": "supported", "b": "unknown"}, {"a": "refuted", "b": "unknown"}
    from tallyforge.operators.validate import reasons

    plan = lambda b, c: spark.range(1).select(reasons(cu.plan_rules(F.array(F.lit("a"), F.lit("b")), rules, F.lit("a"), lit_map(b), lit_map(c))).alias("r")).first()["r"]
    assert plan(base, counter) == [] and plan(base, base) == ["focus", "only focus differs", "label changes"]
    ok = spark.range(1).select(cu.audit_passes(F.array(F.lit(True)), F.array(F.lit(1), F.lit(0)), F.array(F.lit(True), F.lit(True)), F.lit(2)).alias("a"), cu.audit_passes(F.array(F.lit(True)), F.array(F.lit(1), F.lit(1)), F.array(F.lit(True)), F.lit(2)).alias("b")).first()
    assert ok["a"] and not ok["b"]
    jobs = spark.createDataFrame([("j", "the sky is blue", ["p", "q", "r"])], "k string, context string, atoms array<string>")
    said = spark.createDataFrame([("j", "p", "supported", ["sky is"]), ("j", "q", "refuted", []), ("j", "z", "unknown", [])], "k string, atom string, state string, quotes array<string>")
    assert {(r["atom"], r["problem"]) for r in cu.assess_facts(jobs, said, "k").collect()} == {("q", "no quote"), ("r", "missing atom"), ("z", "unexpected atom")}
    bad = said.where("atom = 'p'").withColumn("quotes", F.array(F.lit("red")))
    assert ("p", "quote not in context") in {(r["atom"], r["problem"]) for r in cu.assess_facts(jobs, bad, "k").collect()}


def test_emit_rows_and_gates(spark):
    groups = spark.createDataFrame([("g", "base", "s", {"a": "supported"}), ("g", "cf", "t", {"a": "refuted"}), ("g", "no", "u", {"a": "supported"})], "k string, variant string, state string, intended map<string,string>")
    verified = spark.createDataFrame([("g", "base", "a", "supported"), ("g", "cf", "a", "supported")], "k string, variant string, atom string, state string")
    rows, issues = cu.emit_rows(groups, verified, cu.rule_literal([({"a": "supported"}, "yes")]), "k")
    assert [(r["variant"], r["target"]) for r in rows.collect()] == [("base", "yes")]
    assert {r["variant"]: r["reason"] for r in issues.collect()} == {"cf": "facts differ", "no": "not verified"}
    pairs = spark.createDataFrame([("p", "l", "supported"), ("p", "r", "refuted"), ("q", "l", "supported")], "k string, c string, s string")
    assert {r["k"]: r["passed"] for r in cu.entailment_gate(pairs, {"l": "supported", "r": "refuted"}, "k", "c", "s").collect()} == {"p": True, "q": False}
    cases = cu.blind_cases(spark.createDataFrame([("b", "yes"), ("a", "no")], "state string, target string"), "state")
    ids = {r["state"]: r["case_id"] for r in cases.collect()}
    verdicts = spark.createDataFrame([(ids["a"], "no", True), (ids["b"], "no", True)], "case_id string, target string, unambiguous boolean")
    assert {r["case_id"]: r["issue"] for r in cu.verification_issues(cases, verdicts, "target").collect()} == {ids["b"]: "disagrees"}


def test_release_audit(spark):
    cols = "id string, family string, input_sha256 string, source_id string, source_sha256 string, group_id string, variant string, state string, target string"
    rows = spark.createDataFrame([("1", "f", "h1", "s", "x", "g", "base", "a", "yes"), ("2", "f", "h2", "s", "x", "g", "cf", "b", "no")], cols)
    sources = spark.createDataFrame([("s", "f", "x")], "id string, family string, sha256 string")
    held = spark.createDataFrame([("z", "h9")], "family string, input_sha256 string")
    cu.demand_clean(cu.release_audit(rows, sources, held, ["base", "cf"]))
    tampered = rows.withColumn("source_sha256", F.lit("y"))
    with pytest.raises(InvalidRows, match="provenance"):
        cu.demand_clean(cu.release_audit(tampered, sources, held, ["base", "cf"]))
    with pytest.raises(InvalidRows, match="held-out family"):
        cu.demand_clean(cu.release_audit(rows, sources, held.withColumn("family", F.lit("f")), ["base", "cf"]))
    with pytest.raises(InvalidRows, match="groups"):
        cu.demand_clean(cu.release_audit(rows, sources, held, ["base", "cf", "removed"]))


def raw(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def made(name, df):
    return {r["id"]: r for r in adapters.REGISTRY[name].record(df).collect()}


def test_each_adapter(spark):
    assert len(adapters.REGISTRY) == 11
    r = made("vitaminc", raw(spark, "unique_id string, case_id string, label string, claim string, evidence string", ("u", "c", "REFUTES", "x", "y"), ("v", "c", "OTHER", "x", "y")))
    assert r["vitaminc-u"]["target"] == '"REFUTES"' and r["vitaminc-u"]["family"] == "c" and r["vitaminc-v"]["status"] == "raise"
    r = made("massive", raw(spark, "id long, locale string, partition string, scenario string, intent string, utt string", (1, "de-DE", "test", "alarm", "set", "weck"), (2, "de-DE", "train", "alarm", "set", "x")))
    assert r["massive-de-DE-1"]["target"] == '"alarm"' and r["massive-de-DE-2"]["status"] == "skip"
    r = made("boolq", raw(spark, "question string, passage string, answer boolean", ("q", "p", True)))
    assert next(iter(r.values()))["target"] == "true"
    flat = raw(spark, "id string, title string, context string, question string, answers struct<text:array<string>,answer_start:array<int>>, is_impossible boolean", ("a", "t", "c", "q", (["x"], [0]), False), ("b", "t", "c", "q", ([], []), True), ("d", "t", "c", "q", ([], []), False))
    r = made("squad2", flat)
    assert (r["squad2-a"]["target"], r["squad2-b"]["target"], r["squad2-d"]["status"]) == ("true", "false", "skip")
    r = made("paws", raw(spark, "id string, sentence1 string, sentence2 string, label int", ("1", "a", "b", 1), ("2", "a", "b", 7)))
    assert r["paws-1"]["target"] == "true" and r["paws-2"]["status"] == "raise"
    r = made("multinli", raw(spark, "pairID string, promptID string, sentence1 string, sentence2 string, gold_label string, annotator_labels array<string>", ("1", "p", "a", "b", "entailment", ["entailment"] * 4 + ["neutral"]), ("2", "p", "a", "b", "-", ["neutral"]), ("3", "p", "a", "b", "neutral", ["entailment", "entailment", "neutral"])))
    assert r["multinli-1"]["distribution"] == {"entailment": 0.8, "neutral": 0.2, "contradiction": 0.0} and r["multinli-2"]["status"] == "skip" and r["multinli-3"]["status"] == "raise"
    r = made("civil_comments", raw(spark, "text string, toxicity double, row_index long", ("x", 0.5, 0), ("y", 2.0, 1)))
    assert r["civil_comments-0"]["target"] == "true" and r["civil_comments-0"]["distribution"] == {"false": 0.5, "true": 0.5} and r["civil_comments-1"]["status"] == "raise"
    cols = "id string, prompt string, response string, prompt_label string, response_label string, violated_categories string, prompt_label_source string, response_label_source string, reconstruction_id_if_redacted string"
    df = raw(spark, cols, ("1", "p", None, "unsafe", None, "A, ,B", "human", None, None), ("2", "p", "r", "safe", "safe", "", "human", "llm", None), ("3", "p", None, "safe", None, None, "human", None, "red"))
    r = made("aegis2", df)
    assert r["aegis2-1"]["target"] == "true" and r["aegis2-2"]["status"] == "skip" and r["aegis2-3"]["status"] == "skip"
    assert [x["category"] for x in adapters.aegis2_categories(df).collect()] == ["A", "B"]
    r = made("helpsteer2", raw(spark, "prompt string, response string, helpfulness int, row_index long", ("p", "r", 3, 0)))
    assert r["helpsteer2-0"]["target"] == "3"
    r = made("summeval", raw(spark, "id string, text string, machine_summaries array<string>, relevance array<double>", ("d", "t", ["a", "b"], [4.67, 2.5])))
    assert (r["summeval-d-0"]["target"], r["summeval-d-1"]["target"]) == ("4", "2")
    with pytest.raises(Exception, match="differ in number"):
        adapters.summeval_rows(raw(spark, "id string, text string, machine_summaries array<string>, relevance array<double>", ("d", "t", ["a"], [1.0, 2.0]))).collect()
    r = made("pubmedqa", raw(spark, "pubid int, question string, context struct<contexts:array<string>>, long_answer string, final_decision string", (1, "q", (["c"],), "l", "Yes")))
    assert r["pubmedqa-1"]["target"] == '"yes"'
    with pytest.raises(Exception, match="paws"):
        adapters.convert("paws", raw(spark, "id string, sentence1 string, sentence2 string, label int", ("2", "a", "b", 7))).collect()
    with pytest.raises(ValueError):
        adapters.register(adapters.REGISTRY["paws"])


def test_files(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    sep = " "
    (tmp_path / "log.jsonl").write_bytes(("﻿" + json.dumps({"id": "a", "v": 1}) + "\r\n\n{bad\n" + json.dumps({"id": f"b{sep}c", "v": 2}, ensure_ascii=False) + "\n" + '{"id": "torn').encode())
    schema = jsonl.T.StructType.fromDDL("id string, v int")
    rows, rejects = jsonl.read_with_rejects(spark, path, schema)
    assert [(r["line"], r["id"]) for r in rows.orderBy("line").collect()] == [(1, "a"), (4, f"b{sep}c")]
    assert [r["line"] for r in rejects.orderBy("line").collect()] == [3, 5]
    with pytest.raises(InvalidRows, match=":3"):
        jsonl.read_progress(spark, path, schema)
    whole = tmp_path / "torn.jsonl"
    whole.write_text('{"id": "a", "v": 1}\n{"id": "b"', encoding="utf-8")
    assert jsonl.read_progress(spark, str(whole), schema).count() == 1
    three = tmp_path / "three.jsonl"
    three.write_text("".join(json.dumps({"id": str(i), "v": i}) + "\n\n" for i in range(5)), encoding="utf-8")
    assert [r["id"] for r in jsonl.read_range(spark, str(three), schema, 1, 2).collect()] == ["1", "2"]
    assert jsonl.read_unique(spark, str(three), schema).count() == 5
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"x{sep}\u0085", None)], "id string, v int")
    jsonl.write_jsonl(df, out)
    assert "\\u2028" in "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) and jsonl.read_jsonl(spark, out, schema).first()["id"] == f"x{sep}\u0085"
    with pytest.raises(Exception, match="(?i)exist"):
        jsonl.write_jsonl(df, out)
    table = str(tmp_path / "table")
    assert jsonl.write_once(df, table) and not jsonl.write_once(df, table)
    with pytest.raises(InvalidRows, match="other rows"):
        jsonl.write_once(df.withColumn("v", F.lit(1)), table)
    meta, rest = jsonl.split_header(spark.createDataFrame([("meta", 1), (None, 2), (None, 3)], "__type__ string, k int"))
    assert meta["k"] == 1 and rest.count() == 2
    jsonl.atomic_json(spark, str(tmp_path / "m.json"), jsonl.manifest(spark.createDataFrame([("a", "x"), ("b", "x")], "id string, domain string"), seed=1))
    m = json.loads((tmp_path / "m.json").read_text())
    assert m["count"] == 2 and m["domain"] == {"x": 2} and json.loads(jsonl.manifest_text(m)) == m
    assert "| a | 1 |" in jsonl.report(spark.createDataFrame([("a", 1)], "k string, n int"), "T", ["k"])
    jsonl.atomic_json(spark, str(tmp_path / "m.json"), {"count": 3})
    assert json.loads((tmp_path / "m.json").read_text()) == {"count": 3} and not list(tmp_path.glob("*.partial"))
    ids = spark.range(20).select(F.col("id").cast("string").alias("id"))
    with pytest.raises(InvalidRows, match="ids_path"):
        jsonl.manifest(ids, most=5)
    large = jsonl.manifest(ids, most=5, ids_path=str(tmp_path / "ids"))
    assert "ids" not in large and spark.read.parquet(large["ids_table"]).count() == 20 == large["count"]
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        data = b'{"id": "1", "v": 1}\n\n{"id": "2", "v": 2}\n'
        info = tarfile.TarInfo("top/data/de-DE.jsonl")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert adapters.read_tar_member(spark, str(tmp_path / "x.tar.gz"), "/data/de-DE.jsonl", schema).count() == 2
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert adapters.read_csv(spark, str(tmp_path / "c.csv")).first().asDict() == {"a": "1", "b": "x"}
    indexed = adapters.with_row_index(spark.range(1000).select(F.col("id").alias("k")), "k")
    assert indexed.where("k <> row_index").count() == 0


def test_cache(spark):
    sha = lambda x: F.sha2(F.lit(x), 256)
    requests = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "request_sha256 string")
    cache = spark.createDataFrame([("k1", "r")], "request_sha256 string, response string").withColumn("response_sha256", sha("r"))
    rejected = spark.createDataFrame([("k2",)], "request_sha256 string")
    hits, pending = adapters.cached_responses(requests, cache, rejected)
    assert hits.count() == 1 and [r[0] for r in pending.collect()] == ["k3"]
    with pytest.raises(Exception, match="digest"):
        adapters.cached_responses(requests, cache.withColumn("response_sha256", F.lit("0")), rejected)[0].collect()


def test_manifest_of_a_large_subset_names_its_ids_and_lists_them(spark, tmp_path):
    segment = F.when(F.col("id") < 120_000, "BUILDING").otherwise("OTHER")
    spark.range(120_010).select((120_010 - F.col("id")).alias("c_custkey"), segment.alias("c_mktsegment"), (F.col("id") % 3).cast("int").alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    row = queries.queries()["subset_manifest"](spark, str(tmp_path)).first()
    assert (row["rows"], row["domains"], row["read_back"]) == (120_000, 3, True) and row["ids"] == ",".join(map(str, range(11, 120_011)))
