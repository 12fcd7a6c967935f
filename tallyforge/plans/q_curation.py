"""Rules, contrast groups, audits and converted sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import curation as cu
from tallyforge.plans.catalog import query
from tallyforge.sources import adapters

_RULES = [({"late": "supported", "cheap": "refuted"}, "escalate"), ({"late": "refuted"}, "close"), ({"taxed": "unknown"}, "ask"), ({"late": "supported", "taxed": "supported"}, "escalate")]


def _facts(t):
    state = lambda c: F.when(c, "supported").when(~c, "refuted").otherwise("unknown")
    facts = F.create_map(F.lit("late"), state(F.col("l_returnflag") == "R"), F.lit("cheap"), state(F.col("l_extendedprice") < 20000), F.lit("taxed"), state(F.when(F.col("l_tax") != 0.04, F.col("l_tax") > 0.04)))
    return t.lineitem.select("l_orderkey", "l_linenumber", facts.alias("facts"))


@query(
    """WITH f AS (SELECT l_returnflag = 'R' late, l_extendedprice < 20000 cheap, CASE WHEN l_tax <> 0.04 THEN l_tax > 0.04 END taxed FROM lineitem),
    d AS (SELECT list_distinct(list_filter([CASE WHEN late AND NOT cheap THEN 'escalate' END, CASE WHEN NOT late THEN 'close' END, CASE WHEN taxed IS NULL THEN 'ask' END, CASE WHEN late AND taxed THEN 'escalate' END], lambda x: x IS NOT NULL)) t FROM f)
    SELECT CASE len(t) WHEN 0 THEN 'abstain' WHEN 1 THEN 'decided' ELSE 'conflict' END AS outcome, CASE WHEN len(t) = 1 THEN t[1] END AS target, count(*) AS n FROM d GROUP BY ALL"""
)
def rule_decisions(t):
    return cu.decide(_facts(t), "facts", _RULES).groupBy("outcome", "target").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT unnest(['supported', 'refuted', 'unknown']) s), a AS (SELECT l.s late, c.s cheap, t.s taxed FROM s l, s c, s t),
    d AS (SELECT list_distinct(list_filter([CASE WHEN late = 'supported' AND cheap = 'refuted' THEN 'escalate' END, CASE WHEN late = 'refuted' THEN 'close' END, CASE WHEN taxed = 'unknown' THEN 'ask' END, CASE WHEN late = 'supported' AND taxed = 'supported' THEN 'escalate' END], lambda x: x IS NOT NULL)) t FROM a)
    SELECT CASE len(t) WHEN 0 THEN 'abstain' WHEN 1 THEN 'decided' ELSE 'conflict' END AS outcome, count(*) AS n FROM d GROUP BY ALL"""
)
def rule_enumeration(t):
    every = cu.facts_of(cu.assignments(t.spark, ["late", "cheap", "taxed"]), "assignment")
    return cu.decide(every, "facts", cu.rule_literal(_RULES)).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT p_brand, p_partkey, p_type, p_size > 25 AS big, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice > 1000 END AS dear, split_part(p_name, ' ', 1) AS target FROM part)
    SELECT a.p_brand, a.p_partkey AS "left", b.p_partkey AS "right" FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.target <> b.target AND a.big = b.big AND coalesce(a.dear = b.dear, true)"""
)
def rule_overlaps(t):
    """Parts as rules of their brand's plan: a size asked for, for every second one a price, and its type; the pairs of different targets that some facts satisfy both."""
    state = lambda c: F.when(c, "supported").otherwise("refuted")
    when = F.map_concat(F.create_map(F.lit("big"), state(F.col("p_size") > 25), F.col("p_type"), F.lit("supported")), F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("dear"), state(F.col("p_retailprice") > 1000))).otherwise(F.create_map().cast("map<string,string>")))
    rules = t.part.select("p_brand", F.col("p_partkey").alias("rule"), F.split("p_name", " ")[0].alias("target"), when.alias("when"))
    return cu.overlapping_rules(rules, "p_brand")


@query(
    """WITH o AS (SELECT o_orderkey, 'Order ' || o_orderkey || ' was paid.' AS s FROM orders), v AS (SELECT o_orderkey, s, unnest(['base', 'removed', 'counterfactual', 'paraphrase', 'distractor']) AS variant FROM o)
    SELECT o_orderkey, variant, CASE variant WHEN 'base' THEN s WHEN 'removed' THEN replace(s, 'was paid', '') WHEN 'counterfactual' THEN replace(s, 'was paid', 'was not paid') WHEN 'paraphrase' THEN replace(s, 'was paid', 'has been settled') ELSE s || chr(10) || chr(10) || 'It rained.' END AS state,
    CASE WHEN variant = 'removed' THEN 'none' WHEN variant = 'counterfactual' THEN 'no' ELSE 'yes' END AS target FROM v"""
)
def contrast_variants(t):
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" was paid."))
    jobs = t.orders.select("o_orderkey", text.alias("state"), F.lit("was paid").alias("evidence"), F.lit("was not paid").alias("counter_evidence"), F.lit("has been settled").alias("paraphrase"), F.lit("It rained.").alias("distractor"), F.lit("yes").alias("target"), F.lit("no").alias("counter_target"), F.lit("none").alias("missing_target"))
    return cu.contrast_groups(jobs, "o_orderkey")


@query("SELECT l_orderkey, CASE WHEN n <> 2 THEN 'variants' END AS problem FROM (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) WHERE n <> 2")
def incomplete_groups(t):
    rows = t.lineitem.select("l_orderkey", F.lit("line").alias("variant"), F.monotonically_increasing_id().alias("state"), F.lit("x").alias("target"))
    return cu.group_problems(rows, "l_orderkey", ["line", "line"]).where("problem = 'variants'")


def _counted(audit):
    out = None
    for name, violations in audit.items():
        part = violations.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH r AS (SELECT record_no, id, family, sha256(input.state) AS h, reference.target AS target, lower(trim(split)) AS split FROM decision_records), held AS (SELECT family, h FROM r WHERE split IN ('validation', 'eval', 'test')), train AS (SELECT * FROM r WHERE split = 'train'),
    s AS (SELECT id, family, h FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_no) = 1), g AS (SELECT family, count(*) n, count(DISTINCT h) states, count(DISTINCT target) labels FROM r WHERE family IS NOT NULL GROUP BY family)
    SELECT 'repeated id' AS violation, count(*) AS n FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'repeated input', count(*) FROM (SELECT h FROM r GROUP BY h HAVING count(*) > 1)
    UNION ALL SELECT 'provenance', coalesce(sum(CASE WHEN s.id IS NULL THEN 1 ELSE (r.h IS DISTINCT FROM s.h)::INT + (r.family IS DISTINCT FROM s.family)::INT END), 0)::BIGINT FROM r LEFT JOIN s ON r.id = s.id
    UNION ALL SELECT 'held-out family', count(*) FROM train WHERE family IN (SELECT family FROM held) UNION ALL SELECT 'held-out input', count(*) FROM train WHERE h IN (SELECT h FROM held)
    UNION ALL SELECT 'groups', coalesce(sum((n <> 1)::INT + (states < n)::INT + (labels < 2)::INT), 0)::BIGINT FROM g"""
)
def release_audit_counts(t):
    """All checks of the audit.  Held out are validation, eval and test; a record's source is the first record of its id; each family is a group that should hold one base record and, as every group, two labels."""
    sha = F.sha2("input.state", 256)
    rows = t.decision_records.select("record_no", "id", "family", sha.alias("input_sha256"), F.lower(F.trim("split")).alias("split"), F.col("id").alias("source_id"), sha.alias("source_sha256"), F.col("family").alias("group_id"), F.lit("base").alias("variant"), sha.alias("state"), F.col("reference.target").alias("target"))
    sources = rows.groupBy("id").agg(F.min(F.struct("record_no", "family", F.col("input_sha256").alias("sha256"))).alias("s")).select("id", "s.family", "s.sha256")
    held_out = rows.where(F.col("split").isin("validation", "eval", "test")).select("family", "input_sha256")
    audit = cu.release_audit(rows, sources, held_out, ["base"])
    train = cu.release_audit(rows.where("split = 'train'"), sources, held_out, ["base"])
    return _counted(audit | {name: train[name] for name in ("held-out family", "held-out input")})


@query("SELECT user_id, n AS attempts FROM (SELECT user_id, count(*) n, count(*) FILTER (event_type = 'signup' AND event_id % 40 = user_id % 40) a FROM events GROUP BY 1) WHERE n >= 2 AND a = 0 AND 10 - user_id % 6 >= 7")
def refinable_sources(t):
    """Users as sources, events as attempts; some of their quota is made already."""
    accepted = (F.col("event_type") == "signup") & (F.col("event_id") % 40 == F.col("user_id") % 40)
    rows = t.events.withColumns({"accepted": accepted, "quota": F.lit(10), "made": (F.col("user_id") % 6).cast("int")})
    return cu.refinable(rows, "user_id", "accepted", "quota", "made").select("user_id", "attempts")


@query("SELECT i AS ordinal, ['a', 'b', 'c'][i // 6 + 1] AS subject, i % 6 AS slot, ['text', 'object'][(i // 6 + i % 6) % 2 + 1] AS format, ['choice', 'noul', 'score'][i % 6 % 3 + 1] AS kind FROM range(18) t(i)")
def coverage_plan(t):
    return cu.coverage_plan(t.spark, ["a", "b", "c"], ["text", "object"], ["choice", "noul", "score"], 6, 1).drop("held_out")


@query("SELECT id, 3::INT AS messages, input.state || chr(10) || chr(10) || input.questions['decision'].instructions || chr(10) || chr(10) || input.questions['decision'].criteria AS user, reference.target AS answer FROM decision_records WHERE input.state IS NOT NULL")
def training_messages(t):
    rows = cu.training_messages(t.decision_records.where("input.state is not null"), "Judge the case.")
    return rows.select("id", F.size("messages").alias("messages"), F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("answer"))


@query("SELECT input.state AS state, input.questions['decision'].type AS type, reference.target AS label, id, family FROM decision_records")
def suite_records(t):
    rows = cu.suite_record(t.decision_records, "own")
    return rows.select("state", F.col("questions")["decision"]["type"].alias("type"), F.col("questions")["decision"]["label"].alias("label"), "_meta.id", "_meta.family")


@query("SELECT place, n_name, n_regionkey FROM (SELECT row_number() OVER (ORDER BY sha256('{\"n_name\":\"' || n_name || '\"}')) AS place, n_name, n_regionkey FROM nation)")
def worksheet_with_key(t):
    sheet, key = cu.worksheet_and_key(t.nation, ["n_name"], ["n_regionkey"], "n_name")
    return sheet.join(key, "place")


@query("SELECT 'paws-' || l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber % 2 = 1 THEN 'true' ELSE 'false' END AS target FROM lineitem")
def converted_pairs(t):
    """Rows of the paws layout through its adapter."""
    raw = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("a").alias("sentence1"), F.lit("b").alias("sentence2"), (F.col("l_linenumber") % 2).cast("int").alias("label"))
    return adapters.accepted(adapters.convert("paws", raw)).select("id", "target")


@query(
    """WITH v AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)
    SELECT CASE WHEN b > 0 AND b >= greatest(a, c) THEN 'ok' WHEN l_orderkey % 2 = 0 THEN 'skip' ELSE 'raise' END AS status, 'multinli-' || l_orderkey AS id, round(b / n, 9) AS neutral FROM v"""
)
def converted_votes(t):
    """Rows of the multinli layout, all of them: votes as distributions, rows without gold skipped, gold that is not modal told apart before it would stop a build."""
    names = F.create_map(*(F.lit(x) for x in ("A", "entailment", "N", "neutral", "R", "contradiction")))
    raw = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(names[F.col("l_returnflag")]).alias("annotator_labels"))
    n = lambda v: F.size(F.filter("annotator_labels", lambda x: x == v))
    modal = (n("neutral") > 0) & (n("neutral") >= F.greatest(n("entailment"), n("contradiction")))
    gold = F.when(~modal & (F.col("l_orderkey") % 2 == 0), "-").otherwise("neutral")
    raw = raw.select(F.col("l_orderkey").cast("string").alias("pairID"), F.col("l_orderkey").cast("string").alias("promptID"), F.lit("p").alias("sentence1"), F.lit("h").alias("sentence2"), gold.alias("gold_label"), "annotator_labels")
    return adapters.REGISTRY["multinli"].record(raw).select("status", "id", F.round(F.col("distribution")["neutral"], 9).alias("neutral"))


@query("SELECT 'squad2-' || l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END AS target FROM lineitem")
def converted_questions(t):
    """Rows of the nested squad2 layout: document, paragraph, question."""
    answers = F.when(F.col("l_quantity") > 25, F.array(F.struct(F.lit("x").alias("text"), F.lit(0).alias("answer_start")))).otherwise(F.array().cast("array<struct<text:string,answer_start:int>>"))
    qas = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("q").alias("question"), answers.alias("answers"), (F.col("l_quantity") <= 25).alias("is_impossible"))
    paragraphs = t.lineitem.groupBy("l_orderkey").agg(F.struct(F.col("l_orderkey").cast("string").alias("context"), F.collect_list(qas).alias("qas")).alias("p"))
    documents = paragraphs.select(F.array(F.struct(F.lit("t").alias("title"), F.array("p").alias("paragraphs"))).alias("data"))
    return adapters.accepted(adapters.convert("squad2", documents)).select("id", "target")


@query("SELECT 'summeval-' || l_orderkey || '-' || p AS id, greatest(0, least(4, floor(v + 0.5) - 1))::INT::VARCHAR AS target FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax) - 1 p, 1 + l_tax * 50 v FROM lineitem)")
def converted_scores(t):
    """Rows of the summeval layout: parallel arrays of summaries and scores."""
    each = F.struct("l_linenumber", "l_quantity", F.lit("s").alias("s"), (1 + F.col("l_tax") * 50).alias("v"))
    raw = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(each)).alias("a"))
    raw = raw.select(F.col("l_orderkey").cast("string").alias("id"), F.lit("t").alias("text"), F.transform("a", lambda x: x["s"]).alias("machine_summaries"), F.transform("a", lambda x: x["v"]).alias("relevance"))
    return adapters.accepted(adapters.convert("summeval", raw)).select("id", "target")


@query("SELECT count(*) FILTER (l_shipdate IS NOT NULL) AS converted, 0::BIGINT AS skipped, count(*) FILTER (length(l_orderkey::VARCHAR) > 4) AS dropped_over_length, count(*) FILTER (length(l_orderkey::VARCHAR) <= 4) AS kept FROM lineitem")
def build_counts(t):
    raw = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("sentence1"), F.lit("b").alias("sentence2"), F.lit(1).alias("label"))
    made = adapters.convert("paws", raw)
    return adapters.build_summary(made, F.length(F.get_json_object("state", "$.sentence1")), 4)
