"""Validation rules, curation steps, adapters and the rewriting of records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import parse as pr
from tallyforge.operators import aggregates as ag
from tallyforge.operators import curation as cu
from tallyforge.operators import joins, ordered, selection
from tallyforge.operators import validate as va
from tallyforge.operators.stages import stage
from tallyforge.plans.catalog import query
from tallyforge.sources import adapters


def _counted(df: DataFrame, rules) -> DataFrame:
    """(reason, n) of the rows that break rules, and how many break none as ``accepted``."""
    marked = df.select(va.reasons(rules).alias("r"))
    return marked.select(F.explode(F.when(F.size("r") > 0, F.col("r")).otherwise(F.array(F.lit("accepted")))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_SQL_COUNTED = "SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(r) > 0 THEN r ELSE ['accepted'] END) AS reason FROM (SELECT list_filter([{}], lambda x: x IS NOT NULL) AS r FROM ({}) z)) GROUP BY reason".format


# -- validation ------------------------------------------------------------

_TEACHER = "SELECT l_linenumber % 4 AS v, round(l_discount * 5, 2) AS p, l_tax AS tax FROM lineitem"


@query(
    _SQL_COUNTED(
        "CASE WHEN v = 0 THEN 'labels' END, CASE WHEN p > 1 THEN 'bounds' END, CASE WHEN v = 1 AND abs(p + (0.95 - p) - 1) > 2 * 0.005 + 1e-8 OR v <> 1 AND abs(p + (1 - p) - 1) > 0.01 THEN 'sum' END, CASE WHEN v = 2 AND abs(0.5 - CASE WHEN v = 1 THEN 0.95 - p ELSE 1 - p END) > 2 * 0.005 + 1e-8 THEN 'score' END, CASE WHEN tax * 20 > 1 THEN 'confidence' END",
        _TEACHER,
    )
)
def teacher_answers(t):
    """Answers of a teacher that break label sets, bounds, sums as rounded, expected score or confidence, in known places."""
    v, p = F.col("l_linenumber") % 4, F.round(F.col("l_discount") * 5, 2)
    labels = F.when(v == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    rest = F.when(v == 1, F.lit(0.95) - p).otherwise(F.lit(1.0) - p)
    rules = va.teacher_rules(labels, F.array(p, rest), F.array(F.lit("a"), F.lit("b")), F.when(v == 2, F.lit(0.5)), F.col("l_tax") * 20)
    return _counted(t.lineitem, rules)


@query(
    _SQL_COUNTED(
        "CASE WHEN len(list_filter(string_split_regex(state, '[\\s\\x0b\\x{85}\\p{Z}]+'), lambda w: w <> '')) < 15 THEN 'words' END, CASE WHEN n < 2 THEN 'options' END, CASE WHEN target IS NULL OR length(trim(target)) = 0 THEN 'rationale' END",
        "SELECT coalesce(input.state, '') AS state, coalesce(len(map_keys(reference.distribution)), 3) AS n, reference.target AS target FROM decision_records",
    )
)
def record_structure(t):
    """Records with too few words, options or no rationale; the target stands in for the rationale."""
    options = F.coalesce(F.map_keys("reference.distribution"), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return _counted(t.decision_records, va.structure_rules(F.coalesce("input.state", F.lit("")), options, F.col("reference.target")))


@query(_SQL_COUNTED("CASE WHEN n % 3 = 2 THEN 'kind' END, CASE WHEN n = 0 OR n > 26 THEN 'choices' END, CASE WHEN n > 5 THEN 'distinct' END", "SELECT o_orderkey % 30 AS n FROM orders"))
def scorer_schemas(t):
    """Schemas with another kind, too many or no choices, or repeated ones."""
    n = (F.col("o_orderkey") % 30).cast("int")
    kind = F.element_at(F.array(F.lit("enum"), F.lit("boolean"), F.lit("text")), n % 3 + 1)
    choices = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i == 6, "c1").otherwise(F.concat(F.lit("c"), i.cast("string")))))
    return _counted(t.orders, va.schema_rules(kind, choices))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS repeated FROM orders")
def repeated_field_names(t):
    """Objects in which a name occurs twice, at some depth."""
    inner = F.when(F.col("o_orderkey") % 2 == 0, F.lit('{"x": 1, "y": 2, "x": 3}')).otherwise(F.lit('{"x": 1, "y": 2}'))
    return t.orders.select("o_orderkey", pr.repeated_names(F.concat(F.lit('{"a": [0, '), inner, F.lit('], "x": 1}'))).alias("repeated"))


_REVIEWS = "SELECT text, substr(text, 1, 40) AS a, substr(text, 61, 40) AS b, doc_id % 5 AS k FROM documents WHERE length(text) >= 400"


@query(
    _SQL_COUNTED(
        "CASE WHEN k = 1 THEN 'check 1' END, CASE WHEN k = 2 THEN 'target' END, CASE WHEN k = 3 OR a = b THEN 'count' END, CASE WHEN k = 4 AND NOT contains(text, 'zz' || b) OR k = 0 AND doc_long THEN 'literal' END",
        "SELECT *, length(text) >= 600 AS doc_long FROM (" + _REVIEWS + ")",
    )
)
def blind_reviews(t):
    """Reviews with a failed check, another target, too few quotes, a quote that is not in the text, or one that is too long."""
    k, text = F.col("doc_id") % 5, F.col("text")
    a, b = F.substring("text", 1, 40), F.substring("text", 61, 40)
    quotes = F.when(k == 3, F.array(a)).when(k == 4, F.array(a, F.concat(F.lit("zz"), b))).when((k == 0) & (F.length("text") >= 600), F.array(F.substring("text", 1, 200), b)).otherwise(F.array(a, b))
    rows = t.documents.where(F.length("text") >= 400)
    return _counted(rows, va.review_rules([F.lit(True), k != 1], k != 2, quotes, text))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND 2 + o_orderkey % 30 BETWEEN 6 AND 24 THEN 1 + o_orderkey % 30 ELSE 0 END AS assignments, CASE WHEN o_orderkey % 4 = 0 AND 2 + o_orderkey % 30 BETWEEN 6 AND 24 THEN o_orderkey % 8 <> 0 END AS parses FROM orders")
def code_blocks(t):
    """Texts with one, two or no fenced block of some lines; the one block of 6 to 24 lines comes out, and whether it parses."""
    n = (F.col("o_orderkey") % 30).cast("int")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("x"), i.cast("string"), F.lit(" = "), i.cast("string"))), "\n")
    last = F.when(F.col("o_orderkey") % 8 == 0, "\nif x0").otherwise("\nprint(x0)")
    block = F.concat(F.lit("```python\n"), lines, last, F.lit("\n```"))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("See:\n"), block, F.lit("\nDone."))).when(F.col("o_orderkey") % 4 == 1, F.concat(block, F.lit("\nand\n"), block)).otherwise("no code")
    rows = stage(t.orders.select("o_orderkey", va.code_block(text).alias("code")), "code")
    return rows.select("o_orderkey", F.coalesce(F.size(F.regexp_extract_all("code", F.lit(r"(?m)^x\d+ = "), 0)), F.lit(0)).cast("long").alias("assignments"), pr.python_parses("code").alias("parses"))


@query("SELECT 'same' AS run, 'resumed' AS outcome UNION ALL SELECT 'other rows', 'settings differ from the saved run: rows'")
def resumed_settings(t):
    """A run is resumed only with the settings it was started with; the settings state the table's size."""
    saved = {"rows": t.orders.count(), "model": "m", "note": 1}

    def outcome(current) -> str:
        try:
            va.check_settings(saved, current, ["rows", "model"])
            return "resumed"
        except va.InvalidRows as error:
            return str(error)

    return t.spark.createDataFrame([("same", outcome(saved | {"note": 2})), ("other rows", outcome(saved | {"rows": -1}))], "run string, outcome string")


# -- curation --------------------------------------------------------------

_PLAN_RULES = [({"a": "supported"}, "yes"), ({"a": "refuted"}, "no"), ({"b": "refuted", "a": "supported"}, "no")]


@query(
    _SQL_COUNTED(
        "CASE WHEN k = 5 THEN 'atoms' END, CASE WHEN k IN (1, 5) THEN 'total' END, CASE WHEN k = 2 THEN 'focus' END, CASE WHEN k IN (2, 3) THEN 'only focus differs' END, CASE WHEN k = 4 THEN 'decided' END, CASE WHEN k = 2 THEN 'label changes' END",
        "SELECT o_orderkey % 6 AS k FROM orders",
    )
)
def plan_problems(t):
    """Rule plans with one fault each, in known places: a missing assignment, no flip of the focus, another difference, a conflict, a repeated atom."""
    k = F.col("o_orderkey") % 6
    m = lambda a, b: F.create_map(F.lit("a"), F.lit(a), F.lit("b"), F.lit(b))
    base = F.when(k == 4, m("supported", "refuted")).otherwise(m("supported", "unknown"))
    counter = F.when(k == 1, F.create_map(F.lit("a"), F.lit("refuted"))).when(k == 2, m("supported", "unknown")).when(k == 3, m("refuted", "supported")).when(k == 4, m("refuted", "refuted")).otherwise(m("refuted", "unknown"))
    atoms = F.when(k == 5, F.array(F.lit("a"), F.lit("b"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return _counted(t.orders, cu.plan_rules(atoms, cu.rule_literal(_PLAN_RULES), F.lit("a"), base, counter))


@query("SELECT l_orderkey, bool_and(l_quantity < 50) AND list_sort(list(l_linenumber)) = range(1, count(*)::INT + 1) AND bool_and(l_tax < 0.08) AS passed FROM lineitem GROUP BY l_orderkey")
def passed_audits(t):
    """Orders as audits: a flag and a judged rule for each line."""
    each = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") < 50).alias("flags"), F.collect_list(F.col("l_linenumber") - 1).alias("indexes"), F.collect_list(F.col("l_tax") < 0.08).alias("sound"), F.count("*").cast("int").alias("n"))
    return each.select("l_orderkey", cu.audit_passes(F.col("flags"), F.col("indexes"), F.col("sound"), F.col("n")).alias("passed"))


@query(
    """WITH d AS (SELECT doc_id, text, doc_id % 7 AS k FROM documents WHERE length(text) >= 60)
    SELECT doc_id, 'p' AS atom, CASE k WHEN 1 THEN 'missing atom' WHEN 2 THEN 'no quote' WHEN 3 THEN 'quote not in context' WHEN 4 THEN 'unknown state' END AS problem FROM d WHERE k BETWEEN 1 AND 4
    UNION ALL SELECT doc_id, 'z', 'unexpected atom' FROM d WHERE k = 5"""
)
def fact_problems(t):
    """Judgments of two facts for each document, with one fault each in known places."""
    k = F.col("doc_id") % 7
    docs = t.documents.where(F.length("text") >= 60).select("doc_id", F.col("text").alias("context"), k.alias("k"))
    jobs = docs.select("doc_id", "context", F.array(F.lit("p"), F.lit("q")).alias("atoms"))
    quote = F.substring("context", 11, 30)
    p = F.struct(F.lit("p").alias("atom"), F.when(F.col("k") == 4, "perhaps").otherwise("supported").alias("state"), F.when(F.col("k") == 2, F.array().cast("array<string>")).when(F.col("k") == 3, F.array(F.concat(quote, F.lit("#~#")))).otherwise(F.array(quote)).alias("quotes"))
    q = F.struct(F.lit("q").alias("atom"), F.lit("unknown").alias("state"), F.array().cast("array<string>").alias("quotes"))
    z = F.struct(F.lit("z").alias("atom"), F.lit("unknown").alias("state"), F.array().cast("array<string>").alias("quotes"))
    said = docs.select("doc_id", F.explode(F.when(F.col("k") == 1, F.array(q)).when(F.col("k") == 5, F.array(p, q, z)).otherwise(F.array(p, q))).alias("x")).select("doc_id", "x.*")
    return cu.assess_facts(jobs, said, "doc_id")


@query(
    """SELECT l_orderkey, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'N', 'R')) = 3 AND bool_and(CASE l_returnflag WHEN 'A' THEN l_quantity < 45 WHEN 'N' THEN l_quantity >= 3 WHEN 'R' THEN true ELSE false END) AS passed FROM lineitem GROUP BY 1"""
)
def entailed_pairs(t):
    """Orders as pairs of texts, lines as checks: each of three expected checks must be there and as expected."""
    state = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_quantity") < 45, "supported").otherwise("refuted")).when(F.col("l_returnflag") == "N", F.when(F.col("l_quantity") < 3, "unknown").otherwise("refuted")).otherwise("unknown")
    rows = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("check"), state.alias("state"))
    return cu.entailment_gate(rows, {"A": "supported", "N": "refuted", "R": "unknown"}, "l_orderkey", "check", "state")


def _groups(t) -> DataFrame:
    """Each order as a base and a counterfactual variant, whose one fact is supported or refuted."""
    variants = F.array(F.struct(F.lit("base").alias("variant"), F.lit("supported").alias("f")), F.struct(F.lit("counterfactual").alias("variant"), F.lit("refuted").alias("f")))
    return t.orders.select("o_orderkey", F.explode(variants).alias("x")).select("o_orderkey", "x.variant", F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), F.col("x.variant")).alias("state"), F.create_map(F.lit("paid"), F.col("x.f"), F.lit("late"), F.lit("unknown")).alias("intended"), F.col("x.f").alias("f"))


@query(
    """SELECT o_orderkey, variant, CASE WHEN k IN (0, 4, 5) THEN CASE WHEN variant = 'base' THEN 'ship' ELSE 'hold' END END AS target, CASE k WHEN 1 THEN 'not verified' WHEN 2 THEN 'inconsistent' WHEN 3 THEN 'facts differ' END AS reason
    FROM (SELECT o_orderkey, o_orderkey % 6 AS k, unnest(['base', 'counterfactual']) AS variant FROM orders)"""
)
def emitted_rows(t):
    """Rows of variants whose facts were verified as intended, and issues of the others."""
    k = F.col("o_orderkey") % 6
    groups = _groups(t)
    facts = F.array(F.struct(F.lit("paid").alias("atom"), F.when(k == 2, "inconsistent").when(k == 3, "unknown").otherwise(F.col("f")).alias("state")), F.struct(F.lit("late").alias("atom"), F.lit("unknown").alias("state")))
    verified = groups.where(k != 1).select("o_orderkey", "variant", F.explode(facts).alias("x")).select("o_orderkey", "variant", "x.*")
    rows, issues = cu.emit_rows(groups.drop("f"), verified, cu.rule_literal([({"paid": "supported"}, "ship"), ({"paid": "refuted"}, "hold")]), "o_orderkey")
    return rows.select("o_orderkey", "variant", "target", F.lit(None).cast("string").alias("reason")).unionByName(issues.select("o_orderkey", "variant", F.lit(None).cast("string").alias("target"), "reason"))


@query("SELECT CASE o_orderkey % 5 WHEN 1 THEN 'no verdict' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'disagrees' END AS issue, count(*) AS n FROM orders WHERE o_orderkey % 5 BETWEEN 1 AND 3 GROUP BY 1")
def blind_verification(t):
    """Orders as blind cases: verdicts are missing, ambiguous or other than the target, in known places."""
    cases = stage(cu.blind_cases(t.orders.select("o_orderkey", "o_custkey", F.lit("yes").alias("target")), "o_orderkey", "o_custkey"), "cases")
    k = F.col("o_orderkey") % 5
    verdicts = cases.where(k != 1).select("case_id", F.when(k == 3, "no").otherwise("yes").alias("target"), (k != 2).alias("unambiguous"))
    return cu.verification_issues(cases, verdicts, "target").groupBy("issue").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type AS atom, 'supported' AS expected, CASE WHEN event_id % 10 < 3 THEN 'refuted' END AS judged FROM events WHERE event_id % 10 < 3 OR event_id % 10 >= 7")
def unexpected_judgments(t):
    """Events judged other than expected or not at all."""
    rows, k = t.events.select("event_id", F.col("event_type").alias("atom")), F.col("event_id") % 10
    judged = rows.where(k < 7).select("event_id", "atom", F.when(k < 3, "refuted").otherwise("supported").alias("state"))
    return cu.unexpected(judged, rows.select("event_id", "atom", F.lit("supported").alias("state")), "event_id")


@query(
    """SELECT o_orderkey, CASE WHEN w > 0 THEN 'a' ELSE 'b' END AS target, CASE WHEN w > 0 THEN 'a' ELSE 'b' END <> CASE WHEN o_orderstatus = 'O' THEN 'a' ELSE 'b' END AS reviewed
    FROM (SELECT o_orderkey, o_orderstatus, o_totalprice - 150000 AS w FROM orders)"""
)
def teacher_labels(t):
    """Weights of two labels normalised; the rows whose greatest is not the author's go to review."""
    rows = t.orders.select("o_orderkey", F.array(F.lit("a"), F.lit("b")).alias("labels"), F.array(F.col("o_totalprice"), F.lit(150000.0)).alias("weights"), F.when(F.col("o_orderstatus") == "O", "a").otherwise("b").alias("author"))
    rows = rows.withColumn("weights", F.when(F.col("weights")[0] > 150000, F.col("weights")).otherwise(F.array(F.least(F.col("weights")[0], F.lit(149999.0)), F.lit(150000.0))))
    targets, review = cu.teacher_targets(rows, "o_orderkey", "labels", "weights", "author")
    return targets.select("o_orderkey", "target").join(review.select("o_orderkey", F.lit(True).alias("reviewed")), "o_orderkey", "left").fillna(False, ["reviewed"])


# -- adapters --------------------------------------------------------------


def _status(made: DataFrame) -> DataFrame:
    return made.groupBy("status", "target").agg(F.count("*").alias("n"))


@query("""SELECT 'ok' AS status, '"' || CASE l_returnflag WHEN 'A' THEN 'SUPPORTS' WHEN 'N' THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END || '"' AS target, count(*) AS n FROM lineitem GROUP BY 2""")
def converted_claims(t):
    """Rows of the vitaminc layout."""
    label = F.when(F.col("l_returnflag") == "A", "SUPPORTS").when(F.col("l_returnflag") == "N", "REFUTES").otherwise("NOT ENOUGH INFO")
    raw = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unique_id"), F.col("l_orderkey").cast("string").alias("case_id"), F.lit("c").alias("claim"), F.lit("e").alias("evidence"), label.alias("label"))
    return _status(adapters.convert("vitaminc", raw))


@query(
    """SELECT CASE WHEN o_orderkey % 4 <> 0 OR o_orderpriority <> '1-URGENT' OR o_orderkey % 3 = 0 THEN 'skip' ELSE 'ok' END AS status, CASE WHEN o_orderstatus = 'F' THEN '"alarm"' ELSE '"music"' END AS target, count(*) AS n FROM orders GROUP BY ALL"""
)
def converted_utterances(t):
    """Rows of the massive layout: rows of other partitions and locales and blank utterances are skipped."""
    raw = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "de-DE").otherwise("en-US").alias("locale"), F.when(F.col("o_orderpriority") == "1-URGENT", "test").otherwise("train").alias("partition"),
        F.when(F.col("o_orderstatus") == "F", "alarm").otherwise("music").alias("scenario"), F.lit("i").alias("intent"), F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise("play it").alias("utt"),
    )
    return _status(adapters.convert("massive", raw, locale="de-DE"))


@query(
    """SELECT CASE WHEN s <> 'human' OR redacted THEN 'skip' ELSE 'ok' END AS status, CASE WHEN unsafe THEN 'true' ELSE 'false' END AS target, count(*) AS n FROM (
    SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_tax > 0.04 ELSE l_discount > 0.05 END AS unsafe, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_returnflag = 'A' THEN 'llm' ELSE 'human' END ELSE CASE WHEN l_returnflag = 'R' THEN 'llm' ELSE 'human' END END AS s, l_quantity = 50 AS redacted FROM lineitem) GROUP BY ALL"""
)
def converted_prompts(t):
    """Rows of the aegis2 layout: human labels of prompts or, where there is one, of the response; redacted ones are skipped."""
    even = F.col("l_linenumber") % 2 == 0
    label = lambda c: F.when(c, "unsafe").otherwise("safe")
    raw = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("p").alias("prompt"), F.when(even, "r").alias("response"), label(F.col("l_discount") > 0.05).alias("prompt_label"), F.when(even, label(F.col("l_tax") > 0.04)).alias("response_label"),
        F.when(F.col("l_returnflag") == "R", "llm").otherwise("human").alias("prompt_label_source"), F.when(even, F.when(F.col("l_returnflag") == "A", "llm").otherwise("human")).alias("response_label_source"), F.when(F.col("l_quantity") == 50, "x").alias("reconstruction_id_if_redacted"),
    )
    return _status(adapters.convert("aegis2", raw))


@query("SELECT left(sha256(p_type), 16) AS family, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS target, count(*) AS n FROM part GROUP BY ALL")
def converted_yes_no(t):
    """Rows of the boolq layout; questions on one passage are a family."""
    raw = t.part.select(F.col("p_partkey").cast("string").alias("question"), F.col("p_type").alias("passage"), (F.col("p_size") > 25).alias("answer"))
    return adapters.convert("boolq", raw).groupBy("family", "target").agg(F.count("*").alias("n"))


@query("SELECT 'civil_comments-' || event_id AS id, CASE WHEN v >= 0.5 THEN 'true' ELSE 'false' END AS target, round(1 - v, 9) AS not_toxic FROM (SELECT event_id, value / (SELECT max(value) FROM events) AS v FROM events)")
def converted_comments(t):
    """Rows of the civil_comments layout."""
    most = t.events.agg(F.max("value")).first()[0]
    raw = t.events.select(F.col("event_id").alias("row_index"), F.lit("text").alias("text"), (F.col("value") / F.lit(most)).alias("toxicity"))
    return adapters.convert("civil_comments", raw).select("id", "target", F.round(F.col("distribution")["false"], 9).alias("not_toxic"))


@query("SELECT 'score' AS type, (l_quantity::INT % 5)::VARCHAR AS target, count(*) AS n FROM lineitem GROUP BY 2")
def converted_ratings(t):
    """Rows of the helpsteer2 layout."""
    raw = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_index"), F.lit("p").alias("prompt"), F.lit("r").alias("response"), (F.col("l_quantity").cast("int") % 5).alias("helpfulness"))
    return adapters.convert("helpsteer2", raw).groupBy("type", "target").agg(F.count("*").alias("n"))


@query("""SELECT '"' || CASE c_mktsegment WHEN 'BUILDING' THEN 'yes' WHEN 'MACHINERY' THEN 'no' ELSE 'maybe' END || '"' AS target, count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS even FROM customer GROUP BY 1""")
def converted_studies(t):
    """Rows of the pubmedqa layout, decisions in mixed case."""
    decision = F.when(F.col("c_mktsegment") == "BUILDING", "Yes").when(F.col("c_mktsegment") == "MACHINERY", "NO").otherwise("maybe")
    raw = t.customer.select(F.col("c_custkey").alias("pubid"), F.lit("q").alias("question"), F.struct(F.array("c_name").alias("contexts")).alias("context"), F.lit("l").alias("long_answer"), decision.alias("final_decision"))
    made = adapters.convert("pubmedqa", raw)
    return made.groupBy("target").agg(F.count("*").alias("n"), F.count_if(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 2 == 0).alias("even"))


# -- rewriting -------------------------------------------------------------


@query(
    """SELECT source_line, question, 2::INT AS fields, len(json_keys(payload, '$.questions.skill.criteria')) + CASE WHEN list_contains(json_keys(payload, '$.questions.skill.criteria'), '__no_skill__') THEN 0 ELSE 1 END AS options FROM disagreements WHERE question IS NOT NULL AND len(json_keys(payload, '$.questions.skill.criteria')) > 0"""
)
def routing_requests(t):
    """The routing request of each disagreement built anew from its tools: a choice among them and the option of none."""
    criteria = F.get_json_object("payload", "$.questions.skill.criteria")
    names = F.json_object_keys(criteria)
    rows = t.disagreements.where("question is not null").withColumn("names", names).where(F.size("names") > 0)
    described = F.transform("names", lambda n: F.concat(F.lit("about "), n))
    made = rows.select("source_line", pr.route_payload(F.col("names"), described, F.col("question"), F.lit("the plan"), "m").alias("p"))
    return made.select("source_line", F.get_json_object("p", "$.state.question").alias("question"), F.size(F.json_object_keys(F.get_json_object("p", "$.state"))).alias("fields"), F.size(F.json_object_keys(F.get_json_object("p", "$.questions.skill.criteria"))).cast("long").alias("options"))


@query("SELECT source_line, CASE WHEN source_line % 3 = 0 AND json_valid(payload) THEN payload WHEN source_line % 3 = 1 THEN '{}' ELSE '{}' END AS arguments FROM disagreements")
def arguments_or_none(t):
    """Arguments that parse as an object stay; cut off ones, texts and arrays become an empty object."""
    k = F.col("source_line") % 3
    given = F.when(k == 0, F.col("payload")).when(k == 1, F.concat(F.lit("["), F.col("payload"), F.lit("]"))).otherwise(F.expr("substring(payload, 1, length(payload) - 1)"))
    return t.disagreements.select("source_line", pr.arguments_or_empty(given).alias("arguments"))


@query(
    """SELECT record_no, input.state AS context, CASE WHEN k = 'noul' THEN 'boolean' ELSE 'enum' END AS type, CASE WHEN k = 'noul' THEN ['false', 'true'] WHEN k = 'score' THEN list_transform(range(json_array_length(c)::BIGINT), lambda i: i::VARCHAR) ELSE json_keys(c) END AS choices, input.questions['decision'].instructions AS description
    FROM (SELECT record_no, input, input.questions['decision'].type AS k, input.questions['decision'].criteria AS c FROM decision_records) WHERE k IN ('noul', 'score', 'choice')"""
)
def scorer_inputs(t):
    q = F.col("input.questions")["decision"]
    rows = t.decision_records.where(q["type"].isin("noul", "score", "choice"))
    return rows.select("record_no", pr.adapt_input(F.col("input.state"), q["type"], q["instructions"], q["criteria"]).alias("x")).select("record_no", "x.*")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN '2' WHEN 2 THEN 'B — beta' WHEN 3 THEN 'A — alpha' END AS decoded FROM orders"""
)
def decoded_targets(t):
    """Texts as typed targets: truth values, levels, options in full or by their letter; an ambiguous letter is none."""
    k = F.col("o_orderkey") % 5
    options = F.when(k == 1, F.array(*map(F.lit, "0123"))).when(k == 4, F.array(F.lit("A — alpha"), F.lit("A — again"))).otherwise(F.array(F.lit("A — alpha"), F.lit("B — beta")))
    value = F.when(k == 0, "TRUE").when(k == 1, "2").when(k == 2, "B").when(k == 3, "A — alpha").otherwise("A")
    kind = F.when(k == 0, "noul").when(k == 1, "score").otherwise("choice")
    return t.orders.select("o_orderkey", pr.decode_target(value, kind, options).alias("decoded"))


@query("SELECT record_no, 0::BIGINT + record_no % 3 AS place, 3::INT AS choices, true AS same FROM decision_records")
def gold_at_places(t):
    """Three choices in an order fixed by the record, with the gold one where the record asks for it."""
    place = (F.col("record_no") % 3).cast("int")
    choices = F.array(F.lit("gold"), F.lit("one"), F.lit("two"))
    made = pr.gold_at(choices, F.lit("gold"), place, F.col("id"), 5)
    return t.decision_records.select("record_no", (F.array_position(made, "gold") - 1).alias("place"), F.size(made).alias("choices"), (F.array_sort(made) == F.array_sort(choices)).alias("same"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS name FROM orders")
def renamed_priorities(t):
    return t.orders.select("o_orderkey", pr.renamed(F.col("o_orderpriority"), {"1-URGENT": "urgent", "5-LOW": "low"}).alias("name"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS matches FROM orders")
def score_legends(t):
    """Legends that spell the levels in order, leave one out, or swap two."""
    k = F.col("o_orderkey") % 3
    m = lambda *v: F.create_map(*(F.lit(x) for kv in enumerate(v) for x in (str(kv[0]), kv[1])))
    legend = F.when(k == 0, m("bad", "fair", "good")).when(k == 1, m("bad", "fair")).otherwise(m("fair", "bad", "good"))
    return t.orders.select("o_orderkey", pr.legend_matches(legend, F.array(F.lit("bad"), F.lit("fair"), F.lit("good"))).alias("matches"))


@query("SELECT gold_no, regexp_replace(lower(translate(question, '０１２３４５６７８９', '0123456789')), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM gold_template")
def normalised_questions(t):
    return t.gold_template.select("gold_no", pr.match_key("question").alias("key"))


@query(
    """SELECT source_line, list_sort(list_distinct(list(j.key) FILTER (NOT regexp_matches(j.fullkey, '\\]$')))) AS keys, coalesce(sum(length(j.atom ->> '$')) FILTER (j.type = 'VARCHAR'), 0)::INT + greatest(count(*) FILTER (j.type = 'VARCHAR') - 1, 0)::INT AS chars
    FROM disagreements d, json_tree(d.payload) j WHERE json_valid(d.payload) GROUP BY source_line"""
)
def nested_names_and_texts(t):
    """Field names at any depth of each payload, and how long its texts are one under the other."""
    rows = t.disagreements.where(F.try_parse_json("payload").isNotNull())
    return rows.select("source_line", pr.nested_keys("payload").alias("keys"), F.length(pr.flat_text("payload")).alias("chars"))


@query("""SELECT c_custkey, sha256('{"balance": ' || c_acctbal::DECIMAL(18, 2)::VARCHAR || ', "key": ' || c_custkey || ', "name": "' || c_name || '", "parts": [true, null, "é"]}') AS fingerprint FROM customer WHERE c_acctbal::DECIMAL(18, 2)::VARCHAR NOT LIKE '%0' AND abs(c_acctbal) >= 1""")
def canonical_fingerprints(t):
    """The digest of a record's canonical JSON, whatever the order of its fields."""
    balance = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    rows = t.customer.where(~balance.endswith("0") & (F.abs("c_acctbal") >= 1))
    text = F.concat(F.lit('{"parts":[true, null,"\\u00e9"] ,"name":"'), F.col("c_name"), F.lit('","key":'), F.col("c_custkey").cast("string"), F.lit(', "balance" : '), balance, F.lit("}"))
    return rows.select("c_custkey", pr.fingerprint(text).alias("fingerprint"))


@query("SELECT doc_id, (doc_id % 4)::INT AS changed FROM documents WHERE text IS NOT NULL")
def appended_words(t):
    """Words changed between each text and itself with a few words more at its end."""
    longer = F.concat("text", F.repeat(F.lit(" zzz"), (F.col("doc_id") % 4).cast("int")))
    return t.documents.where("text is not null").select("doc_id", pr.changed_words(F.col("text"), longer).alias("changed"))


@query(
    """SELECT source_line, json_extract_string(payload, '$.model') || ' edited' AS model, CASE WHEN json_valid(payload) THEN len(json_keys(payload)) END AS fields FROM disagreements WHERE json_type(payload, '$.model') = 'VARCHAR' AND len(string_split(json_extract_string(payload, '$.model'), 'route')) = 2"""
)
def edits_at_paths(t):
    """Payloads whose model is edited in place, by its one occurrence of a word; the rest keeps its fields."""
    edited = pr.edit_at(F.col("payload"), F.array(F.lit("model")), F.lit("route"), F.lit("ROUTE"))
    rows = stage(t.disagreements.select("source_line", edited.alias("e")).where("e is not null"), "edited")
    return rows.select("source_line", F.concat(F.replace(F.get_json_object("e", "$.model"), F.lit("ROUTE"), F.lit("route")), F.lit(" edited")).alias("model"), F.size(F.json_object_keys("e")).cast("long").alias("fields"))


# -- pivots, subsets, near duplicates --------------------------------------


@query("SELECT l_orderkey, l_returnflag AS stage, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity)::INT AS occurrence, 'l_quantity' AS amount, l_quantity AS value FROM lineitem")
def pivoted_lines(t):
    """The wide table of each order's lines by return flag and occurrence, read back cell by cell."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_quantity")
    rows = t.lineitem.withColumn("occurrence", F.row_number().over(order))
    wide = ag.dynamic_pivot(rows, "l_orderkey", "l_returnflag", "occurrence", ["l_quantity"], ["A", "N", "R"])
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in wide.columns[1:])))
    long = wide.select("l_orderkey", cells.alias("x")).where("x.value is not null")
    return long.select("l_orderkey", F.split("x.name", "_")[0].alias("stage"), F.split("x.name", "_")[1].cast("int").alias("occurrence"), F.lit("l_quantity").alias("amount"), "x.value")


@query("SELECT user_id, event_type AS stage, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INT AS occurrence, 'value' AS amount, value FROM events WHERE value IS NOT NULL")
def pivot_cells(t):
    """The same kept long, for tables too wide for columns."""
    rows = ordered.numbered(t.events, ["user_id", "event_type"], ["event_id"], "n").select("user_id", F.col("event_type").alias("stage"), F.col("n").cast("int").alias("occurrence"), "value")
    return ag.pivot_cells(rows, "user_id", "stage", "occurrence", ["value"])


@query(
    """WITH RECURSIVE f AS (SELECT o_orderpriority || o_orderstatus AS family, o_orderpriority AS domain, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS a, count(*) FILTER (o_orderkey % 3 = 1) AS b, count(*) FILTER (o_orderkey % 3 = 2) AS c FROM orders GROUP BY ALL),
    g AS (SELECT *, row_number() OVER (ORDER BY sha256('3:' || family)) - 1 AS i FROM f), goal AS (SELECT sum(n) AS s FROM g WHERE i IN (1, 3, 6)),
    m AS (SELECT mask, list_sort(list(i)) AS idx, sum(n) AS n, count(DISTINCT domain) AS d, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM range(1, (1::BIGINT << (SELECT count(*) FROM g)::INT)) r(mask) JOIN g ON (mask::BIGINT >> i::INT) & 1 = 1 GROUP BY mask),
    best AS (SELECT mask FROM m, goal WHERE n = s ORDER BY -d, (3 * a - s) ** 2 + (3 * b - s) ** 2 + (3 * c - s) ** 2, idx LIMIT 1)
    SELECT o_orderkey FROM orders JOIN g ON family = o_orderpriority || o_orderstatus, best WHERE (mask::BIGINT >> i::INT) & 1 = 1"""
)
def exact_family_rows(t):
    """Whole families of orders with exactly a stated number of rows, of most domains and most even kinds."""
    import hashlib

    rows = t.orders.select("o_orderkey", F.concat("o_orderpriority", "o_orderstatus").alias("family"), F.col("o_orderpriority").alias("domain"), F.element_at(F.array(F.lit("choice"), F.lit("noul"), F.lit("score")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("kind"))
    sizes = {r["family"]: r["count"] for r in rows.groupBy("family").count().collect()}
    hashed = sorted(sizes, key=lambda f: hashlib.sha256(f"3:{f}".encode()).hexdigest())
    goal = sum(sizes[hashed[i]] for i in (1, 3, 6) if i < len(hashed))
    return selection.exact_family_split(rows, "family", "domain", "kind", goal, 3).select("o_orderkey")


@query(
    """WITH s AS (SELECT gold_no k, phase, list_sort(list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]+'))) w FROM gold_template WHERE question IS NOT NULL), c AS (SELECT phase = 'initial' AS old, min(k) k, w FROM s WHERE len(w) > 0 GROUP BY ALL),
    x AS (SELECT old, k, len(w) n, unnest(w) u FROM c), p AS (SELECT a.k a, b.k b, count(*) s, any_value(a.n) na, any_value(b.n) nb FROM x a JOIN x b ON a.u = b.u AND a.old AND NOT b.old GROUP BY ALL)
    SELECT a, b, round(s / (na + nb - s), 9) AS similarity FROM p WHERE s >= 0.8 * (na + nb - s)"""
)
def similar_to_earlier(t):
    """Questions of the later phases that are near those of the first."""
    first = F.coalesce(F.col("phase") == "initial", F.lit(False))
    later, earlier = t.gold_template.where(F.col("phase") != "initial"), t.gold_template.where(first)
    return joins.jaccard_pairs(later, "gold_no", "question", prior=earlier).withColumn("similarity", F.round("similarity", 9))



@query(
    """WITH p AS (SELECT n_regionkey AS bucket, n_name AS source, count(c_custkey) AS attempted, count(*) FILTER (c_acctbal > 4000) AS selected, count(*) FILTER (c_mktsegment = 'BUILDING') AS uses FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
    e AS (SELECT *, bucket = 0 OR bucket + 7 < 9 OR (bucket + 7 - 9) % 5 = 4 AS explores, -(selected + 1) / (attempted + 4) AS rate FROM p)
    SELECT bucket, CASE WHEN bool_or(explores) THEN arg_min(source, (attempted, uses, selected, source)) ELSE arg_min(source, (rate, uses, selected, attempted, source)) END AS source FROM e GROUP BY bucket"""
)
def chosen_sources(t):
    """Regions as buckets, nations as sources: who is tried next, by fewest attempts or by best acceptance."""
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    pool = customers.groupBy(F.col("n_regionkey").alias("bucket"), F.col("n_name").alias("source")).agg(F.count("*").alias("attempted"), F.count_if(F.col("c_acctbal") > 4000).alias("selected"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("uses"))
    pool = pool.withColumns({"ordinal": F.col("bucket") + 7, "start": F.when(F.col("bucket") > 0, F.lit(9))})
    return selection.choose_source(pool, ["bucket"], "source", "attempted", "selected", "uses", "ordinal", "start")
