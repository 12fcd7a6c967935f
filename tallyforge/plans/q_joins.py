"""Joins, windows, selection and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import joins, selection, sets, windows
from tallyforge.operators import validate as va
from tallyforge.plans.catalog import query
from tallyforge.sources.jsonl import latest_by_id

# -- joins -----------------------------------------------------------------


@query("SELECT g.gold_no, g.id, r.x.p AS result_prediction, r.x.e AS result_error FROM gold_template g LEFT JOIN (SELECT id, arg_max(struct_pack(p := prediction, e := error), result_no) x FROM results GROUP BY id) r USING (id)")
def results_for_questions(t):
    latest = latest_by_id(t.results.select("id", "result_no", "prediction", "error"), "id", "result_no").drop("result_no")
    return joins.with_results(t.gold_template.select("gold_no", "id"), latest, "id").select("gold_no", "id", "result_prediction", "result_error")


@query("SELECT r.result_no, g.gold_skill FROM results r LEFT JOIN (SELECT id, min(gold_skill) gold_skill FROM gold_template WHERE gold_skill IS NOT NULL GROUP BY id HAVING count(*) = 1) g USING (id)")
def optional_gold(t):
    once = t.gold_template.where("gold_skill is not null").groupBy("id").agg(F.min("gold_skill").alias("gold_skill"), F.count("*").alias("n")).where("n = 1").drop("n")
    return joins.with_gold(t.results.select("result_no", "id"), once, "id", "gold_skill", t.results.select(F.col("prediction").alias("gold_skill")).where("gold_skill is not null").unionByName(once.select("gold_skill"))).select("result_no", "gold_skill")


@query("SELECT 'cheap' AS run, o_orderkey AS id, o_totalprice < 100000 AS correct FROM orders UNION ALL SELECT 'open', o_orderkey, o_orderstatus = 'O' FROM orders")
def covered_runs(t):
    cheap = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") < 100000).alias("correct"), "o_orderpriority")
    opened = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").alias("correct"), "o_orderpriority")
    return joins.exact_cover({"cheap": cheap, "open": opened}, "id", ["o_orderpriority"]).select("run", "id", "correct")


@query(
    """WITH x AS (SELECT l_linestatus run, l_returnflag s, l_orderkey k, bool_and(l_discount < 0.08) c FROM lineitem GROUP BY ALL), p AS (SELECT a.run, a.c a, b.c b FROM x a JOIN x b USING (run, k) WHERE a.s = 'A' AND b.s = 'N')
    SELECT run, count(*) AS pairs, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (NOT a AND b) AS right_only FROM p GROUP BY run"""
)
def paired_locales(t):
    long = t.lineitem.groupBy(F.col("l_linestatus").alias("run"), F.col("l_returnflag").alias("subset"), F.col("l_orderkey").alias("id")).agg(F.bool_and(F.col("l_discount") < 0.08).alias("correct"))
    return joins.paired_subsets(long, "run", "subset", "id", "correct", "A", "N").drop("p_value")


@query(
    """SELECT c_mktsegment, round(v, 6) AS value, round(b, 6) AS baseline, CASE WHEN n > 300 THEN round(v - b, 6) END AS difference FROM (SELECT c_mktsegment, avg(c_acctbal) v, count(*) n FROM customer GROUP BY 1), (SELECT avg(s_acctbal) b FROM supplier)"""
)
def gated_baselines(t):
    runs = t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("value"), F.count("*").alias("n")).withColumn("metric", F.lit("balance"))
    base = t.supplier.agg(F.avg("s_acctbal").alias("baseline")).withColumn("metric", F.lit("balance"))
    out = joins.against_baselines(runs, base, ["metric"], "value", "baseline", F.col("n") > 300)
    return out.select("c_mktsegment", *(F.round(c, 6).alias(c) for c in ("value", "baseline", "difference")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def manifest_selection(t):
    ids = t.orders.join(t.orders.where("o_totalprice > 300000").select("o_custkey").distinct(), "o_custkey", "left_semi").select("o_orderkey")
    return joins.select_ids(t.orders.select("o_orderkey", "o_custkey"), ids, "o_orderkey", "o_custkey")


@query("SELECT gold_no, id FROM gold_template WHERE id NOT IN (SELECT id FROM results WHERE error IS NULL AND id IS NOT NULL)")
def pending_questions(t):
    return joins.pending(t.gold_template.select("gold_no", "id"), t.results, "id", F.col("error").isNotNull())


@query(
    """WITH s AS (SELECT result_no, CASE WHEN result_no % 9 = 0 THEN 'other' ELSE payload_sha256 END AS sha, CASE WHEN result_no % 7 = 0 THEN 'x' ELSE api_url END AS url FROM results WHERE result_no % 11 <> 0)
    SELECT result_no, 'unknown source' AS mismatch FROM results WHERE result_no NOT IN (SELECT result_no FROM s) UNION ALL SELECT result_no, 'payload_sha256' FROM results JOIN s USING (result_no) WHERE payload_sha256 IS DISTINCT FROM sha
    UNION ALL SELECT result_no, 'api_url' FROM results JOIN s USING (result_no) WHERE api_url IS DISTINCT FROM url"""
)
def provenance_check(t):
    """Results checked against sources of which some are missing or say something else, in known places."""
    k = F.col("result_no")
    sources = t.results.where(k % 11 != 0).select(k.alias("no"), F.when(k % 9 == 0, "other").otherwise(F.col("payload_sha256")).alias("sha"), F.when(k % 7 == 0, "x").otherwise(F.col("api_url")).alias("url"))
    return joins.provenance_mismatches(t.results.select("result_no", "payload_sha256", "api_url"), sources, "result_no", "no", {"payload_sha256": "sha", "api_url": "url"}).select("result_no", "mismatch")


_TALK = "SELECT a.gold_no AS k, 'Asked: ' || upper(a.id) || coalesce(a.question, '') || ' / ' || coalesce(b.question, '') AS q FROM gold_template a LEFT JOIN gold_template b ON b.gold_no = a.gold_no + 1"


def _talk(t):
    """Texts that quote two questions each."""
    a, b = t.gold_template, t.gold_template.select((F.col("gold_no") - 1).alias("gold_no"), F.col("question").alias("other"))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    return a.join(b, "gold_no", "left").select("gold_no", F.concat(F.lit("Asked: "), F.upper("id"), none("question"), F.lit(" / "), none("other")).alias("q"))


@query(
    f"""WITH n AS (SELECT question, min(gold_no) i FROM gold_template WHERE length(question) >= 6 GROUP BY 1), m AS (SELECT d.k, n.i, length(n.question) l FROM ({_TALK}) d JOIN n ON contains(d.q, n.question))
    SELECT k AS key, arg_min(i, (-l, i)) AS needle_id, max(l)::INT AS length FROM m GROUP BY k"""
)
def longest_question(t):
    return joins.longest_match(_talk(t), "q", t.gold_template, "question", "gold_no", "gold_no", 6)


@query(
    """WITH v AS (SELECT user_id, ts, min(event_id) e FROM events WHERE event_type = 'view' GROUP BY ALL), x AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
    SELECT x.event_id, v.e AS matched_view_id FROM x ASOF LEFT JOIN v ON x.user_id = v.user_id AND x.ts >= v.ts"""
)
def errors_after_views(t):
    calls = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return joins.asof(calls, views, "ts", "view_ts", ["view_id"], ["user_id"], "view_id").select("event_id", "matched_view_id")


@query("SELECT x.event_id, v.event_id AS matched_view_id FROM (SELECT * FROM events WHERE event_type = 'error') x ASOF LEFT JOIN (SELECT ts, min(event_id) event_id FROM events WHERE event_type = 'signup' GROUP BY ts) v ON x.ts >= v.ts")
def errors_after_signups(t):
    calls = t.events.where("event_type = 'error'").select("event_id", "ts")
    views = t.events.where("event_type = 'signup'").select(F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return joins.asof(calls, views, "ts", "view_ts", ["view_id"], tie="view_id").select("event_id", "matched_view_id")


_KEY = "regexp_replace(lower(translate({}, '０１２３４５６７８９', '0123456789')), '[^\\p{{L}}\\p{{N}}]', '', 'g')".format


@query(
    f"""WITH times AS (SELECT id, min(called_at) AS said_at FROM results GROUP BY id),
    q AS (SELECT gold_no, question AS q, {_KEY('question')} AS n, said_at FROM gold_template JOIN times USING (id)),
    c AS (SELECT source_line, said_at, CASE source_line % 3 WHEN 0 THEN 'He asked ' || g.question || '!' WHEN 1 THEN 'He asked: -- ' || upper(regexp_replace(g.question, ' ', '  ', 'g')) || ' --' ELSE 'nothing known' END AS text FROM disagreements d JOIN times USING (id) JOIN gold_template g ON g.gold_no = d.source_line % 500 + 1 WHERE g.question IS NOT NULL),
    raw AS (SELECT source_line, arg_min(gold_no, (-length(x.q), gold_no)) g FROM c JOIN (SELECT q, min(gold_no) gold_no FROM q WHERE length(q) >= 1 GROUP BY q) x ON contains(text, x.q) GROUP BY 1),
    norm AS (SELECT source_line, arg_min(gold_no, (-length(x.n), gold_no)) g FROM (SELECT source_line, {_KEY('text')} AS n FROM c) c JOIN (SELECT n, min(gold_no) gold_no FROM q WHERE length(n) >= 6 GROUP BY n) x ON contains(c.n, x.n) GROUP BY 1),
    near AS (SELECT source_line, x.g FROM c ASOF JOIN (SELECT said_at, min(gold_no) g FROM q WHERE said_at IS NOT NULL GROUP BY said_at) x ON c.said_at >= x.said_at)
    SELECT c.source_line, coalesce(raw.g, norm.g, near.g) AS gold_no, CASE WHEN raw.g IS NOT NULL THEN 'raw' WHEN norm.g IS NOT NULL THEN 'normalised' WHEN near.g IS NOT NULL THEN 'as-of' ELSE 'unmatched' END AS method
    FROM c LEFT JOIN raw USING (source_line) LEFT JOIN norm USING (source_line) LEFT JOIN near USING (source_line)"""
)
def matched_calls(t):
    """Calls attributed to the gold questions, by literal text, normalised text or time; they quote a question, quote it in another spelling, or say nothing of it."""
    at = t.results.groupBy("id").agg(F.min("called_at").alias("at"))
    k, q = F.col("source_line") % 3, F.col("question")
    said = F.when(k == 0, F.concat(F.lit("He asked "), q, F.lit("!"))).when(k == 1, F.concat(F.lit("He asked: -- "), F.upper(F.replace(q, F.lit(" "), F.lit("  "))), F.lit(" --"))).otherwise("nothing known")
    calls = t.disagreements.select("source_line", "id", (F.col("source_line") % 500 + 1).alias("gold_no")).join(at, "id").join(t.gold_template.select("gold_no", "question"), "gold_no").where(q.isNotNull()).select("source_line", said.alias("text"), F.col("at").alias("called_at"))
    questions = t.gold_template.select("gold_no", F.col("question").alias("q"), "id").join(at.withColumnRenamed("at", "asked_at"), "id").drop("id")
    return joins.cascade(calls, questions, "source_line", "text", "q", "gold_no", "called_at", "asked_at")


@query("SELECT n_nationkey AS place, n_name AS name, n_regionkey FROM nation")
def zipped_nations(t):
    left = t.nation.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    right = t.nation.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"), "n_regionkey")
    return joins.positional(left, right, "place", "name")


@query("SELECT arg_min(result_no, result_no) AS result_no, id FROM results GROUP BY id")
def first_results(t):
    return joins.first_wins(t.results.select("result_no", "id"), ["id"], "result_no")


@query("SELECT l_orderkey, l_linenumber, l_quantity, sum(s)::BIGINT AS surplus FROM (SELECT l_orderkey, l_linenumber, l_quantity, 1 AS s FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN least(l_quantity, 20) ELSE l_quantity END, -1 FROM lineitem) GROUP BY ALL HAVING sum(s) <> 0")
def reconstruction_check(t):
    """Lines rebuilt from their orders, with the quantities of every tenth order wrong: the rows by which both differ."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    rebuilt = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines")).select("l_orderkey", F.explode("lines").alias("x"))
    rebuilt = rebuilt.select("l_orderkey", "x.l_linenumber", F.when(F.col("l_orderkey") % 10 == 0, F.least("x.l_quantity", F.lit(20.0))).otherwise(F.col("x.l_quantity")).alias("l_quantity"))
    return joins.same_rows(rows, rebuilt)


_JAC = """WITH s AS (SELECT {k} k, list_sort(list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'))) w FROM {t} WHERE {c} IS NOT NULL), c AS (SELECT min(k) k, w FROM s WHERE len(w) > 0 GROUP BY w),
x AS (SELECT k, len(w) n, unnest(w) u FROM c), p AS (SELECT a.k a, b.k b, count(*) s, any_value(a.n) na, any_value(b.n) nb FROM x a JOIN x b ON a.u = b.u AND a.k < b.k GROUP BY ALL)
SELECT a, b, round(s / (na + nb - s), 9) AS similarity FROM p WHERE s >= 0.8 * (na + nb - s) UNION ALL SELECT c.k, s.k, 1.0 FROM s JOIN c USING (w) WHERE c.k < s.k"""


@query(
    """WITH s AS (SELECT doc_id k, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) w FROM documents WHERE text IS NOT NULL),
    x AS (SELECT k, len(w) n, unnest(w) u FROM s), p AS (SELECT a.k a, b.k b, count(*) s, any_value(a.n) na, any_value(b.n) nb FROM x a JOIN x b ON a.u = b.u AND a.k < b.k GROUP BY ALL)
    SELECT a, b, round(s / (na + nb - s), 9) AS similarity FROM p WHERE s >= 0.8 * (na + nb - s)"""
)
def similar_documents(t):
    """All pairs of documents that are near, copies among them."""
    return joins.jaccard_pairs(t.documents, "doc_id", "text", copies=True).withColumn("similarity", F.round("similarity", 9))


@query(_JAC.format(k="gold_no", c="question", t="gold_template"))
def similar_questions(t):
    return joins.jaccard_pairs(t.gold_template, "gold_no", "question").withColumn("similarity", F.round("similarity", 9))


@query("SELECT r.result_no, g.skill FROM results r LEFT JOIN (SELECT DISTINCT id, payload_sha256, first(baseline_skill ORDER BY source_line) OVER (PARTITION BY id, payload_sha256 ORDER BY source_line) skill FROM disagreements) g ON r.id = g.id AND r.payload_sha256 = g.payload_sha256")
def gold_for_unchanged(t):
    gold = t.disagreements.groupBy("id", "payload_sha256").agg(F.min_by("baseline_skill", "source_line").alias("skill"))
    return joins.gated_gold(t.results.select("result_no", "id", "payload_sha256"), gold, "id", "payload_sha256", "skill").select("result_no", "skill")


@query("SELECT count(*) AS current FROM disagreements d SEMI JOIN (SELECT DISTINCT id, payload_sha256 FROM results) r ON d.id = r.id AND d.payload_sha256 = r.payload_sha256")
def current_results(t):
    return va.current_results(t.disagreements, t.results).agg(F.count("*").alias("current"))


# -- windows ---------------------------------------------------------------


@query("SELECT event_id, CASE WHEN lead(event_id) OVER w IS NULL THEN 'summary' ELSE 'exec #' || row_number() OVER w END AS role FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def call_roles(t):
    return windows.call_roles(t.events, "user_id", "ts", "event_id").select("event_id", "role")


_Q = "(SELECT event_id, CASE WHEN user_id % 7 > 0 THEN user_id END q, event_type, ts FROM events)"


@query(f"SELECT event_id, coalesce(q::VARCHAR, 'UNMATCHED') AS question, row_number() OVER (PARTITION BY q, event_type ORDER BY ts, event_id) AS occurrence FROM {_Q}")
def stage_occurrences(t):
    rows = t.events.select("event_id", F.when(F.col("user_id") % 7 > 0, F.col("user_id")).alias("question"), "event_type", "ts")
    return windows.occurrences(rows, "question", "event_type", "ts", "event_id").select("event_id", "question", "occurrence")


@query("SELECT event_id, round(value - lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY value, event_id), 6) AS latency FROM events")
def chunk_latencies(t):
    return windows.inter_arrival(t.events, "user_id", "value", "event_id").select("event_id", F.round("latency", 6).alias("latency"))


@query("SELECT user_id, count(value) AS chunks, min(value) AS ttft, round((max(value) - min(value)) / nullif(count(value) - 1, 0), 9) AS mean_interval FROM events GROUP BY user_id")
def output_intervals(t):
    return windows.output_intervals(t.events, "user_id", "value").withColumn("mean_interval", F.round("mean_interval", 9))


@query("SELECT p_partkey, CASE WHEN (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 2 = 0 THEN 'c2d' ELSE 'd2c' END AS method FROM part")
def alternating_methods(t):
    return windows.alternation(t.part, "p_brand", "p_partkey").select("p_partkey", "method")


@query("SELECT p_partkey, turn FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('5:' || p_partkey), p_partkey) AS turn FROM part) ORDER BY turn, p_brand, p_partkey LIMIT 60")
def round_robin_parts(t):
    return windows.round_robin(t.part, "p_brand", selection.hash_order(F.col("p_partkey"), 5), 60, "p_partkey").select("p_partkey", F.col("turn").cast("long").alias("turn"))


@query("SELECT o_orderkey, string_agg(o_orderpriority, '>') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prefix FROM orders")
def turn_prefixes(t):
    return windows.prefixes(t.orders, "o_custkey", "o_orderkey", "o_orderpriority", ">").select("o_orderkey", "prefix")


@query("SELECT event_id, count(*) OVER w AS rolling_count, round(sum(value) OVER w, 6) AS rolling_amount FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)")
def rolling_minute(t):
    return windows.rolling_budget(t.events, "ts", "value").select("event_id", "rolling_count", F.round("rolling_amount", 6).alias("rolling_amount"))


@query("SELECT event_id, round((coalesce(sum((event_type = 'purchase')::INT) OVER w, 0) + 1) / (count(*) OVER w + 4), 9) AS acceptance, event_id % 5 = 4 AS explores FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def acceptance_trend(t):
    return windows.acceptance_trend(t.events, "user_id", "event_id", F.col("event_type") == "purchase").select("event_id", F.round("acceptance", 9).alias("acceptance"), "explores")


# -- selection -------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('17:' || o_orderkey), o_orderkey LIMIT 500")
def simple_sample(t):
    return selection.simple_sample(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 17)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 5")
def first_orders(t):
    return selection.first_rows(t.orders.select("o_orderkey"), "o_orderkey", 25, 5)


@query(
    """WITH c AS (SELECT DISTINCT c_mktsegment o, c_nationkey n FROM customer), p AS (SELECT o, n, dense_rank() OVER (ORDER BY o) - 1 i, row_number() OVER (PARTITION BY o ORDER BY n) - 1 j, count(*) OVER (PARTITION BY o) m FROM c),
    q AS (SELECT o, n, 40 // m + (((j - i) % m + m) % m < 40 % m)::INT quota FROM p), r AS (SELECT c_custkey, c_mktsegment o, c_nationkey n, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY sha256('3:' || c_custkey), c_custkey) k FROM customer)
    SELECT c_custkey FROM r JOIN q USING (o, n) WHERE k <= quota"""
)
def stratified_customers(t):
    return selection.stratified_sample(t.customer, "c_mktsegment", "c_nationkey", "c_custkey", 40, 3).select("c_custkey")


@query(
    """WITH f AS (SELECT o_custkey f, min(o_orderpriority) d, count(*) n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY sha256('9:' || f), f) k FROM f), s AS (SELECT f, sum(n) OVER (ORDER BY k, d, f) u FROM r)
    SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT f FROM s WHERE u <= 700)"""
)
def family_sample(t):
    return selection.family_sample(t.orders, "o_custkey", "o_orderpriority", 700, 9).select("o_orderkey")


@query(
    """SELECT ['a', 'b', 'c'][i % 3 + 1] AS domain, ['choice', 'noul', 'score'][(i // 3 + i % 3) % 3 + 1] AS kind, count(*) AS quota FROM range(100) t(i) GROUP BY ALL"""
)
def dealt_quotas(t):
    return selection.quotas(t.spark, ["a", "b", "c"], ["choice", "noul", "score"], 100)


@query("SELECT c_nationkey, arg_min(c_mktsegment, (n, c_mktsegment)) AS c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, count(*) n FROM customer GROUP BY ALL) GROUP BY 1")
def least_used_segment(t):
    return selection.least_used(t.customer.groupBy("c_nationkey", "c_mktsegment").count(), ["c_nationkey"], "c_mktsegment", "count")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20")
def top_customers(t):
    return selection.top_by(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 20)


@query("""SELECT row_number() OVER (ORDER BY sha256('{"n_name":"' || n_name || '"}')) AS place, n_name FROM nation""")
def blind_nations(t):
    return selection.label_blind_order(t.nation.select("n_name"), "n_name")


# -- sets ------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_custkey FROM orders")
def united_releases(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"))
    return sets.union_releases([rows.where("id % 2 = 0"), rows.where("id % 2 = 1")], "id", "sha").drop("sha")


_TV = "(SELECT DISTINCT {c} v FROM decision_records WHERE lower(trim(split)) {s} AND {c} IS NOT NULL)"


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", v AS value FROM ({_TV.format(c=c, s="= 'train'")} INTERSECT {_TV.format(c=c, s="IN ('validation', 'eval', 'test')")})""" for c in ("id", "family", "source_family")))
def shared_values(t):
    split = F.lower(F.trim("split"))
    return sets.overlaps(t.decision_records.where(split == "train"), t.decision_records.where(split.isin("validation", "eval", "test")), ["id", "family", "source_family"])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'outer' WHEN o_custkey % 10 = 1 THEN 'inner' ELSE 'training' END AS part FROM orders")
def family_partition(t):
    ids = t.orders.select("o_custkey").distinct()
    parts = sets.split_families(t.orders, "o_custkey", ids.where("o_custkey % 10 = 0"), ids.where("o_custkey % 10 = 1"))
    out = None
    for name in ("outer", "inner", "training"):
        part = parts[name].select("o_orderkey", F.lit(name).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT id, CASE WHEN g THEN 'missing' ELSE 'extra' END AS state FROM (SELECT id, bool_or(g) g, bool_or(r) r FROM (SELECT id, true g, false r FROM gold_template UNION ALL SELECT id, false, true FROM results) GROUP BY id) WHERE g <> r")
def id_differences(t):
    return sets.id_differences(t.gold_template, t.results, "id")


@query("SELECT source_line FROM disagreements WHERE baseline_skill IS DISTINCT FROM json_extract_string(result, '$.prediction')")
def disagreement_rows(t):
    rows = t.disagreements.select("source_line", "baseline_skill", F.get_json_object("result", "$.prediction").alias("prediction"))
    return sets.disagreements(rows, "baseline_skill", "prediction").select("source_line")


@query("SELECT min(record_no) AS record_no FROM decision_records GROUP BY coalesce(sha256(input.state), '-')")
def unique_states(t):
    rows = t.decision_records.select("record_no", F.col("input.state").alias("state"))
    return sets.unique_inputs(rows, F.coalesce(F.sha2("state", 256), F.lit("-")), "record_no")[0].select("record_no")


@query("SELECT sha256(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ')) AS digest, min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_documents(t):
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0), " ")
    return sets.repeated_inputs(t.documents.where("text is not null"), F.sha2(words, 256), "doc_id")
