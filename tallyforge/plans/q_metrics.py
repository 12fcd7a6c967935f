"""Latency, agreement, accuracy, calibration and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.functions.parse import valid_number
from tallyforge.operators import aggregates as ag
from tallyforge.operators import latency
from tallyforge.operators.joins import run_pairs
from tallyforge.plans.catalog import query

_R = lambda *names: [F.round(n, 9).alias(n) for n in names]
_V = "{0} IS NOT NULL AND NOT isnan({0}) AND NOT isinf({0}) AND {0} >= 0"
_OK = _V.format("latency_ms")


@query(
    f"""WITH x AS (SELECT api_url, CASE WHEN {_OK} THEN latency_ms END v FROM results UNION ALL SELECT 'all', CASE WHEN {_OK} THEN latency_ms END FROM results)
    SELECT api_url, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS p50, quantile_disc(v, 0.95) AS p95 FROM x GROUP BY api_url"""
)
def latency_summary(t):
    rows = latency.latency_nearest(latency.with_total(t.results.select("api_url", "latency_ms"), "api_url"), "latency_ms", ["api_url"])
    return rows.select("api_url", "n", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), "p95")


@query(f"SELECT raw_response.model AS model, count(*) FILTER ({_OK}) AS n, round(avg(latency_ms) FILTER ({_OK}), 6) AS mean, quantile_disc(latency_ms, 0.5) FILTER ({_OK}) AS p50, quantile_disc(latency_ms, 0.95) FILTER ({_OK}) AS p95 FROM results GROUP BY 1")
def latency_nearest_rank(t):
    rows = latency.latency_nearest_both(t.results.select(F.col("raw_response.model").alias("model"), "latency_ms"), "latency_ms", ["model"])
    return rows.withColumn("mean", F.round("mean", 6))


_B = _V.format("baseline_latency_ms")


@query(
    f"""SELECT phase, count(*) AS n, min(baseline_latency_ms) AS min, max(baseline_latency_ms) AS max, round(avg(baseline_latency_ms), 6) AS mean, round(median(baseline_latency_ms), 6) AS median,
    round(quantile_cont(baseline_latency_ms, 0.95), 6) AS p95 FROM disagreements WHERE {_B} GROUP BY phase"""
)
def latency_interpolated(t):
    rows = latency.latency_linear(t.disagreements.where(valid_number(F.col("baseline_latency_ms"))), "baseline_latency_ms", ["phase"])
    return rows.select("phase", "n", "min", "max", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95")))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
    round(1000 / avg(value), 6) AS per_second FROM events GROUP BY event_type"""
)
def latency_throughput(t):
    rows = latency.throughput(t.events, "value", ["event_type"])
    return rows.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99", "per_second")))


@query("SELECT count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE event_type <> 'signup'")
def latency_without_warmup(t):
    rows = t.events.withColumn("phase", F.when(F.col("event_type") == "signup", "warmup").otherwise("measured"))
    out = latency.latency_linear(latency.without_warmup(rows), "value")
    return out.select("n", "min", "max", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95")))


@query(f"SELECT api_url, count(*) FILTER ({_OK}) AS latency_count, round(coalesce(sum(latency_ms) FILTER ({_OK}), 0), 4) AS latency_total, round(avg(latency_ms) FILTER ({_OK}), 6) AS latency_mean FROM results GROUP BY api_url")
def valid_metrics(t):
    rows = t.results.groupBy("api_url").agg(*ag.metric(F.col("latency_ms"), "latency"))
    return rows.select("api_url", "latency_count", F.round("latency_total", 4).alias("latency_total"), F.round("latency_mean", 6).alias("latency_mean"))



def _latest(t):
    return t.results.groupBy("id").agg(F.max_by(F.struct("prediction", "error"), "result_no").alias("r")).select("id", "r.prediction", "r.error")


@query(
    f"""SELECT phase, count(*) AS rows, count(baseline_skill) AS comparable, count(*) FILTER (g AND coalesce(baseline_skill = prediction, false)) AS agreed,
    round(avg((g AND coalesce(baseline_skill = prediction, false))::INT) FILTER (baseline_skill IS NOT NULL), 9) AS agreement, count(*) FILTER (g) AS successes, round(avg((baseline_skill = prediction)::INT) FILTER (g), 9) AS agreement_success_only
    FROM (SELECT d.phase, d.baseline_skill, r.x.p AS prediction, r.x.e IS NULL AND r.x.p IS NOT NULL AND d.baseline_skill IS NOT NULL g FROM disagreements d LEFT JOIN (SELECT id, arg_max(struct_pack(p := prediction, e := error), result_no) x FROM results GROUP BY id) r USING (id)) GROUP BY phase"""
)
def agreement_by_phase(t):
    rows = t.disagreements.select("id", "phase", "baseline_skill").join(_latest(t), "id", "left")
    return ag.agreement(rows, ["phase"], "baseline_skill", "prediction", F.col("error").isNotNull()).select("phase", "rows", "comparable", "agreed", *_R("agreement"), "successes", *_R("agreement_success_only"))


@query("SELECT d.baseline_skill AS baseline, coalesce(r.p, '__error_or_missing__') AS prediction, count(*) AS n FROM disagreements d LEFT JOIN (SELECT id, arg_max(struct_pack(p := prediction), result_no).p p FROM results GROUP BY id) r USING (id) GROUP BY ALL")
def confusion_matrix(t):
    return ag.confusion(t.disagreements.select("id", "baseline_skill").join(_latest(t), "id", "left"), "baseline_skill", "prediction")


_NOUL = "(SELECT lower(trim(split)) sp, reference.target = 'true' truth, reference.distribution['true'] > 0.5 said FROM decision_records WHERE input.questions['decision'].type = 'noul')"


@query(f"SELECT sp AS split, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (NOT truth AND NOT said) AS tn, count(*) FILTER (truth AND NOT said) AS fn FROM {_NOUL} GROUP BY sp")
def binary_confusion(t):
    rows = t.decision_records.where(F.col("input.questions")["decision"]["type"] == "noul").select(F.lower(F.trim("split")).alias("split"), (F.col("reference.target") == "true").alias("truth"), (F.col("reference.distribution")["true"] > 0.5).alias("said"))
    return rows.groupBy("split").agg(*ag.binary_confusion(F.col("truth"), F.col("said")))


@query(
    """SELECT phase, count(*) AS n, round(avg(coalesce(b = p, false)::INT), 9) AS strict, round(avg(coalesce(b = p OR p = 'none_of_these', false)::INT), 9) AS lenient
    FROM (SELECT phase, baseline_skill b, json_extract_string(result, '$.prediction') p FROM disagreements) GROUP BY phase"""
)
def cost_sensitive_accuracy(t):
    rows = t.disagreements.select("phase", F.col("baseline_skill").alias("b"), F.get_json_object("result", "$.prediction").alias("p"))
    return rows.groupBy("phase").agg(F.count("*").alias("n"), F.round(stats.rate(F.coalesce(F.col("b") == F.col("p"), F.lit(False))), 9).alias("strict"), F.round(stats.rate(ag.cost_sensitive(F.col("b"), F.col("p"), "none_of_these")), 9).alias("lenient"))


_SUITE = "(SELECT l_returnflag AS source, l_linestatus AS type, l_quantity > 20 AS correct, CASE WHEN l_tax > 0.07 THEN 'e' END AS error, CASE WHEN l_linestatus = 'O' THEN abs(l_discount - l_tax) END AS ae FROM lineitem)"


@query(
    f"""WITH s AS {_SUITE}, g AS (SELECT 'all' AS grouping, 'all' AS key, correct, error, ae FROM s UNION ALL SELECT 'source', source, correct, error, ae FROM s UNION ALL SELECT 'type', type, correct, error, ae FROM s)
    SELECT grouping, key, count(*) AS n, count(error) AS errors, round(avg((correct AND error IS NULL)::INT), 9) AS accuracy, round(avg(correct::INT) FILTER (error IS NULL), 9) AS accuracy_success_only, round(avg(ae), 9) AS score_mae, count(ae) AS score_n FROM g GROUP BY ALL"""
)
def question_metrics(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("type"), (F.col("l_quantity") > 20).alias("correct"), F.when(F.col("l_tax") > 0.07, "e").alias("error"), F.when(F.col("l_linestatus") == "O", F.abs(F.col("l_discount") - F.col("l_tax"))).alias("ae"))
    out = ag.grouped(rows, ["source", "type"], ag.question_metrics(F.col("correct"), F.col("error"), F.col("ae")))
    return out.select("grouping", "key", "n", "errors", *_R("accuracy", "accuracy_success_only", "score_mae"), "score_n")


_FAM = "(SELECT l_orderkey f, l_linestatus l, l_returnflag <> 'R' c FROM lineitem)"


def _families(t):
    return t.lineitem.select(F.col("l_orderkey").alias("f"), F.col("l_linestatus").alias("l"), (F.col("l_returnflag") != "R").alias("c"))


@query(f"SELECT count(*) AS families, round(avg(a), 9) AS family_balanced_accuracy FROM (SELECT f, avg(a) a FROM (SELECT f, l, avg(c::INT) a FROM {_FAM} GROUP BY f, l) GROUP BY f)")
def family_balanced_accuracy(t):
    return ag.family_balanced(_families(t), "f", "l", "c").select("families", *_R("family_balanced_accuracy"))


@query(f"SELECT count(*) AS families, count(*) FILTER (a) AS complete, round(avg(a::INT), 9) AS complete_rate FROM (SELECT f, bool_and(c) a FROM {_FAM} GROUP BY f)")
def family_complete_accuracy(t):
    return ag.family_complete(_families(t), "f", "c").select("families", "complete", *_R("complete_rate"))


@query(f"SELECT size, count(*) AS families FROM (SELECT count(*) size FROM {_FAM} GROUP BY f) GROUP BY size")
def family_size_histogram(t):
    return ag.family_sizes(_families(t), "f")


@query("WITH p AS (SELECT l_orderkey f, l_quantity > 25 c FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 2)) SELECT count(*) AS families, count(*) FILTER (a) AS complete, round(avg(a::INT), 9) AS complete_rate FROM (SELECT f, bool_and(c) a FROM p GROUP BY f)")
def pair_complete_accuracy(t):
    pairs = t.lineitem.groupBy("l_orderkey").count().where("count = 2")
    rows = t.lineitem.join(pairs, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("f"), (F.col("l_quantity") > 25).alias("c"))
    return ag.family_complete(rows, "f", "c", size=2).select("families", "complete", *_R("complete_rate"))


_WILSON = "(p + {z}*{z}/(2*n) {s} {z}*sqrt(p*(1-p)/n + {z}*{z}/(4*n*n))) / (1 + {z}*{z}/n)"


@query(f"SELECT l_returnflag, l_linestatus, n, correct, round(p, 9) AS accuracy, round({_WILSON.format(z=1.96, s='-')}, 9) AS low, round({_WILSON.format(z=1.96, s='+')}, 9) AS high FROM (SELECT l_returnflag, l_linestatus, count(*) n, count(*) FILTER (l_discount < 0.05) correct, correct / n p FROM lineitem GROUP BY ALL)")
def accuracy_with_interval(t):
    rows = ag.accuracy_block(t.lineitem.withColumn("c", F.col("l_discount") < 0.05), ["l_returnflag", "l_linestatus"], "c")
    return rows.select("l_returnflag", "l_linestatus", "n", "correct", *_R("accuracy", "low", "high"))


@query(
    """WITH x AS (SELECT l_quantity > 25 a, l_discount > 0.05 b, l_tax > 0.04 c FROM lineitem),
    p AS (SELECT 'a' AS left, 'b' AS right, a l, b r FROM x UNION ALL SELECT 'a', 'c', a, c FROM x UNION ALL SELECT 'b', 'c', b, c FROM x),
    k AS (SELECT "left", "right", count(*) FILTER (l AND r) AS both, count(*) FILTER (NOT l AND NOT r) AS neither, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (NOT l AND r) AS right_only FROM p GROUP BY ALL)
    SELECT *, round(CASE WHEN left_only + right_only = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(left_only, right_only) + 1), lambda i: exp(lgamma(left_only + right_only + 1) - lgamma(i + 1) - lgamma(left_only + right_only - i + 1) - (left_only + right_only) * ln(2))))) END, 6) AS p_value FROM k"""
)
def paired_runs(t):
    runs = F.explode(F.create_map(F.lit("a"), F.col("l_quantity") > 25, F.lit("b"), F.col("l_discount") > 0.05, F.lit("c"), F.col("l_tax") > 0.04))
    numbered = t.lineitem.withColumn("id", F.monotonically_increasing_id())
    out = run_pairs(numbered.select("id", runs.alias("run", "correct")), "id", "run", "correct")
    return out.select("left", "right", "both", "neither", "left_only", "right_only", F.round("p_value", 6).alias("p_value"))


_BIN = " + ".join(f"(p >= {i / 10})::INT" for i in range(1, 10))
_CAL = "(SELECT l_linestatus s, least(1.0, l_discount * 10) p, l_returnflag = 'R' y FROM lineitem)"


def _calibration(t):
    return t.lineitem.select(F.col("l_linestatus").alias("s"), F.least(F.lit(1.0), F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").alias("y"))


@query(f"SELECT s, sum(n)::BIGINT AS n, round(sum(abs(g)) / sum(n), 9) AS ece FROM (SELECT s, {_BIN} b, count(*) n, sum(p - y::INT) g FROM {_CAL} GROUP BY ALL) GROUP BY s")
def calibration_error(t):
    return ag.calibration_error(_calibration(t), "p", "y", ["s"]).select("s", "n", *_R("ece"))


@query(f"SELECT {_BIN} AS bin, count(*) AS n, round(avg(p), 9) AS confidence, round(avg(y::INT), 9) AS accuracy FROM {_CAL} GROUP BY 1")
def calibration_bins(t):
    return ag.calibration_bins(_calibration(t), "p", "y").select("bin", "n", *_R("confidence", "accuracy"))


@query(
    f"""WITH c AS {_CAL}, r AS (SELECT s, y, rank() OVER (PARTITION BY s ORDER BY p) + (count(*) OVER (PARTITION BY s, p) - 1) / 2 k FROM c)
    SELECT s, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS auroc FROM r GROUP BY s"""
)
def auroc_by_status(t):
    return ag.auroc(_calibration(t), "p", "y", ["s"]).select("s", F.col("positives").cast("long"), F.col("negatives").cast("long"), *_R("auroc"))


_ANS = "(SELECT result_no, raw_response.model m, prediction, raw_response.answers['skill'].probabilities q FROM results WHERE raw_response.answers['skill'].probabilities IS NOT NULL AND prediction IS NOT NULL)"


def _answers(t):
    q = F.col("raw_response.answers")["skill"]["probabilities"]
    rows = t.results.where(q.isNotNull() & F.col("prediction").isNotNull()).select("result_no", F.col("raw_response.model").alias("model"), "prediction", F.array_sort(F.map_entries(q)).alias("e"))
    p = F.transform("e", lambda x: x["value"])
    reference = (F.array_position(F.transform("e", lambda x: x["key"]), F.col("prediction")) - 1).cast("int")
    return rows.select("result_no", "model", p.alias("p"), reference.alias("reference")).where("reference >= 0")


@query(
    f"""WITH e AS (SELECT result_no, m, prediction, unnest(map_keys(q)) k, unnest(map_values(q)) v FROM {_ANS}),
    r AS (SELECT result_no, any_value(m) model, max(v) FILTER (k = prediction) rp, max(v) top, sum(pow(v - (k = prediction)::INT, 2)) brier, arg_max(k, (v, -rank)) = any_value(prediction) correct FROM (SELECT *, row_number() OVER (PARTITION BY result_no ORDER BY k) rank FROM e) GROUP BY result_no HAVING max(v) FILTER (k = prediction) IS NOT NULL)
    SELECT model, count(*) AS n, round(avg(correct::INT), 9) AS accuracy, round(avg(top), 9) AS top_probability, round(avg(-ln(greatest(rp, 1e-15))), 9) AS negative_log_likelihood, round(avg(brier), 9) AS multiclass_brier, count(*) FILTER (rp = 0) AS zero_probability FROM r GROUP BY model"""
)
def answer_scores(t):
    rows = _answers(t).select("model", *ag.assess(F.col("p"), F.col("reference"), F.lit("choice")))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(stats.rate(F.col("correct")), 9).alias("accuracy"), *(F.round(ag.complete_mean(F.col(c)), 9).alias(c) for c in ("top_probability", "negative_log_likelihood", "multiclass_brier")), F.count_if(F.col("reference_probability") == 0).alias("zero_probability"))


@query(
    """WITH g AS (SELECT event_type, count(*) / sum(count(*)) OVER () q FROM events GROUP BY 1), c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL),
    p AS (SELECT u.user_id, g.event_type, g.q, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY u.user_id) p FROM (SELECT DISTINCT user_id FROM events) u, g LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = g.event_type)
    SELECT user_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 9) AS entropy_bits, round(sum(abs(p - q)) / 2, 9) AS total_variation, round(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 9) AS jensen_shannon_bits FROM p GROUP BY user_id"""
)
def user_divergence(t):
    kinds = t.events.groupBy("event_type").count()
    whole = kinds.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))  # one row: as many entries as event types
    options = F.array_sort(F.map_keys("all"))
    counts = t.events.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("own"))
    m = whole.first()["m"]
    every = F.create_map(*(F.lit(x) for kv in sorted(m.items()) for x in kv)).alias("all")
    of = lambda c: stats.normalise(F.transform(options, lambda k: F.coalesce(F.try_element_at(F.col(c), k), F.lit(0)).cast("double")))
    rows = counts.select("user_id", "own", every).select("user_id", of("own").alias("p"), of("all").alias("q"))
    p, q = F.col("p"), F.col("q")
    return rows.select("user_id", F.round(stats.entropy(p), 9).alias("entropy_bits"), F.round(stats.total_variation(p, q), 9).alias("total_variation"), F.round(stats.jensen_shannon(p, q), 9).alias("jensen_shannon_bits"))


_MM = "(SELECT l_linestatus run, l_returnflag subset, CASE WHEN l_quantity > 25 THEN 'choice' ELSE 'noul' END type, l_discount < 0.06 c FROM lineitem)"


@query(
    f"""WITH x AS {_MM}, y AS (SELECT * FROM x UNION ALL SELECT run, subset, 'all', c FROM x), z AS (SELECT run, type, subset, count(*) n, count(*) FILTER (c) k FROM y GROUP BY ALL)
    SELECT run, type, count(*) AS subsets, round(avg(k / n), 9) AS macro, round(sum(k) / sum(n), 9) AS micro FROM z GROUP BY ALL"""
)
def suite_averages(t):
    rows = t.lineitem.select(F.col("l_linestatus").alias("run"), F.col("l_returnflag").alias("subset"), F.when(F.col("l_quantity") > 25, "choice").otherwise("noul").alias("kind"), (F.col("l_discount") < 0.06).alias("c"))
    return ag.macro_micro(rows, "subset", "c", "run", "kind").select("run", "type", "subsets", *_R("macro", "micro"))


@query(
    """WITH e AS (SELECT record_no, reference.target t, unnest(map_keys(reference.distribution)) k, unnest(map_values(reference.distribution)) v FROM decision_records WHERE input.questions['decision'].type = 'score' AND reference.target IS NOT NULL),
    r AS (SELECT record_no, abs(sum(k::DOUBLE * v) - any_value(t)::DOUBLE) ae FROM e GROUP BY record_no) SELECT count(*) AS n, round(avg(ae), 9) AS score_mae FROM r"""
)
def score_error(t):
    rows = t.decision_records.where((F.col("input.questions")["decision"]["type"] == "score") & F.col("reference.target").isNotNull() & (F.size("reference.distribution") > 0))
    expected = F.aggregate(F.map_entries("reference.distribution"), F.lit(0.0), lambda acc, e: acc + e["key"].cast("double") * e["value"])
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(expected - F.col("reference.target").cast("double"))), 9).alias("score_mae"))


@query(
    """SELECT coalesce(list_position(json_keys(input.questions['decision'].criteria), json_extract_string(reference.target, '$')), 0)::BIGINT AS position, count(*) AS n FROM decision_records
    WHERE input.questions['decision'].type = 'choice' AND reference.target IS NOT NULL GROUP BY 1"""
)
def target_positions(t):
    q = F.col("input.questions")["decision"]
    rows = t.decision_records.where((q["type"] == "choice") & F.col("reference.target").isNotNull())
    return ag.position_counts(rows, F.json_object_keys(q["criteria"]), F.get_json_object(F.col("reference.target"), "$"))


@query(
    """WITH a AS (SELECT id, arg_min(struct_pack(q := raw_response.answers['skill'].probabilities, p := prediction), result_no) x, arg_max(struct_pack(q := raw_response.answers['skill'].probabilities, p := prediction), result_no) y FROM results GROUP BY id HAVING count(*) > 1),
    e AS (SELECT id, x.p pa, y.p pb, y.q qb, unnest(map_keys(x.q)) k, unnest(map_values(x.q)) v FROM a), d AS (SELECT id, abs(v - qb[k]) d, pa <> pb f FROM e WHERE qb[k] IS NOT NULL)
    SELECT count(DISTINCT id) AS rows, round(max(d), 9) AS max_difference, round(avg(d), 9) AS mean_difference, count(DISTINCT id) FILTER (f) AS flips FROM d"""
)
def rerun_drift(t):
    row = F.struct(F.col("raw_response.answers")["skill"]["probabilities"].alias("q"), F.col("prediction").alias("p"))
    both = t.results.groupBy("id").agg(F.min_by(row, "result_no").alias("x"), F.max_by(row, "result_no").alias("y"), F.count("*").alias("n")).where("n > 1")
    out = ag.drift(both.select("id", "x.*"), both.select("id", "y.*"), "id", "q", "p")
    return out.select("rows", *_R("max_difference", "mean_difference"), "flips")


@query(
    """SELECT event_type, round(median(value) FILTER (k = 'slow'), 6) AS slow, round(median(value) FILTER (k = 'fast'), 6) AS fast, round(median(value) FILTER (k = 'slow') / median(value) FILTER (k = 'fast'), 6) AS fast_speedup
    FROM (SELECT event_type, value, CASE WHEN user_id % 2 = 0 THEN 'slow' ELSE 'fast' END k FROM events) GROUP BY event_type"""
)
def mode_speedups(t):
    rows = t.events.withColumn("mode", F.when(F.col("user_id") % 2 == 0, "slow").otherwise("fast"))
    out = ag.speedups(rows, ["event_type"], "mode", "value", "slow", ["fast"])
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("slow", "fast", "fast_speedup")))


@query(
    """WITH n AS (SELECT max(raw_response.usage.input_tokens) i, max(raw_response.usage.output_tokens) o FROM results WHERE id IS NOT NULL GROUP BY id UNION ALL SELECT raw_response.usage.input_tokens, raw_response.usage.output_tokens FROM results WHERE id IS NULL)
    SELECT count(*) AS responses, coalesce(sum(i), 0)::BIGINT AS input_tokens, coalesce(sum(o), 0)::BIGINT AS output_tokens, round(sum(i * 4.0 + o * 20.0) / 1e6, 6) AS cost FROM n"""
)
def token_cost(t):
    rows = t.results.select("id", F.col("raw_response.usage.input_tokens").alias("i"), F.col("raw_response.usage.output_tokens").alias("o"))
    return ag.usage_cost(rows, "id", "i", "o", 4.0, 20.0).withColumn("cost", F.round("cost", 6))


@query(f"SELECT api_url, round(sum(CASE WHEN {_OK} THEN latency_ms ELSE 500.0 END), 4) AS charged FROM results GROUP BY api_url")
def charged_or_reserved(t):
    return t.results.groupBy("api_url").agg(F.round(F.sum(ag.charged_or_reserved(F.col("latency_ms"), F.lit(500.0))), 4).alias("charged"))


@query(
    """WITH s AS (SELECT event_type AS stage, value FROM events UNION ALL SELECT 'total', value FROM events) SELECT stage, count(*) AS calls, round(coalesce(sum(value), 0), 6) AS value_sum, round(coalesce(avg(value), 0), 6) AS value_mean, round(coalesce(sum(value), 0) / 60, 6) AS value_per_question FROM s GROUP BY stage"""
)
def stage_rollup(t):
    out = ag.stage_rollup(t.events.withColumnRenamed("event_type", "stage"), "stage", ["value"], 60)
    return out.select("stage", "calls", *(F.round(c, 6).alias(c) for c in ("value_sum", "value_mean", "value_per_question")))


@query(
    f"""SELECT 'rows' AS "check", count(*) AS n FROM results UNION ALL SELECT 'failed', count(*) FILTER (error IS NOT NULL) FROM results UNION ALL SELECT 'with usage', count(*) FILTER (raw_response.usage IS NOT NULL) FROM results
    UNION ALL SELECT 'valid latency', count(*) FILTER ({_OK}) FROM results UNION ALL SELECT 'late log', count(*) FILTER (logged_at > called_at + INTERVAL 1 DAY) FROM results"""
)
def quality_checklist(t):
    return ag.checklist(t.results, {"rows": F.lit(True), "failed": F.col("error").isNotNull(), "with usage": F.col("raw_response.usage").isNotNull(), "valid latency": valid_number(F.col("latency_ms")), "late log": F.col("logged_at") > F.col("called_at") + F.expr("INTERVAL 1 DAY")})


@query(
    """WITH s AS (SELECT user_id, list_distinct(list(event_type)) seen FROM (SELECT user_id, date_trunc('day', ts) d, event_type FROM events) GROUP BY user_id)
    SELECT user_id, list_filter(['view', 'click', 'purchase', 'refund'], lambda x: NOT list_contains(seen, x)) AS missing, len(list_filter(['view', 'click', 'purchase', 'refund'], lambda x: NOT list_contains(seen, x))) = 0 AS complete FROM s"""
)
def stage_completeness(t):
    return ag.missing_stages(t.events, "user_id", "event_type", ["view", "click", "purchase", "refund"])


@query("SELECT user_id, string_agg(event_type || '×' || n, ' + ' ORDER BY first) AS label FROM (SELECT user_id, event_type, count(*) n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def tool_labels(t):
    return ag.multiset_label(t.events, "user_id", "event_type", "event_id")


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_size, p_partkey)) AS best FROM part GROUP BY p_brand")
def best_candidates(t):
    return t.part.groupBy("p_brand").agg(ag.best_candidate(F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")).alias("best"))


@query("SELECT c_custkey, count(o_orderkey) AS calls, round(coalesce(sum(o_totalprice), 0), 4) AS o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def customer_totals(t):
    return ag.entity_totals(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT id, CASE WHEN NOT bool_or(error IS NOT NULL) THEN count(DISTINCT prediction) = 1 END AS agree FROM results GROUP BY id")
def reruns_agree(t):
    return t.results.groupBy("id").agg(ag.all_agree(F.col("prediction"), F.col("error")).alias("agree"))


@query("SELECT min(event_id) AS first_over FROM (SELECT event_id, sum(value) OVER (ORDER BY event_id) s FROM events) WHERE s > 50000.005")
def budget_breach(t):
    return ag.budget_breach(t.events, "event_id", "value", 50000.005)


@query("SELECT lang, min(w)::INT AS least, max(w)::INT AS most FROM (SELECT lang, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) w FROM documents WHERE text IS NOT NULL) GROUP BY lang")
def word_ranges(t):
    w = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0))
    return t.documents.where("text is not null").groupBy("lang").agg(F.min(w).alias("least"), F.max(w).alias("most"))


@query("SELECT 'domain' AS facet, domain AS value, count(*) AS n FROM decision_records GROUP BY 2 UNION ALL SELECT 'split', split, count(*) FROM decision_records GROUP BY 2 UNION ALL SELECT 'subtopic', subtopic, count(*) FROM decision_records GROUP BY 2")
def facet_histograms(t):
    return ag.facet_counts(t.decision_records, ["domain", "split", "subtopic"])


@query("SELECT coalesce(g, '[OVERALL]') AS category, count(*) AS n, round(avg(q) FILTER (q > 0), 6) AS ttft, round(sum(p) / sum(k), 6) AS tpot, round(avg(s), 6) AS segment_length FROM (SELECT l_returnflag g, l_quantity q, l_extendedprice p, l_linenumber k, l_tax s FROM lineitem) GROUP BY GROUPING SETS ((g), ())")
def decode_stats(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("ttft"), F.col("l_extendedprice").alias("decode_latency_ms"), F.col("l_linenumber").alias("decode_tokens"), F.col("l_tax").alias("segment_length"))
    return ag.decode_stats(rows, "category").select("category", "n", *(F.round(c, 6).alias(c) for c in ("ttft", "tpot", "segment_length")))


@query(
    f"""SELECT count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed, round(avg(latency_ms) FILTER (error IS NULL AND {_OK}), 6) AS avg_task, round(avg(raw_response.usage.input_tokens) FILTER (error IS NULL), 6) AS avg_prefill,
    round(avg(raw_response.usage.output_tokens) FILTER (error IS NULL), 6) AS avg_output, count(raw_response.usage.output_tokens) FILTER (error IS NULL) AS output_n FROM results"""
)
def replay_summary(t):
    none = F.lit(None).cast("double")
    rows = t.results.select(F.col("error").isNull().alias("success"), none.alias("ttft_ms"), F.col("latency_ms").alias("total_duration_ms"), F.col("raw_response.usage.input_tokens").alias("prompt_tokens"), F.col("raw_response.usage.output_tokens").alias("completion_tokens"), none.alias("decode_latency_ms"), none.alias("decode_tokens"))
    return ag.replay_summary(rows).select("successful", "failed", *(F.round(c, 6).alias(c) for c in ("avg_task", "avg_prefill", "avg_output")), "output_n")


@query(
    """WITH s AS (SELECT l_orderkey o, count(*) n, max(l_linenumber) m FROM lineitem GROUP BY 1), x AS (SELECT s.o, k, count(*) FILTER (l_linenumber - 1 >= k) / s.n r FROM s JOIN lineitem ON l_orderkey = s.o, range(1, 7) t(k) WHERE s.m <= 7 GROUP BY s.o, s.n, k)
    SELECT (k - 1)::INT AS position, round(avg(r), 9) AS acceptance FROM x GROUP BY k"""
)
def position_acceptance(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("segments"))
    return ag.mean_positions(rows.select(stats.acceptance(F.col("segments"), 6).alias("rates")), "rates").select("position", *_R("acceptance"))
