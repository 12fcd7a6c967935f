"""Roll-ups of labels, predictions and scores.

Denominators are part of each definition: failed rows count as wrong in accuracy, are left out of calibration and latency, and every rate
over no rows is null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.functions.parse import FAILED, valid_number
from tallyforge.operators.ordered import running


def metric(x: Column, name: str) -> list[Column]:
    """count, total (0 over none) and mean (null over none) of the valid numbers."""
    valid = F.when(valid_number(x.cast("double")), x)
    return [F.count(valid).alias(f"{name}_count"), F.coalesce(F.sum(valid), F.lit(0)).alias(f"{name}_total"), F.avg(valid).alias(f"{name}_mean")]


def facet_counts(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """(facet, value, n): the histograms of several columns in one pass and one shuffle."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets)))
    return df.select(cells.alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def agreement(df: DataFrame, by: Sequence[str], baseline: str, prediction: str, failed: Column) -> DataFrame:
    """(by, rows, comparable, agreed, agreement, successes, agreement_success_only).

    Comparable rows have a baseline; a failed or missing prediction disagrees in ``agreement`` and is left out of ``agreement_success_only``.
    """
    known = F.col(baseline).isNotNull()
    good = known & ~failed & F.col(prediction).isNotNull()
    same = F.coalesce(F.col(baseline) == F.col(prediction), F.lit(False)) & good
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(known).alias("comparable"), F.count_if(same).alias("agreed"),
        stats.rate(F.when(known, same)).alias("agreement"), F.count_if(good).alias("successes"), stats.rate(F.when(good, same)).alias("agreement_success_only"),
    )


def confusion(df: DataFrame, baseline: str, prediction: str) -> DataFrame:
    """(baseline, prediction, n), missing predictions under their own label."""
    return df.groupBy(F.col(baseline).alias("baseline"), F.coalesce(prediction, F.lit(FAILED)).alias("prediction")).agg(F.count("*").alias("n"))


def binary_confusion(truth: Column, said: Column) -> list[Column]:
    """tp, fp, tn, fn over rows where both are known."""
    return [F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(~truth & ~said).alias("tn"), F.count_if(truth & ~said).alias("fn")]


def cost_sensitive(truth: Column, said: Column, fallback: str) -> Column:
    """Same class, or the safe fallback class in place of another; errors are wrong."""
    return F.coalesce((truth == said) | ((said == fallback) & (truth != fallback)), F.lit(False))


def question_metrics(correct: Column, error: Column, absolute_error: Column) -> list[Column]:
    """n, accuracy with errors as wrong, accuracy of successes, mean absolute score error with its count."""
    right = F.coalesce(correct, F.lit(False)) & error.isNull()
    return [F.count("*").alias("n"), F.count_if(error.isNotNull()).alias("errors"), stats.rate(right).alias("accuracy"), stats.rate(F.when(error.isNull(), right)).alias("accuracy_success_only"), F.avg(absolute_error).alias("score_mae"), F.count(absolute_error).alias("score_n")]


def grouped(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], label: str = "all") -> DataFrame:
    """(grouping, key, aggregates): the whole and each key on its own, as one GROUPING SETS aggregation."""
    view = df
    sets = [[], *([k] for k in keys)]
    out = view.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().alias("_g"), *aggregates)
    bits = {sum(1 << (len(keys) - 1 - i) for i in range(len(keys)) if i != j): k for j, k in enumerate(keys)}
    name = F.lit(label)
    value = F.lit(label)
    for g, k in bits.items():
        name = F.when(F.col("_g") == g, k).otherwise(name)
        value = F.when(F.col("_g") == g, F.col(k).cast("string")).otherwise(value)
    kept = [c for c in out.columns if c not in (*keys, "_g")]
    return out.select(name.alias("grouping"), value.alias("key"), *kept)


def accuracy_block(df: DataFrame, by: Sequence[str], correct: str, z: float = stats.Z95) -> DataFrame:
    """(by, n, correct, accuracy, low, high) with the Wilson interval."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(correct), F.lit(False))).alias("correct"))
    return counted.select(*by, "n", "correct", stats.share(F.col("correct"), F.col("n")).alias("accuracy"), stats.wilson(F.col("correct"), F.col("n"), z).alias("_w")).select("*", "_w.low", "_w.high").drop("_w")


def family_balanced(df: DataFrame, family: str, label: str, correct: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over families of the mean over labels of accuracy."""
    first = df.groupBy(*by, family, label).agg(stats.rate(F.coalesce(F.col(correct), F.lit(False))).alias("a"))
    second = first.groupBy(*by, family).agg(F.avg("a").alias("a"))
    return second.groupBy(*by).agg(F.count("*").alias("families"), F.avg("a").alias("family_balanced_accuracy"))


def family_complete(df: DataFrame, family: str, correct: str, by: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """(by, families, complete, complete_rate): families with every member right; with ``size``, only families of that many members count and others stop the run."""
    members = df.groupBy(*by, family).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col(correct), F.lit(False))).alias("all_right"))
    if size is not None:
        members = members.where(F.when(F.col("n") != size, F.raise_error(F.lit(f"a family has not {size} members")).cast("boolean")).otherwise(True))
    return members.groupBy(*by).agg(F.count("*").alias("families"), F.count_if("all_right").alias("complete"), stats.rate(F.col("all_right")).alias("complete_rate"))


def family_sizes(df: DataFrame, family: str) -> DataFrame:
    """(size, families): histogram of family sizes."""
    return df.groupBy(family).count().groupBy(F.col("count").alias("size")).agg(F.count("*").alias("families"))


def pair_outcomes(left: Column, right: Column) -> list[Column]:
    """both, neither, left_only, right_only and the exact McNemar p value."""
    a, b = F.coalesce(left, F.lit(False)), F.coalesce(right, F.lit(False))
    lo, ro = F.count_if(a & ~b), F.count_if(~a & b)
    return [F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"), lo.alias("left_only"), ro.alias("right_only"), stats.mcnemar(lo, ro).alias("p_value")]


def calibration_error(df: DataFrame, p: str, right: str, by: Sequence[str] = (), bins: int = stats.BINS) -> DataFrame:
    """(by, n, ece): sum over equal-width bins of |sum(p - right)| / n, over valid rows."""
    valid = df.where(F.col(p).between(0, 1) & F.col(right).isNotNull())
    binned = valid.groupBy(*by, stats.calibration_bin(F.col(p), bins).alias("_bin")).agg(F.count("*").alias("n"), F.sum(F.col(p) - F.col(right).cast("double")).alias("gap"))
    return binned.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.abs("gap")) / F.sum("n")).alias("ece"))


def calibration_bins(df: DataFrame, p: str, right: str, bins: int = stats.BINS) -> DataFrame:
    """(bin, n, confidence, accuracy)."""
    valid = df.where(F.col(p).between(0, 1) & F.col(right).isNotNull())
    return valid.groupBy(stats.calibration_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), stats.rate(F.col(right)).alias("accuracy"))


def auroc(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, positives, negatives, auroc): ties count half; null if a class is absent.

    Equal scores are counted before anything is ordered, and ranks come from two-level prefix sums, so no task holds all distinct scores.
    """
    by = list(by)
    valid = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(positive).isNotNull())
    tied = valid.select(*by, F.col(score).alias("_s"), F.col(positive).alias("_y")).groupBy(*by, "_s").agg(F.count_if("_y").alias("_p"), F.count_if(~F.col("_y")).alias("_q"))
    ranked = running(tied, by, ["_s"], {"_before": F.col("_p") + F.col("_q")}, inclusive=False)
    mean_rank = F.col("_before") + (F.col("_p") + F.col("_q") + 1) / 2
    sums = ranked.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"), F.sum(F.col("_p") * mean_rank).alias("_r"))
    return sums.select(*by, "positives", "negatives", stats.ranks_to_auroc(F.col("_r"), F.col("positives"), F.col("negatives")).alias("auroc"))


def assess(p: Column, reference: Column, kind: Column) -> list[Column]:
    """Per-row scores of a probability array against the 0-based reference: prediction (first of equals), top and reference probability, NLL, Brier scores, expected score and its error."""
    ref_p = F.get(p, reference)
    level = F.when(kind == "score", stats.expected_score(p))
    return [
        stats.argmax(p).alias("prediction_index"), (stats.argmax(p) == reference).alias("correct"), F.array_max(p).alias("top_probability"), ref_p.alias("reference_probability"),
        stats.negative_log_likelihood(ref_p).alias("negative_log_likelihood"), stats.multiclass_brier(p, reference).alias("multiclass_brier"),
        F.when(kind == "noul", F.pow(F.get(p, 1) - reference, 2)).alias("binary_brier"), level.alias("expected_score"), F.abs(level - reference).alias("absolute_score_error"),
    ]


def complete_mean(x: Column) -> Column:
    """Mean only if every row has a value."""
    return F.when(F.count(x) == F.count("*"), F.avg(x))


def macro_micro(df: DataFrame, subset: str, correct: str, run: str, kind: str) -> DataFrame:
    """(run, type, subsets, macro, micro): mean of subset accuracies, and all right answers by all rows, overall and for each type."""
    first = df.groupBy(run, kind, subset).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(correct), F.lit(False))).alias("c"))
    both = first.withColumn("type", F.explode(F.array(F.col(kind), F.lit("all"))))
    subsets = both.groupBy(run, "type", subset).agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return subsets.groupBy(run, "type").agg(F.count("*").alias("subsets"), F.avg(stats.share(F.col("c"), F.col("n"))).alias("macro"), stats.share(F.sum("c"), F.sum("n")).alias("micro"))


def position_counts(df: DataFrame, choices: Column, value: Column) -> DataFrame:
    """(position, n): 1-based place of the value among its choices; 0 where it is none of them."""
    return df.select(F.array_position(choices, value).alias("position")).groupBy("position").agg(F.count("*").alias("n"))


def drift(left: DataFrame, right: DataFrame, key: str, p: str, prediction: str) -> DataFrame:
    """(rows, max_difference, mean_difference, flips) of two runs' probability maps over the same keys."""
    l = left.select(key, F.explode(p).alias("option", "a"), F.col(prediction).alias("pa"))  # noqa: E741
    r = right.select(key, F.explode(p).alias("option", "b"), F.col(prediction).alias("pb"))
    each = l.join(r, [key, "option"]).groupBy(key).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("d"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("s"), F.count("*").alias("k"), F.max(F.col("pa") != F.col("pb")).alias("flip"))
    return each.agg(F.count("*").alias("rows"), F.max("d").alias("max_difference"), (F.sum("s") / F.sum("k")).alias("mean_difference"), F.count_if("flip").alias("flips"))


def speedups(df: DataFrame, by: Sequence[str], mode: str, value: str, base: str, others: Sequence[str]) -> DataFrame:
    """Median of each mode's values and how many times faster than ``base`` the others are."""
    wide = df.groupBy(*by).pivot(mode, [base, *others]).agg(F.median(value))
    return wide.select(*by, *wide.columns[len(by) :], *(F.try_divide(F.col(base), F.col(o)).alias(f"{o}_speedup") for o in others))


def usage_cost(df: DataFrame, response_id: str, input_tokens: str, output_tokens: str, input_price: float, output_price: float) -> DataFrame:
    """(responses, input_tokens, output_tokens, cost) with each response id once; rows without an id all count.  Prices are for a million tokens."""
    named = df.where(F.col(response_id).isNotNull()).groupBy(response_id).agg(F.max(input_tokens).alias("i"), F.max(output_tokens).alias("o")).select("i", "o")
    every = named.unionByName(df.where(F.col(response_id).isNull()).select(F.col(input_tokens).alias("i"), F.col(output_tokens).alias("o")))
    return every.agg(F.count("*").alias("responses"), F.coalesce(F.sum("i"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("o"), F.lit(0)).alias("output_tokens"), (F.coalesce(F.sum(F.col("i") * input_price + F.col("o") * output_price), F.lit(0.0)) / 1e6).alias("cost"))


def charged_or_reserved(cost: Column, reservation: Column) -> Column:
    """The cost if it is valid, else what was set aside."""
    return F.when(valid_number(cost), cost).otherwise(reservation)


def budget_breach(df: DataFrame, order: str, amount: str, budget: float) -> DataFrame:
    """(first_over): the first place in order at which the running amount exceeds the budget; null if it never does.

    Blocks of the order are summed first; rows are then summed within their block, on top of the blocks before it, so no task orders all rows.
    Amounts may be negative.
    """
    blocked = df.withColumn("_b", (F.col(order).cast("long") / 10_000).cast("long"))
    sums = blocked.groupBy("_b").agg(F.sum(amount).alias("s"))
    before = sums.select("_b", F.coalesce(F.sum("s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = blocked.withColumn("within", F.coalesce(F.sum(amount).over(Window.partitionBy("_b").orderBy(order)), F.lit(0)))
    return inside.join(before, "_b").where(F.col("before") + F.col("within") > budget).agg(F.min(order).alias("first_over"))


def stage_rollup(df: DataFrame, stage: str, amounts: Sequence[str], questions: int, total: str = "total") -> DataFrame:
    """(stage, calls, sum and mean of each amount, amount per question), with a total row; means over no numbers are 0."""
    aggs = [F.count("*").alias("calls")]
    for a in amounts:
        aggs += [F.coalesce(F.sum(a), F.lit(0)).alias(f"{a}_sum"), F.coalesce(F.avg(a), F.lit(0.0)).alias(f"{a}_mean"), (F.coalesce(F.sum(a), F.lit(0)) / questions).alias(f"{a}_per_question")]
    rolled = df.rollup(stage).agg(F.grouping(stage).alias("_g"), *aggs)
    return rolled.select(F.when(F.col("_g") == 1, total).otherwise(F.col(stage)).alias(stage), *[c for c in rolled.columns if c not in (stage, "_g")])


def missing_stages(df: DataFrame, entity: str, stage: str, required: Sequence[str]) -> DataFrame:
    """(entity, missing, complete): required stages that an entity lacks, in their order."""
    seen = df.groupBy(entity).agg(F.collect_set(F.when(F.col(stage).isin(*required), F.col(stage))).alias("seen"))
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("seen"))
    return seen.select(entity, missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def multiset_label(df: DataFrame, entity: str, item: str, order: str) -> DataFrame:
    """(entity, label): items with their counts, ``a×2 + b×1``, in the order in which they were first seen."""
    counted = df.groupBy(entity, item).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    parts = F.array_sort(F.collect_list(F.struct("first", F.col(item).alias("item"), "n")))
    return counted.groupBy(entity).agg(F.array_join(F.transform(parts, lambda p: F.concat(p["item"], F.lit("×"), p["n"].cast("string"))), " + ").alias("label"))


def best_candidate(value: Column, *keys: Column) -> Column:
    """The value with the least keys, compared one after another."""
    return F.min_by(value, F.struct(*keys))


def dynamic_pivot(df: DataFrame, entity: str, stage: str, occurrence: str, amounts: Sequence[str], stages: Sequence[str], most: int = 2_000) -> DataFrame:
    """One row for each entity; for each stage as many columns for each amount as any entity has calls of it, at least one.

    More than ``most`` columns stop the run: such a table is better kept long, as ``pivot_cells`` gives it.
    """
    widest = {r[stage]: r["w"] for r in df.where(F.col(stage).isin(*stages)).groupBy(stage).agg(F.max(occurrence).alias("w")).collect()}
    width = sum(widest.get(s) or 1 for s in stages) * len(amounts)
    if width > most:
        raise ValueError(f"{width} columns are more than {most}; use pivot_cells")
    cells = [(s, i) for s in stages for i in range(1, (widest.get(s) or 1) + 1)]
    return df.groupBy(entity).agg(*(F.max(F.when((F.col(stage) == s) & (F.col(occurrence) == i), F.col(a))).alias(f"{s}_{i}_{a}") for s, i in cells for a in amounts))


def pivot_cells(df: DataFrame, entity: str, stage: str, occurrence: str, amounts: Sequence[str]) -> DataFrame:
    """(entity, stage, occurrence, amount, value): the cells of the pivot that hold a value, whatever its width."""
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("amount"), F.col(a).cast("double").alias("value")) for a in amounts)))
    return df.select(entity, stage, occurrence, cells.alias("x")).groupBy(entity, stage, occurrence, "x.amount").agg(F.max("x.value").alias("value")).where("value is not null")


def entity_totals(entities: DataFrame, calls: DataFrame, key: str, amounts: Sequence[str]) -> DataFrame:
    """Every entity with the number of its calls and the sums of their amounts, 0 without calls."""
    sums = calls.groupBy(key).agg(F.count("*").alias("calls"), *(F.sum(a).alias(a) for a in amounts))
    return entities.select(key).join(sums, key, "left").fillna(0, ["calls", *amounts])


def all_agree(prediction: Column, error: Column) -> Column:
    """Whether all predictions of a group are equal; null if any run failed."""
    return F.when(~F.bool_or(error.isNotNull()), F.count_distinct(prediction) == 1)


def decode_stats(df: DataFrame, category: str) -> DataFrame:
    """(category with [OVERALL], n, ttft over positive values, tpot weighted by tokens, mean of requests' segment length)."""
    rows = df.groupingSets([[F.col(category)], []], category).agg(
        F.grouping(category).alias("_g"), F.count("*").alias("n"), F.avg(F.when(F.col("ttft") > 0, F.col("ttft"))).alias("ttft"),
        F.try_divide(F.sum("decode_latency_ms"), F.sum("decode_tokens")).alias("tpot"), F.avg("segment_length").alias("segment_length"),
    )
    return rows.select(F.when(F.col("_g") == 1, "[OVERALL]").otherwise(F.col(category).cast("string")).alias(category), "n", "ttft", "tpot", "segment_length")


def replay_summary(df: DataFrame) -> DataFrame:
    """Means over successful replays: first chunk, whole task, prompt and output tokens (each over the rows that report it), time for each token weighted by tokens."""
    good = F.col("success")
    valid = lambda c: F.when(good & valid_number(F.col(c).cast("double")), F.col(c))
    return df.agg(
        F.count_if(good).alias("successful"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"), F.avg(valid("ttft_ms")).alias("ttft"), F.avg(valid("total_duration_ms")).alias("avg_task"),
        F.avg(valid("prompt_tokens")).alias("avg_prefill"), F.avg(valid("completion_tokens")).alias("avg_output"), F.count(valid("completion_tokens")).alias("output_n"),
        F.try_divide(F.sum(valid("decode_latency_ms")), F.sum(valid("decode_tokens"))).alias("tpot"),
    )


def mean_positions(df: DataFrame, rates: str) -> DataFrame:
    """(position, acceptance): element-wise mean of per-request acceptance arrays; null arrays are left out."""
    return df.select(F.posexplode(rates).alias("position", "rate")).groupBy("position").agg(F.avg("rate").alias("acceptance"))


def checklist(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, n): how many rows satisfy each named condition, from one pass."""
    row = df.agg(*(F.count_if(c).alias(name) for name, c in checks.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("n")) for name in checks))).alias("x")).select("x.*")
