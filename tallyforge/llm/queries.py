"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import components, copies, leakage, mixing, overlap, percentiles, sampling, spans
from tallyforge.operators import latency
from tallyforge.session import table

SPLIT_WEIGHTS = {"train": 0.7, "validation": 0.1, "eval": 0.1, "test": 0.1}
POINTS = (0.5, 0.9, 0.95, 0.99)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.torn_records(table(spark, d, "decision_records"))


def p1_assignment(spark: SparkSession, d: str) -> DataFrame:
    return components.assign_splits(table(spark, d, "decision_records"), SPLIT_WEIGHTS)


def p1_large_sets(spark: SparkSession, d: str) -> DataFrame:
    return components.large_sets(table(spark, d, "decision_records"))


def p1_kept_together(spark: SparkSession, d: str) -> DataFrame:
    """Of the assignment: records, sets, sets in more than one split, and whether each record's set is named by its smallest number."""
    sets = p1_assignment(spark, d).groupBy("set_no").agg(F.count("*").alias("n"), F.count_distinct("new_split").alias("splits"), F.min("record_no").alias("least"))
    return sets.agg(F.sum("n").alias("records"), F.count("*").alias("sets"), F.count_if(F.col("splits") > 1).alias("torn"), F.bool_and(F.col("least") == F.col("set_no")).alias("named"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    assigned = p1_assignment(spark, d).groupBy("new_split").agg(F.count("*").alias("records"), F.count_distinct("set_no").alias("sets"))
    wanted = F.create_map(*(F.lit(x) for kv in SPLIT_WEIGHTS.items() for x in kv))
    return assigned.withColumn("target_share", wanted[F.col("new_split")]).withColumn("actual_share", F.col("records") / F.sum("records").over(Window.partitionBy()))


def _day(results: DataFrame) -> DataFrame:
    return results.select(F.col("called_at").cast("date").alias("day"), F.col("raw_response.model").alias("model"), "api_url", "latency_ms")


def p2_day_sketches(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of each day: its bucket counts by model and api_url."""
    return _day_sketches(spark, d)


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.sketch(_day(table(spark, d, "results")), "latency_ms", ["day", "model", "api_url"])


def _from_days(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    """Percentiles from the merged sketches of all days."""
    made = percentiles.percentiles(percentiles.merge(_day_sketches(spark, d), by), by, POINTS)
    return made.select(*by, "n", *(F.round(c, 6).alias(c) for c in made.columns if c.startswith("p")), "error_bound")


def p2_by_model(spark: SparkSession, d: str) -> DataFrame:
    return _from_days(spark, d, ["model"])


def p2_by_api_url(spark: SparkSession, d: str) -> DataFrame:
    return _from_days(spark, d, ["api_url"])


def p2_by_day(spark: SparkSession, d: str) -> DataFrame:
    return _from_days(spark, d, ["day"])


def p2_days_combined(spark: SparkSession, d: str) -> DataFrame:
    return _from_days(spark, d, [])


def p2_bounds_kept(spark: SparkSession, d: str) -> DataFrame:
    """Each model with the exact values at the ranks of its percentiles, and whether the percentiles of the merged days are within their bound of them."""
    made = percentiles.percentiles(percentiles.merge(_day_sketches(spark, d), ["model"]), ["model"], POINTS)
    names = [c for c in made.columns if c[0] == "p"]
    rows = _day(table(spark, d, "results")).where(percentiles.valid(F.col("latency_ms")))
    exact = latency.rank_values(rows, ["model"], "latency_ms", {f"exact_{c}": F.floor(F.lit(q) * (F.col("n") - 1)) + 1 for c, q in zip(names, POINTS)})
    both = made.alias("m").join(exact.alias("e"), F.col("m.model").eqNullSafe(F.col("e.model")))
    within = [(F.abs(F.col(f"m.{c}") - F.col(f"e.exact_{c}")) <= F.col("m.error_bound") * F.col(f"e.exact_{c}")).alias(f"kept_{c}") for c in names]
    return both.select("m.model", "m.n", *(F.col(f"e.exact_{c}") for c in names), *within)


def _baseline(spark: SparkSession, d: str, by: str) -> DataFrame:
    made = percentiles.percentiles(percentiles.sketch(table(spark, d, "disagreements"), "baseline_latency_ms", [by]), [by], POINTS)
    return made.select(by, "n", *(F.round(c, 6).alias(c) for c in made.columns if c[0] == "p" and c != by), "error_bound")


def p2_baseline_model(spark: SparkSession, d: str) -> DataFrame:
    return _baseline(spark, d, "baseline_model")


def p2_baseline_phase(spark: SparkSession, d: str) -> DataFrame:
    return _baseline(spark, d, "phase")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.decision_overlap(table(spark, d, "decision_records")).record_pairs()
    return pairs.select(F.least("t", "e").alias("record_no_a"), F.greatest("t", "e").alias("record_no_b")).distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs and held-out records, by split and source family of the held-out record."""
    held = table(spark, d, "decision_records").select(F.col("record_no").alias("e"), components.clean_split(F.col("split")).alias("split"), components.clean_link(F.col("source_family")).alias("source_family"))
    counted = overlap.decision_overlap(table(spark, d, "decision_records")).held_counts()
    return counted.join(held, "e").groupBy("split", "source_family").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).unmet().select(*sampling.CATEGORY)


def _sample(spark: SparkSession, d: str) -> sampling.TargetSample:
    return sampling.target_sample(table(spark, d, "decision_records"), table(spark, d, "category_target"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).rows()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report()


def p5_targets_met(spark: SparkSession, d: str) -> DataFrame:
    """What of the report does not depend on which ids were drawn, and whether the rows drawn lie between the target rounded down and up, or at the floor, or are all there are."""
    most = F.greatest(F.col("min_rows").cast("long"), F.ceil("target_rows"))
    within = (F.col("sampled") <= most) & ((F.col("sampled") >= F.col("least_rows")) | (F.col("sampled") == F.col("eligible")))
    return _sample(spark, d).report().select(*sampling.CATEGORY, "eligible", "needed", "least_rows", "met", within.alias("within"))


def _copy_forms(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    records = table(spark, d, "decision_records").select("record_no", F.col("input.state").alias("state"))
    return [("decision_records", copies.forms(records, "record_no", "state")), ("gold_template", copies.forms(table(spark, d, "gold_template"), "gold_no", "question"))]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    one, two = (copies.copy_pairs(rows).select(F.lit(name).alias("source_table"), "kept_no", "copy_no") for name, rows in _copy_forms(spark, d))
    return one.unionByName(two)


def p6_question_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row for each question of gold_template that remains, with the number of its copies."""
    return copies.copy_groups(_copy_forms(spark, d)[1][1]).select("kept_no", "copies")


def p6_text_copies(spark: SparkSession, d: str) -> DataFrame:
    """The same of the states of decision_records that are plain texts."""
    records = table(spark, d, "decision_records").select("record_no", F.col("input.state").alias("state")).where(~F.col("state").rlike(r"^\s*[{\[]"))
    return copies.copy_groups(copies.forms(records, "record_no", "state")).select("kept_no", "copies")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record that remains, with the number of its copies."""
    one, two = (copies.copy_groups(rows).select(F.lit(name).alias("source_table"), "kept_no", "copies") for name, rows in _copy_forms(spark, d))
    return one.unionByName(two)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document and whether something was cut out of it."""
    return p7_clean(spark, d).select("doc_id", F.coalesce(F.col("removed_chars") > 0, F.lit(False)).alias("cut"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of documents that hold some of it."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def _mix(spark: SparkSession, d: str) -> mixing.SourceMix:
    return mixing.SourceMix(table(spark, d, "documents"), table(spark, d, "mix_target"), spark.conf.get("spark.tallyforge.tokenizer", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).short_sources().select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).copies()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p8_character_shares(spark: SparkSession, d: str) -> DataFrame:
    """The mix by characters in place of tokens: what each source should give, whether it falls short, and whether what it gives is within its largest document and the width of a size class of that, and its repeats within theirs."""
    sizes = table(spark, d, "documents").select("doc_id", mixing.clean_source(F.col("source")).alias("c_source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    shares = mixing.SourceMix.of_sizes(sizes, table(spark, d, "mix_target")).shares()
    near = F.col("short") | (F.abs(F.col("mixed_tokens") - F.col("target_tokens")) <= F.col("largest") + 0.045 * F.col("target_tokens"))
    return shares.select("source", "documents", "tokens", F.round("target_tokens", 3).alias("target_tokens"), "short", near.alias("near"), (F.col("copies") <= F.col("max_repeats") * F.col("documents")).alias("within_repeats"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents")).extents().select("doc_id", "extent")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each document with a shared span: how many of its non-blank characters such spans cover."""
    return spans.SharedSpans(table(spark, d, "documents")).extents()


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents")).document_stretches()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
