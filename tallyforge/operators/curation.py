"""Rules over facts that are supported, refuted or unknown, and the audits around curated records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators.joins import provenance_mismatches
from tallyforge.operators.selection import label_blind_order
from tallyforge.operators.skew import hot_keys, spread_join
from tallyforge.operators.stages import stage
from tallyforge.operators.validate import demand_none

STATES = ("supported", "refuted", "unknown")
#: so many pairs of rules are left to one task
PAIRS = 5_000_000


def rule_literal(rules: Sequence[tuple[Mapping[str, str], str]]) -> Column:
    """Rules (conditions, target) as one array column of struct(when, target)."""
    return F.array(*(F.struct(F.create_map(*(F.lit(x) for kv in when.items() for x in kv)).alias("when"), F.lit(target).alias("target")) for when, target in rules))


def facts_of(facts: DataFrame, key: str, atom: str = "atom", state: str = "state") -> DataFrame:
    """(key, facts map<atom, state>); a record has a few dozen atoms at most."""
    return facts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(atom), F.col(state)))).alias("facts"))


def rule_targets(facts: Column, rules: Column) -> Column:
    """Distinct targets, sorted, of the rules whose every condition holds; a missing fact is ``unknown``."""
    holds = lambda r: F.forall(F.map_keys(r["when"]), lambda k: F.coalesce(F.try_element_at(facts, k), F.lit("unknown")) == F.element_at(r["when"], k))
    return F.array_sort(F.array_distinct(F.transform(F.filter(rules, holds), lambda r: r["target"])))


def _literal_targets(facts: Column, rules: Sequence[tuple[Mapping[str, str], str]]) -> Column:
    """As ``rule_targets``, with each rule written out as a plain condition."""
    state = lambda atom: F.coalesce(facts[atom], F.lit("unknown"))
    made = []
    for when, target in rules:
        holds = F.lit(True)
        for atom, wanted in when.items():
            holds = holds & (state(atom) == wanted)
        made.append(F.when(holds, F.lit(target)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*made))))


def decide(df: DataFrame, facts: str, rules: Column | Sequence[tuple[Mapping[str, str], str]]) -> DataFrame:
    """``df`` with targets, target and outcome: what unordered sufficient-condition rules say about each row's facts.

    No target: ``abstain``; one: ``decided``; several: ``conflict``.  The rules are a column, such as the row's own, or given as (conditions, target) and then compiled; nothing is joined.
    """
    marked = df.withColumn("targets", rule_targets(F.col(facts), rules) if isinstance(rules, Column) else _literal_targets(F.col(facts), rules))
    n = F.size("targets")
    return marked.withColumn("target", F.when(n == 1, F.get("targets", 0))).withColumn("outcome", F.when(n == 0, "abstain").when(n == 1, "decided").otherwise("conflict"))


def overlapping_rules(rules: DataFrame, plan: str) -> DataFrame:
    """(plan, left, right) of rules with different targets that some facts satisfy both: no atom they share is asked for in different states.

    ``rules`` has rows (plan, rule, target, when map<atom, state>).  Rules of one plan, target and conditions are one class.  Only classes are
    compared, and each pair of classes that can meet gives all pairs of its rules, so the work is in proportion to the result.  The rules of the
    larger class are repeated for each smaller one, and pairs of classes with many pairs of rules are joined in shares.  A rule without conditions holds
    always; a rule without a plan, name or target is in no pair.
    """
    when = F.coalesce("when", F.create_map().cast(rules.schema["when"].dataType))
    known = stage(rules.where(F.col(plan).isNotNull() & F.col("rule").isNotNull() & F.col("target").isNotNull()).select(F.col(plan).alias("plan"), "target", F.array_sort(F.map_entries(when)).alias("c"), "rule"), "rules")
    classes = stage(known.groupBy("plan", "target", "c").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "rule-classes")
    members = stage(spread_join(known, classes, ["plan", "target", "c"], hot_keys(classes, ["plan", "target", "c"], "n"), "rule").select("id", "rule"), "class-members")
    a, b = (classes.select("plan", F.struct("n", "id").alias(s), F.col("target").alias(f"t{s}"), F.map_from_entries("c").alias(f"c{s}")) for s in "lr")
    clash = F.exists(F.map_keys("cl"), lambda k: F.coalesce(F.element_at("cr", k) != F.element_at("cl", k), F.lit(False)))
    plans = classes.groupBy("plan").agg(F.count("*").alias("n"))
    meet = spread_join(a, b, ["plan"], hot_keys(plans, ["plan"], "n"), "l").where((F.col("l") > F.col("r")) & (F.col("tl") != F.col("tr")) & ~clash)
    pairs = stage(meet.select("plan", F.col("l.id").alias("l"), F.col("r.id").alias("r"), (F.col("l.n") * F.col("r.n")).alias("n")), "class-pairs")
    x, y = members.select(F.col("id").alias("l"), F.col("rule").alias("x")), members.select(F.col("id").alias("r"), F.col("rule").alias("y"))
    left = spread_join(x, pairs.drop("n"), ["l"], hot_keys(classes.withColumnRenamed("id", "l"), ["l"], "n"), "x")
    every = spread_join(left, y.hint("merge"), ["r"], hot_keys(pairs.groupBy("r").agg(F.sum("n").alias("n")), ["r"], "n", least=PAIRS), "x")
    return every.where(F.col("x") != F.col("y")).select(F.col("plan").alias(plan), F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))


def assignments(spark, atoms: Sequence[str]) -> DataFrame:
    """All 3^n assignments of states to up to twelve atoms: (assignment, atom, state)."""
    if len(atoms) > 12:
        raise ValueError("too many atoms to enumerate; compare rules pairwise instead")
    digit = lambda i: F.get(F.array(*map(F.lit, STATES)), (F.floor(F.col("id") / 3**i) % 3).cast("int"))
    return spark.range(3 ** len(atoms)).select(F.col("id").alias("assignment"), F.explode(F.array(*(F.struct(F.lit(a).alias("atom"), digit(i).alias("state")) for i, a in enumerate(atoms)))).alias("x")).select("assignment", "x.*")


def plan_rules(atoms: Column, rules: Column, focus: Column, base: Column, counter: Column, most: int = 20) -> dict[str, Column]:
    """What a rule plan must satisfy.  ``atoms`` array<string>; ``rules`` array<struct<when map<string,string>, target>>; ``base`` and ``counter`` map<string,string>."""
    differing = F.filter(F.map_keys(base), lambda k: F.element_at(base, k) != F.element_at(counter, k))
    return {
        "atoms": (F.size(atoms) >= 1) & (F.size(atoms) <= most) & (F.size(F.array_distinct(atoms)) == F.size(atoms)),
        "rules": F.size(rules) >= 2,
        "total": (F.array_sort(F.map_keys(base)) == F.array_sort(atoms)) & (F.array_sort(F.map_keys(counter)) == F.array_sort(atoms)),
        "focus": (F.element_at(base, focus) == "supported") & (F.element_at(counter, focus) == "refuted"),
        "only focus differs": (F.size(differing) == 1) & (F.get(differing, 0) == focus),
        "decided": (F.size(rule_targets(base, rules)) == 1) & (F.size(rule_targets(counter, rules)) == 1),
        "label changes": rule_targets(base, rules) != rule_targets(counter, rules),
    }


def audit_passes(flags: Column, rule_indexes: Column, sound: Column, n_rules: Column) -> Column:
    """Every flag true, every rule judged exactly once and sound."""
    return F.forall(flags, lambda f: f) & (F.array_sort(rule_indexes) == F.when(n_rules > 0, F.sequence(F.lit(0), n_rules - 1)).otherwise(F.array().cast("array<int>"))) & F.forall(sound, lambda s: s)


def assess_facts(jobs: DataFrame, judgments: DataFrame, key: str) -> DataFrame:
    """(key, problem): judgments that miss or exceed the expected atoms, lack quotes, or quote what the context does not say.

    ``jobs`` (key, context, atoms array<string>); ``judgments`` (key, atom, state, quotes array<string>).
    """
    expected = jobs.select(key, "context", F.explode("atoms").alias("atom"))
    joined = expected.join(judgments, [key, "atom"], "full")
    joined = joined.drop("context").join(jobs.select(key, "context"), key, "left")
    missing, extra = F.col("state").isNull(), ~F.coalesce(F.array_contains(F.col("wanted"), F.col("atom")), F.lit(False))
    checked = joined.join(jobs.select(key, F.col("atoms").alias("wanted")), key, "left")
    needs = F.col("state").isin("supported", "refuted") & (F.coalesce(F.size("quotes"), F.lit(0)) <= 0)
    false_quote = F.exists("quotes", lambda q: ~F.contains(F.col("context"), q))
    problem = F.when(extra, "unexpected atom").when(missing, "missing atom").when(~F.col("state").isin(*STATES, "inconsistent"), "unknown state").when(needs, "no quote").when(F.coalesce(false_quote, F.lit(False)), "quote not in context")
    return checked.select(key, "atom", problem.alias("problem")).where(F.col("problem").isNotNull())


def unexpected(judgments: DataFrame, expected: DataFrame, key: str, atom: str = "atom", state: str = "state") -> DataFrame:
    """Judgments that differ from the state expected of them, with both states; missing ones included."""
    e = expected.select(key, atom, F.col(state).alias("expected"))
    return e.join(judgments.select(key, atom, F.col(state).alias("judged")), [key, atom], "left").where(~F.col("expected").eqNullSafe(F.col("judged")))


def entailment_gate(pairs: DataFrame, expected: Mapping[str, str], key: str, check: str, state: str) -> DataFrame:
    """(key, passed): every expected check was made and gave the expected state."""
    want = F.create_map(*(F.lit(x) for kv in expected.items() for x in kv))
    right = F.coalesce(want[F.col(check)] == F.col(state), F.lit(False))
    return pairs.groupBy(key).agg(((F.count_distinct(F.when(right, F.col(check))) == len(expected)) & F.bool_and(right)).alias("passed"))


def contrast_groups(jobs: DataFrame, key: str) -> DataFrame:
    """Five variants of each job: base, removed, counterfactual, paraphrase, distractor: (key, variant, state, target).

    ``jobs`` (key, state, evidence, counter_evidence, paraphrase, distractor, target, counter_target, missing_target).  A span that is not exactly once in
    the state gives no variant.
    """
    from tallyforge.functions.parse import span_edit, with_distractor

    state = F.col("state")
    variants = {
        "base": (state, F.col("target")),
        "removed": (span_edit(state, F.col("evidence"), F.lit("")), F.col("missing_target")),
        "counterfactual": (span_edit(state, F.col("evidence"), F.col("counter_evidence")), F.col("counter_target")),
        "paraphrase": (span_edit(state, F.col("evidence"), F.col("paraphrase")), F.col("target")),
        "distractor": (F.col("_with"), F.col("target")),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), s.alias("state"), t.alias("target")) for v, (s, t) in variants.items())))
    return jobs.withColumn("_with", with_distractor(F.col("state"), F.col("distractor"))).select(key, rows.alias("x")).select(key, "x.*").where(F.col("state").isNotNull())


def group_problems(groups: DataFrame, key: str, variants: Sequence[str]) -> DataFrame:
    """(key, problem): groups whose variants are not exactly those expected, not all different, or all of one label.

    Variants are counted before they are compared, so a group of any size is a few counts.
    """
    wanted = {v: list(variants).count(v) for v in variants}
    want = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv))
    counted = groups.groupBy(key, "variant").agg(F.count("*").alias("n"))
    right = counted.groupBy(key).agg(((F.count("*") == len(wanted)) & F.bool_and(F.coalesce(want[F.col("variant")] == F.col("n"), F.lit(False)))).alias("right"))
    made = groups.groupBy(key).agg(F.count_distinct("state").alias("states"), F.count_distinct("target").alias("labels"), F.count("*").alias("n")).join(right, key)
    checks = F.array_compact(F.array(F.when(~F.col("right"), "variants"), F.when(F.col("states") < F.col("n"), "equal variants"), F.when(F.col("labels") < 2, "one label")))
    return made.select(key, F.explode(checks).alias("problem"))


def emit_rows(groups: DataFrame, verified: DataFrame, rules: Column | Sequence[tuple[Mapping[str, str], str]], key: str, variant: str = "variant") -> tuple[DataFrame, DataFrame]:
    """(rows, issues): variants whose verified facts agree with the intended ones and decide one target.

    ``groups`` (key, variant, state, intended map<atom, state>); ``verified`` (key, variant, atom, state).
    """
    got = verified.groupBy(key, variant).agg(F.map_from_entries(F.collect_list(F.struct("atom", "state"))).alias("verified"))
    judged = decide(groups.join(got, [key, variant], "left"), "verified", rules)
    reason = F.when(F.col("verified").isNull(), "not verified").when(F.exists(F.map_values("verified"), lambda s: s == "inconsistent"), "inconsistent").when(F.array_sort(F.map_entries("verified")) != F.array_sort(F.map_entries("intended")), "facts differ").when(F.col("outcome") != "decided", F.col("outcome"))
    marked = judged.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason", "outcome", "targets"), marked.where(F.col("reason").isNotNull())


def blind_cases(rows: DataFrame, *content: str) -> DataFrame:
    """Rows in an order fixed by their content, under case ids that tell nothing about them."""
    return label_blind_order(rows, *content).withColumn("case_id", F.concat(F.lit("case-"), F.lpad(F.col("place").cast("string"), 9, "0")))


def verification_issues(cases: DataFrame, verdicts: DataFrame, target: str) -> DataFrame:
    """(case_id, issue): cases without a verdict, with an ambiguous one, or with another target than theirs."""
    joined = cases.join(verdicts.select("case_id", F.col("target").alias("said"), "unambiguous"), "case_id", "left")
    issue = F.when(F.col("said").isNull(), "no verdict").when(~F.col("unambiguous"), "ambiguous").when(F.col("said") != F.col(target), "disagrees")
    return joined.select("case_id", issue.alias("issue")).where(F.col("issue").isNotNull())


def release_audit(rows: DataFrame, sources: DataFrame, held_out: DataFrame, variants: Sequence[str]) -> dict[str, DataFrame]:
    """Violations of a release by name, each a table that should be empty: repeated ids and inputs, provenance, leakage, incomplete groups.

    ``rows`` (id, family, input_sha256, source_id, source_sha256, group_id, variant, state, target); ``sources`` (id, family, sha256); ``held_out`` (family, input_sha256).
    """
    return {
        "repeated id": rows.groupBy("id").count().where("count > 1"),
        "repeated input": rows.groupBy("input_sha256").count().where("count > 1"),
        "provenance": provenance_mismatches(rows, sources, "source_id", "id", {"source_sha256": "sha256", "family": "family"}),
        "held-out family": rows.join(held_out.select("family").distinct(), "family", "left_semi"),
        "held-out input": rows.join(held_out.select("input_sha256").distinct(), "input_sha256", "left_semi"),
        "groups": group_problems(rows, "group_id", variants),
    }


def demand_clean(audit: Mapping[str, DataFrame]) -> None:
    for name, violations in audit.items():
        demand_none(violations, name)


def refinable(attempts: DataFrame, source: str, accepted: str, quota: str, made: str) -> DataFrame:
    """Sources tried at least twice without success while at least 70 % of their quota is open."""
    sums = attempts.groupBy(source).agg(F.count("*").alias("attempts"), F.count_if(F.col(accepted)).alias("accepts"), F.max(quota).alias("quota"), F.max(made).alias("made"))
    return sums.where((F.col("attempts") >= 2) & (F.col("accepts") == 0) & ((F.col("quota") - F.col("made")) >= 0.7 * F.col("quota")))


def coverage_plan(spark, subjects: Sequence[str], formats: Sequence[str], kinds: Sequence[str], per_subject: int, seed: int) -> DataFrame:
    """(ordinal, subject, slot, format, kind, held_out): formats and kinds rotate over the slots, and one slot of each subject, fixed by the seed, is held out."""
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    n = F.col("id")
    subject, slot = F.floor(n / per_subject), n % per_subject
    held = F.pmod(F.xxhash64(subject, F.lit(seed)), F.lit(per_subject)) == slot
    return spark.range(len(subjects) * per_subject).select(n.alias("ordinal"), pick(subjects, subject).alias("subject"), slot.alias("slot"), pick(formats, subject + slot).alias("format"), pick(kinds, slot).alias("kind"), held.alias("held_out"))


def suite_record(records: DataFrame, source: str) -> DataFrame:
    """Decision records in the suite's form: the target moves to the question's label, the rest to ``_meta``."""
    q = F.col("input.questions")["decision"]
    return records.select(
        F.col("input.state").alias("state"),
        F.create_map(F.lit("decision"), F.struct(q["type"].alias("type"), q["instructions"].alias("instructions"), q["criteria"].alias("criteria"), F.col("reference.target").alias("label"), F.lit(source).alias("src"))).alias("questions"),
        F.struct("id", F.lit(source).alias("source"), "family", F.col("reference.human_reviewed").alias("human_reviewed")).alias("_meta"),
    )


def training_messages(records: DataFrame, system: str) -> DataFrame:
    """(id, messages): system, user and assistant message of each record."""
    q = F.col("input.questions")["decision"]
    user = F.concat_ws("\n\n", F.col("input.state"), q["instructions"], q["criteria"])
    return records.select("id", F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("reference.target").alias("content"))).alias("messages"))


def teacher_targets(df: DataFrame, key: str, labels: str, weights: str, author: str) -> tuple[DataFrame, DataFrame]:
    """(targets, review): normalised probabilities with their argmax, and the rows where it is not the author's label."""
    p = stats.normalise(F.col(weights))
    out = df.withColumn("p", p).withColumn("target", F.get(F.col(labels), stats.argmax(p)))
    return out, out.where(~F.col("target").eqNullSafe(F.col(author)))


def worksheet_and_key(df: DataFrame, shown: Sequence[str], hidden: Sequence[str], *content: str) -> tuple[DataFrame, DataFrame]:
    """A blind worksheet and its key, as two projections that share an ordinal."""
    placed = label_blind_order(df, *content)
    return placed.select("place", *shown), placed.select("place", *hidden)


def review_histogram(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))

