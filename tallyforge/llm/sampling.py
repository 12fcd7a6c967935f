"""Systematic sampling with prefix sums across partitions, for samples and mixes."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.stages import stage

RUN_ROWS = 50_000


def ranked(df: DataFrame, group: Sequence[str], key: str, seed: int = 0, level: Column | None = None) -> DataFrame:
    """``df`` with ``k``, the position from 1 of each row in its group in a random order fixed by ``key`` and ``seed``.

    With ``level``, a whole number, rows lie in order of it, and in random order within equal ones.  A two-level prefix sum: groups are cut
    into runs of about RUN_ROWS rows along the order, runs are counted and their counts summed up, and rows are numbered within their run.
    A group that holds most rows is as many runs as its size asks for, so no task holds more than a run.  Null group keys are a group;
    equal keys are numbered side by side.
    """
    group = list(group)
    rows = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 1)).withColumn("_level", F.lit(0).cast("long") if level is None else level.cast("long"))
    largest = rows.groupBy(*group, "_level").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, largest / RUN_ROWS))))
    rows = rows.withColumn("_run", F.shiftrightunsigned(F.col("_h"), 63 - depth) if depth else F.lit(0).cast("long"))
    run = ["_level", "_run"]
    counts = rows.groupBy(*group, *run).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy(*run)) - F.col("_n")).drop("_n")
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*group, *run).orderBy("_h", key)))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in [*group, *run]]
    joined = numbered.alias("a").join(before.alias("b"), same)
    return joined.select("a.*", (F.col("a._i") + F.col("b._before")).cast("long").alias("k")).drop("_h", "_level", "_run", "_i")


def crossings(start: Column, rate: Column, k: Column) -> Column:
    """How many whole numbers the running sum passes from ``start`` over the first ``k`` items of size ``rate``."""
    return F.floor(start + k * rate) - F.floor(start)


def clean_label(column: Column) -> Column:
    """A label without outer blanks, in lower case, with blanks and ``-`` as ``_``."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]", "_")


CATEGORY = ["domain", "qtype", "subtopic"]


class TargetSample:
    """A sample of ``size_permille`` of the eligible ids whose shares match given target proportions.

    Eligible is each distinct non-null id whose cleaned category is in ``targets(domain, qtype, subtopic, target_permille, min_rows)``.
    Categories are sorted and laid end to end, each id as long as its inclusion probability; ids within a category lie in random order;
    one random start selects every id that a whole number falls into.  Each category thus gets its target rounded up or down.  Where
    that is below ``min_rows``, the next ids in the random order are added.  Null targets and floors count as 0; with no eligible ids the
    sample is empty and every category with a positive floor is short.  An id whose rows fall into several categories is eligible in
    each, but is placed in the least of them, and the sample is planned from what is placed.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, size_permille: int = 100, seed: int = 0):
        self.seed = seed
        wanted = targets.select(*CATEGORY, *(clean_label(F.col(c)).alias(f"c_{c}") for c in CATEGORY), F.coalesce("target_permille", F.lit(0)).alias("target_permille"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"))
        labels = records.select("id", *(clean_label(F.col(c)).alias(f"c_{c}") for c in CATEGORY)).where(F.col("id").isNotNull())
        self.eligible = stage(labels.join(wanted, [f"c_{c}" for c in CATEGORY]).select("id", *CATEGORY).distinct(), "eligible")
        self.size = self.eligible.select("id").distinct().count() * size_permille // 1000
        counts = self.eligible.groupBy(*CATEGORY).agg(F.count("*").alias("eligible"))
        self.placed = self.eligible.groupBy("id").agg(F.min(F.struct(*CATEGORY)).alias("c")).select("id", "c.*")
        target = F.col("target_permille") * F.lit(self.size).cast("long")
        self.categories = (
            wanted.select(*CATEGORY, "target_permille", "min_rows")
            .join(counts, CATEGORY, "left")
            .fillna(0, ["eligible"])
            .withColumn("target_rows", target / 1000.0)
            .withColumn("needed", F.greatest(F.col("min_rows").cast("long"), F.expr(f"(target_permille * {self.size}L + 999L) div 1000L")))
        )

    def plan(self) -> DataFrame:
        """Categories with start, rate and the ids that the floor adds; as many rows as targets."""
        placed = self.placed.groupBy(*CATEGORY).agg(F.count("*").alias("placed"))
        length = F.least(F.col("placed").cast("double"), F.col("target_rows"))
        ordered = Window.orderBy(*CATEGORY).rowsBetween(Window.unboundedPreceding, -1)
        plan = self.categories.join(placed, CATEGORY, "left").fillna(0, ["placed"]).withColumn("start", F.lit(random.Random(self.seed).random()) + F.coalesce(F.sum(length).over(ordered), F.lit(0.0))).withColumn("rate", F.when(F.col("placed") > 0, length / F.col("placed")).otherwise(0.0))
        taken = crossings(F.col("start"), F.col("rate"), F.col("placed"))
        return plan.withColumn("added", F.greatest(F.lit(0), F.least(F.col("placed"), F.col("min_rows")) - taken))

    def rows(self) -> DataFrame:
        """(id, domain, qtype, subtopic) of the sample."""
        placed = ranked(self.placed, CATEGORY, "id", self.seed).join(self.plan().select(*CATEGORY, "start", "rate", "added"), CATEGORY)
        upto = crossings(F.col("start"), F.col("rate"), F.col("k"))
        hit = (upto > crossings(F.col("start"), F.col("rate"), F.col("k") - 1)) | (F.col("rate") >= 1)
        return placed.where(hit | (F.col("k") - upto <= F.col("added"))).select("id", *CATEGORY)

    def report(self) -> DataFrame:
        """Each category with its target, its floor, what there was and what the sample has.

        ``needed`` is the greater of floor and target rounded up, ``least_rows`` of floor and target rounded down.  ``met`` says that the sample has
        at least ``least_rows``; ``missing`` is what it lacks of ``needed``, which is below one row of rounding where ``met`` holds.  ``target_share`` is that of
        the targets, ``actual_share`` that of the rows sampled: what short categories lack isn't placed elsewhere, so others' rows
        stay at their targets and their shares grow a little.
        """
        got = self.rows().groupBy(*CATEGORY).agg(F.count("*").alias("sampled"))
        least = F.greatest(F.col("min_rows").cast("long"), F.expr(f"target_permille * {self.size}L div 1000L"))
        joined = self.categories.join(got, CATEGORY, "left").fillna(0, ["sampled"]).withColumn("least_rows", least)
        whole = Window.partitionBy()
        return joined.withColumns({
            "met": F.col("sampled") >= F.col("least_rows"), "missing": F.greatest(F.lit(0).cast("long"), F.col("needed") - F.col("sampled")),
            "target_share": F.col("target_permille") / 1000.0, "actual_share": F.try_divide(F.col("sampled"), F.sum("sampled").over(whole)),
        })

    def unmet(self) -> DataFrame:
        """Categories whose sample lacks rows because fewer ids are eligible than target or floor ask for."""
        return self.report().where((F.col("missing") > 0) & (F.col("eligible") < F.col("needed")))


def target_sample(records: DataFrame, targets: DataFrame, **options) -> TargetSample:
    """The sample from decision records, whose question type is that of ``decision``."""
    flat = records.select("id", "domain", F.col("input.questions")["decision"]["type"].alias("qtype"), "subtopic")
    return TargetSample(flat, targets, **options)
