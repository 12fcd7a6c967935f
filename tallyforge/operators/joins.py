"""Joins: optional labels, exact cover, as-of, longest match, similarity, and the guards around them."""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyforge.functions.parse import match_key, token_set
from tallyforge.operators import aggregates
from tallyforge.operators.ordered import SPAN, same, spans
from tallyforge.operators.skew import hot_keys, spread_join
from tallyforge.operators.stages import drop_stage, spread, stage
from tallyforge.operators.validate import demand_none, demand_unique

NEEDLE_BYTES = 64_000_000
#: tokens whose counts order those of a set, and the 64-bit parts of a set's signature
COMMON = 20_000
_SIGNS = ("s0", "s1", "s2")
#: rows of a class of equal token sets beyond which its pairs are made in shares, and one over the number of such classes
SHARED, CLASSES = 2_000, 5_000


def with_results(rows: DataFrame, results: DataFrame, key: str = "id", prefix: str = "result_") -> DataFrame:
    """Every row with its result's columns; a missing result gives nulls, which metrics count as failed."""
    renamed = results.select(key, *(F.col(c).alias(prefix + c) for c in results.columns if c != key))
    return rows.join(renamed, key, "left")


def with_gold(rows: DataFrame, gold: DataFrame, key: str, label: str, vocabulary: DataFrame | None = None, unknown: str = "ignore") -> DataFrame:
    """Rows with an optional gold label.

    Null labels count as absent; a repeated id or a label outside ``vocabulary(label)`` stops; ids outside the rows are ignored, or stop with ``unknown="raise"``.
    """
    labels = gold.where(F.col(label).isNotNull()).select(key, label)
    demand_none(labels.groupBy(key).count().where("count > 1"), "repeated gold id")
    if vocabulary is not None:
        demand_none(labels.join(vocabulary.select(label).distinct(), label, "left_anti"), "gold label outside the vocabulary")
    if unknown == "raise":
        demand_none(labels.join(rows, key, "left_anti"), "gold id without a row")
    return rows.join(labels, key, "left")


def exact_cover(runs: Mapping[str, DataFrame], key: str, same: Sequence[str]) -> DataFrame:
    """All runs as one long table (run, columns), once each has the same ids exactly once and equal values in ``same``."""
    names = list(runs)
    tagged = None
    for name in names:
        part = runs[name].withColumn("run", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    digest = F.xxhash64(*same) if same else F.lit(0)
    each = tagged.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"), F.count_distinct(digest).alias("versions"))
    demand_none(each.where((F.col("n") != len(names)) | (F.col("runs") != len(names)) | (F.col("versions") > 1)), "runs do not cover the same rows")
    return tagged


def run_pairs(long: DataFrame, key: str, run: str, correct: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, left, right, both, neither, left_only, right_only, p_value) of each pair of runs.

    A row's runs are gathered per id, as many as there are runs, and paired there: one shuffle on the id, no self-join.
    """
    each = long.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"), F.col(correct).alias("c")))).alias("runs"))
    i_runs = F.transform("runs", lambda x, i: F.transform(F.slice("runs", i + 2, F.size("runs")), lambda y: F.struct(x["run"].alias("left"), y["run"].alias("right"), x["c"].alias("a"), y["c"].alias("b"))))
    pairs = each.select(*by, F.explode(F.flatten(i_runs)).alias("p"))
    return pairs.groupBy(*by, "p.left", "p.right").agg(*aggregates.pair_outcomes(F.col("p.a"), F.col("p.b")))


def paired_subsets(long: DataFrame, run: str, subset: str, key: str, correct: str, left: str, right: str) -> DataFrame:
    """The same run on two subsets with shared ids, paired by id."""
    one = long.where(F.col(subset) == left).select(run, key, F.col(correct).alias("a"))
    two = long.where(F.col(subset) == right).select(run, key, F.col(correct).alias("b"))
    return one.join(two, [run, key]).groupBy(run).agg(F.count("*").alias("pairs"), *aggregates.pair_outcomes(F.col("a"), F.col("b")))


def against_baselines(runs: DataFrame, baselines: DataFrame, on: Sequence[str], value: str, baseline: str, comparable: Column) -> DataFrame:
    """Runs with each published baseline; the difference only where the run is comparable."""
    joined = runs.join(baselines, list(on), "left")
    return joined.withColumn("difference", F.when(comparable, F.col(value) - F.col(baseline)))


def select_ids(records: DataFrame, ids: DataFrame, key: str = "id", family: str | None = None) -> DataFrame:
    """Exactly the records of a manifest; a missing id or a part of a family stops."""
    wanted = ids.select(key).distinct()
    demand_none(wanted.join(records, key, "left_anti"), "manifest id without a record")
    chosen = records.join(wanted, key, "left_semi")
    if family:
        rest = records.join(wanted, key, "left_anti")
        demand_none(rest.join(chosen.select(family).distinct(), family, "left_semi").select(key, family), "part of a family")
    return chosen


def pending(records: DataFrame, done: DataFrame, key: str = "id", retry: Column | None = None) -> DataFrame:
    """Records without a result yet; with ``retry``, results where it holds do not count as done."""
    finished = done if retry is None else done.where(~F.coalesce(retry, F.lit(False)))
    return records.join(finished.select(key), key, "left_anti")


def provenance_mismatches(rows: DataFrame, sources: DataFrame, source_id: str, key: str, same: Mapping[str, str]) -> DataFrame:
    """Rows whose source is unknown or differs from what they claim: (source_id, mismatch)."""
    looked = rows.alias("r").join(sources.alias("s"), F.col(f"r.{source_id}") == F.col(f"s.{key}"), "left")
    checks = [F.when(F.col(f"s.{key}").isNull(), "unknown source")] + [F.when(F.col(f"s.{key}").isNotNull() & ~F.col(f"r.{a}").eqNullSafe(F.col(f"s.{b}")), a) for a, b in same.items()]
    return looked.select(*(F.col(f"r.{c}") for c in rows.columns), F.explode(F.array_compact(F.array(*checks))).alias("mismatch"))


def asof(calls: DataFrame, questions: DataFrame, call_time: str, question_time: str, columns: Sequence[str], by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Calls with ``columns`` of the latest question at or before them, of the same ``by``; of equal times the first by ``tie``.

    Both sides are laid on one timeline and the last question is carried forward, one sort and no range join.  The timeline is cut into spans
    of about equal row counts, and the last question of each span is carried to the spans after it, so that no task holds a whole timeline, even
    without ``by`` or where one moment has most rows.  Null keys are a group; calls without a time match nothing.
    """
    by = list(by)
    kept = F.struct(*(F.col(c).alias(c) for c in columns), F.lit(True).alias("_found"))
    tie_key = F.col(tie) if tie else F.lit(0)
    latest = questions.where(F.col(question_time).isNotNull()).groupBy(*by, question_time).agg(F.min_by(kept, tie_key).alias("_q"))
    hashable = [f.name for f in calls.schema.fields if "map<" not in f.dataType.simpleString()]
    hashed = F.xxhash64(*hashable) if hashable else F.lit(0).cast("long")
    q = latest.select(*by, F.col(question_time).alias("_t"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_n"), "_q", F.lit(None).cast(calls.select(F.struct("*").alias("c")).schema["c"].dataType).alias("_c"))
    c = calls.select(*by, F.col(call_time).alias("_t"), F.lit(1).alias("_side"), hashed.alias("_n"), F.lit(None).cast(latest.schema["_q"].dataType).alias("_q"), F.struct("*").alias("_c"))
    line = spans(q.unionByName(c), by, ["_t", "_side", "_n"])
    order = Window.partitionBy(*by).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    ends = line.groupBy(*by, SPAN).agg(F.max_by(F.when(F.col("_q").isNotNull(), F.col("_q")), F.when(F.col("_q").isNotNull(), F.col("_t"))).alias("_end"))
    before = ends.select(*by, SPAN, F.last("_end", ignorenulls=True).over(order).alias("_before"))
    inside = line.withColumn("_own", F.last("_q", ignorenulls=True).over(Window.partitionBy(*by, SPAN).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)))
    out = inside.where("_side = 1").alias("i").join(before.alias("b"), same("i", "b", [*by, SPAN]), "left").select("i._c", F.when(F.col("i._t").isNotNull(), F.coalesce("i._own", "b._before")).alias("_m"))
    return out.select("_c.*", *(F.col(f"_m.{c}").alias(f"matched_{c}") for c in columns))


_AUTOMATA: dict[str, tuple] = {}


def _automaton(block: tuple[str, dict]):
    """The automaton of a block of needles, built once in each worker process and kept for the tasks that follow."""
    name, needles = block
    if name not in _AUTOMATA:
        import ahocorasick

        made = ahocorasick.Automaton()
        for n, i in needles.items():
            made.add_word(n, (len(n), i))
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = made
    return _AUTOMATA[name]


def longest_match(texts: DataFrame, text: str, needles: DataFrame, needle: str, needle_id: str, key: str, least: int = 1) -> DataFrame:
    """(key, needle_id, length): for each text the longest needle it contains, the first by id of equal ones; texts without one are left out.

    The needles make one automaton, broadcast once their total size is known to be at most NEEDLE_BYTES; more come in several blocks of that
    size, of which the driver holds one at a time, with one scan of the texts for each.  Each text is read once for all needles of a block.
    """
    spark = texts.sparkSession
    usable = needles.where(F.length(needle) >= least).select(F.col(needle_id).alias("i"), F.col(needle).cast("string").alias("n"))
    kind, id_kind = texts.schema[key].dataType.simpleString(), needles.schema[needle_id].dataType.simpleString()
    id_type = to_arrow_type(needles.schema[needle_id].dataType)
    schema = f"key {kind}, needle_id {id_kind}, length int"
    source = spread(texts.where(F.col(text).isNotNull()).select(key, F.col(text).cast("string").alias("_text")))

    def scan(block: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches):
            automaton = _automaton(shared.value)
            for batch in batches:
                keys, ids, lengths = [], [], []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    best = None
                    for _, (length, i) in automaton.iter(t):
                        if best is None or (-length, i) < best:
                            best = (-length, i)
                    if best:
                        keys.append(k)
                        ids.append(best[1])
                        lengths.append(-best[0])
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(ids, id_type), pa.array(lengths, pa.int32())], names=["key", "needle_id", "length"])

        return source.mapInArrow(run, schema)

    found, block, size = [], {}, 0
    for row in usable.groupBy("n").agg(F.min("i").alias("i")).toLocalIterator():
        if size >= NEEDLE_BYTES:
            found.append(stage(scan(block), "matches"))
            block, size = {}, 0
        block[row["n"]] = row["i"]
        size += len(row["n"].encode())
    if block:
        found.append(scan(block))
    if not found:
        return spark.createDataFrame([], schema)
    if len(found) == 1:
        return found[0]
    best = F.min(F.struct((-F.col("length")).alias("l"), "needle_id"))
    return reduce(DataFrame.unionByName, found).groupBy("key").agg(best.alias("m")).select("key", F.col("m.needle_id"), (-F.col("m.l")).alias("length"))


def cascade(calls: DataFrame, questions: DataFrame, key: str, text: str, question: str, question_id: str, call_time: str, question_time: str, least_normal: int = 6) -> DataFrame:
    """(key, question_id, method): a call's question by its literal text, else by normalised text, else the latest before it, else none."""
    raw = longest_match(calls, text, questions, question, question_id, key)
    normal_calls = calls.withColumn("_n", match_key(F.col(text)))
    normal_questions = questions.withColumn("_n", match_key(F.col(question)))
    normal = longest_match(normal_calls, "_n", normal_questions, "_n", question_id, key, least_normal)
    near = asof(calls.select(key, call_time), questions, call_time, question_time, [question_id], tie=question_id)
    joined = (
        calls.select(key)
        .join(raw.select(F.col("key").alias(key), F.col("needle_id").alias("_raw")), key, "left")
        .join(normal.select(F.col("key").alias(key), F.col("needle_id").alias("_normal")), key, "left")
        .join(near.select(key, F.col(f"matched_{question_id}").alias("_near")), key, "left")
    )
    method = F.when(F.col("_raw").isNotNull(), "raw").when(F.col("_normal").isNotNull(), "normalised").when(F.col("_near").isNotNull(), "as-of").otherwise("unmatched")
    return joined.select(key, F.coalesce("_raw", "_normal", "_near").alias(question_id), method.alias("method"))


def positional(left: DataFrame, right: DataFrame, place: str, key: str) -> DataFrame:
    """Two tables zipped by their place, whose keys must agree at every place."""
    joined = left.alias("l").join(right.alias("r"), place, "full")
    demand_none(joined.where(~F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))).select(place), "keys differ at a place")
    return left.join(right.drop(key), place)


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row in order of each key, by an aggregate that combines before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), order).alias("_r")).select("_r.*")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows by which two tables differ, with the side that has them more often: empty if they hold the same rows equally often."""
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("_s")).unionByName(right.select(*columns, F.lit(-1).alias("_s")))
    return both.groupBy(*columns).agg(F.sum("_s").alias("surplus")).where("surplus <> 0")


def gated_gold(rows: DataFrame, gold: DataFrame, key: str, digest: str, label: str) -> DataFrame:
    """Gold labels only for rows whose input is still the one that was labelled."""
    return rows.join(demand_unique(gold, key, digest).select(key, digest, label), [key, digest], "left")


def _heads(frequency: Mapping[str, int], threshold: float):
    """A function of token sets: their first tokens from rare to common, and their signature."""

    @F.pandas_udf("head array<string>, " + ", ".join(f"{x} long" for x in _SIGNS))
    def heads(sets: pd.Series) -> pd.DataFrame:
        bit: dict[str, int] = {}
        out = []
        for tokens in sets:
            sign = 0
            for w in tokens:
                if (b := bit.get(w)) is None:
                    b = bit[w] = 1 << zlib.crc32(w.encode()) % (64 * len(_SIGNS))
                sign ^= b
            first = sorted(tokens, key=lambda w: (frequency.get(w, 0), w))[: len(tokens) - math.ceil(len(tokens) * threshold - 1e-9) + 1]
            out.append((first, *struct.unpack(f"<{len(_SIGNS)}q", sign.to_bytes(8 * len(_SIGNS), "little"))))
        return pd.DataFrame(out, columns=["head", *_SIGNS])

    return heads


def _rows_of_classes(pairs: DataFrame, end: str, copies: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Pairs whose column ``end`` is the least key of a class of ``c_<end>`` rows, as pairs with every row of the class; ``copies`` has those of classes of more than one."""
    one, more = pairs.where(F.col(f"c_{end}") == 1), pairs.where(F.col(f"c_{end}") > 1)
    members = copies.select(F.col("least").alias(end), F.col("k").alias("_k"))
    return one.unionByName(spread_join(members, more, [end], hot, "_k").drop(end).withColumnRenamed("_k", end))


def _with_copies(near: DataFrame, classes: DataFrame, rows: DataFrame, prior: bool) -> DataFrame:
    """Near pairs of classes as pairs of their rows and, within one table, the pairs of rows of each class."""
    large = classes.where("c > 1").select("h", "side", F.col("k").alias("least"), "c")
    hot = hot_keys(large, ["least"], "c", CLASSES, SHARED)
    members = stage(spread_join(rows.where("k is not null"), large.drop("c"), ["h", "side"], hot_keys(large, ["h", "side"], "c"), "k").select("least", "side", "k"), "copies")
    for end, side in (("a", "old" if prior else "new"), ("b", "new")):
        near = _rows_of_classes(near, end, members.where(F.col("side") == side), None if hot is None else hot.withColumnRenamed("least", end))
    if prior:
        return near.select("a", "b", "similarity")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    first, second = (members.select("least", F.col("k").alias(x)) for x in "ab")
    return near.unionByName(spread_join(first, second, ["least"], hot, "a").where("a < b").select("a", "b", F.lit(1.0).alias("similarity")))


def jaccard_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, prior: DataFrame | None = None, copies: bool = False) -> DataFrame:
    """(a, b, similarity), a < b: pairs of rows whose token sets have a Jaccard similarity of at least ``threshold``; with ``prior``, pairs (prior row, row).

    Exact, by prefix filtering: tokens are ordered from rare to common, and sets that are similar enough share a token among the first
    n - ceil(threshold n) + 1 of each, so only rare tokens are joined on.  The counts of the ``COMMON`` most frequent tokens order them; all others come
    before, by themselves.  Only keys, sizes, places and signatures are joined: a bit of a signature tells whether an odd number of the set's tokens fall on it, so two
    signatures differ in no more bits than the sets in tokens, which drops nearly all pairs before they are shuffled.  Pairs are made one each,
    and then the sets of those that are left are fetched.  Rows with equal token sets are one class, and classes are compared by their least keys.  With ``copies``, every
    pair of rows comes out, within a class and between the rows of two that are near, so the result grows with the square of a class, and those of more than
    ``SHARED`` rows are joined in shares.  Without, a near pair stands for those of its classes, and the rows of a class come out as pairs with its least key.
    A token that is among the rarest of very many sets, as where one pattern fills a third of the table, is joined in shares.  Null texts and texts without tokens
    are left out.
    """

    def base(side: DataFrame, name: str) -> DataFrame:
        rows = side.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.array_sort(token_set(F.col(text))).alias("t")).where(F.size("t") > 0)
        return rows.withColumn("h", F.sha2(F.array_join("t", " "), 256)).withColumn("side", F.lit(name))

    sets = stage(base(df, "new") if prior is None else base(df, "new").unionByName(base(prior, "old")), "token-sets")
    every = stage(sets.groupBy("h", "side", "t").agg(F.min("k").alias("k"), F.count("k").alias("c")), "classes")
    rows = stage(sets.select("h", "side", "k"), "keys")
    drop_stage(sets)
    frequency = every.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("f")).orderBy(F.desc("f"), "w").limit(COMMON)
    heads = _heads({r["w"]: r["f"] for r in frequency.collect()}, threshold)
    signed = spread(every.select("k", "side", F.size("t").alias("n"), "t")).select("k", "side", "n", heads("t").alias("p"))
    prefix = stage(signed.select("k", "side", "n", *(F.col(f"p.{x}") for x in _SIGNS), F.posexplode("p.head").alias("i", "w")), "prefixes")
    a, b = (prefix.select("w", *(F.col(c).alias(f"{c}_{s}") for c in ("k", "side", "n", "i", *_SIGNS))) for s in "ab")
    sides = F.lit(True) if prior is None else (F.col("side_a") == "old") & (F.col("side_b") == "new")
    order = F.col("k_a") < F.col("k_b") if prior is None else F.lit(True)
    sizes = (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9)
    # the tokens before and after the shared one bound the overlap
    most = F.least("i_a", "i_b") + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    enough = most >= (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9
    # tokens that only one of the sets has: at least as many as the signatures differ in
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in _SIGNS))
    enough = enough & (apart <= (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    hot = hot_keys(prefix.groupBy("w").agg(F.count("*").alias("c")), ["w"], "c")
    candidates = stage(spread_join(a, b, ["w"], hot, "k_a").where(order & sides & sizes & enough).select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct(), "candidates")
    old = every.where(F.col("side") == ("new" if prior is None else "old")).select(F.col("k").alias("a"), F.col("t").alias("ta"), F.col("c").alias("c_a"))
    new = every.where("side = 'new'").select(F.col("k").alias("b"), F.col("t").alias("tb"), F.col("c").alias("c_b"))
    both = candidates.join(old, "a").join(new, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    near = both.select("a", "b", (shared / (F.size("ta") + F.size("tb") - shared)).alias("similarity"), "c_a", "c_b").where(F.col("similarity") >= threshold)
    if copies:
        return _with_copies(stage(near, "near"), every, rows, prior is not None)
    near = near.drop("c_a", "c_b")
    if prior is not None:
        return near
    repeated = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("k").alias("a")).where("c > 1")
    equal = spread_join(rows.select("h", F.col("k").alias("b")), repeated.select("h", "a"), ["h"], hot_keys(repeated, ["h"], "c"), "b").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return near.unionByName(equal)


def compare_runs(long: DataFrame, key: str, run: str, correct: str, family: str, kind: str) -> dict[str, DataFrame]:
    """The whole comparison of runs: accuracy with interval, by type, complete families, and each pair of runs."""
    typed = long.withColumn("type", F.explode(F.array(F.col(kind), F.lit("all")))) if kind != "type" else long.withColumn("type", F.explode(F.array(F.col("type"), F.lit("all"))))
    return {
        "accuracy": aggregates.accuracy_block(typed, [run, "type"], correct),
        "families": aggregates.family_complete(long, family, correct, [run]),
        "pairs": run_pairs(long, key, run, correct),
    }

