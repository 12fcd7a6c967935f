"""Ordered computations within one question, request or session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ordered import numbered, running


def call_roles(df: DataFrame, question: str, ts: str, tie: str) -> DataFrame:
    """The last call of a question is its ``summary``, the others are ``exec #k`` in order of time."""
    order = Window.partitionBy(question).orderBy(ts, tie)
    last = F.lead(F.lit(1)).over(order).isNull()
    return df.withColumn("role", F.when(last, "summary").otherwise(F.concat(F.lit("exec #"), F.row_number().over(order).cast("string"))))


def occurrences(df: DataFrame, question: str, stage: str, ts: str, tie: str, unmatched: str = "UNMATCHED") -> DataFrame:
    """The number of each call among those of its question and stage; calls without a question are numbered together, in spans so that no task holds them all."""
    known = Window.partitionBy(question, stage).orderBy(ts, tie)
    own = df.where(F.col(question).isNotNull()).withColumn("occurrence", F.row_number().over(known).cast("long"))
    lost = numbered(df.where(F.col(question).isNull()), [stage], [ts, tie], "occurrence")
    return own.unionByName(lost).withColumn(question, F.coalesce(F.col(question).cast("string"), F.lit(unmatched)))


def inter_arrival(df: DataFrame, request: str, arrival: str, tie: str) -> DataFrame:
    """Milliseconds since the event before, for the first since the start."""
    order = Window.partitionBy(request).orderBy(arrival, tie)
    return df.withColumn("latency", F.col(arrival) - F.lag(arrival, 1, 0).over(order))


def output_intervals(df: DataFrame, request: str, arrival: str) -> DataFrame:
    """(request, chunks, ttft, mean_interval): first arrival and (last - first) / (n - 1), null for one chunk."""
    return df.groupBy(request).agg(F.count(arrival).alias("chunks"), F.min(arrival).alias("ttft"), F.try_divide(F.max(arrival) - F.min(arrival), F.count(arrival) - 1).alias("mean_interval"))


def alternation(df: DataFrame, kind: str, order: str, methods: Sequence[str] = ("c2d", "d2c")) -> DataFrame:
    """Methods in turn within each kind, however many rows a kind has."""
    turn = (F.col("_place") - 1) % len(methods)
    return numbered(df, [kind], [order], "_place").withColumn("method", F.get(F.array(*map(F.lit, methods)), turn.cast("int"))).drop("_place")


def round_robin(df: DataFrame, bucket: str, order: Column, limit: int, key: str) -> DataFrame:
    """The first ``limit`` rows when buckets take turns: (turn, bucket, key) order.  Only the first ``limit`` rows of a bucket are ever ranked to the end."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(order, F.col(key)))
    return df.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", bucket, key).limit(limit)


def prefixes(df: DataFrame, conversation: str, turn: str, text: str, sep: str = "\n") -> DataFrame:
    """Each turn with the texts of its conversation up to and including it."""
    order = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("prefix", F.array_join(F.collect_list(text).over(order), sep))


def rolling_budget(df: DataFrame, ts: str, amount: str, seconds: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """(columns, rolling_count, rolling_amount) over the last ``seconds`` up to each row.

    Rows go to their own time bucket and, as predecessors only, to the next one; a window over two buckets then sees all it needs, so one
    timeline spreads over as many tasks as it has buckets.
    """
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    wide = seconds * 1_000_000 * 60
    rows = df.withColumn("_at", moment).withColumn("_b", F.explode(F.array(F.floor(F.col("_at") / wide), F.floor(F.col("_at") / wide) + 1)))
    rows = rows.withColumn("_own", F.floor(F.col("_at") / wide) == F.col("_b")).where(F.col("_own") | (F.col("_at") > F.col("_b") * wide - (seconds * 1_000_000 + 1)))
    span = Window.partitionBy(*by, "_b").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    out = rows.withColumn("rolling_count", F.count("*").over(span)).withColumn("rolling_amount", F.sum(amount).over(span))
    return out.where("_own").drop("_at", "_b", "_own")


def acceptance_trend(df: DataFrame, bucket: str, ordinal: str, accepted: Column, explore: int = 5) -> DataFrame:
    """Smoothed acceptance (s + 1) / (t + 4) of the attempts before each one in its bucket; every ``explore``-th explores."""
    ran = running(df, [bucket], [ordinal], {"_s": F.coalesce(accepted.cast("long"), F.lit(0)), "_t": F.lit(1).cast("long")}, inclusive=False)
    return ran.withColumn("acceptance", (F.col("_s") + 1) / (F.col("_t") + 4)).withColumn("explores", F.col(ordinal) % explore == explore - 1).drop("_s", "_t")
