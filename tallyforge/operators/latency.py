"""Latency statistics with exact percentiles that never gather a group.

A percentile of rank r is found in two passes: values are counted in buckets of
equal leading digits, which tells the bucket that holds the rank, and only that
bucket's values, counted by value, are ordered.  No task holds more than one
bucket's distinct values, where the usual exact percentile aggregate keeps a
whole group's.  For approximate percentiles that combine across days see the
sketches for training data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.parse import valid_number


def _bucket(x: Column) -> Column:
    """A whole number that never decreases with the value: sign and base-2 logarithm in 64ths."""
    size = F.floor(F.log2(F.abs(x)) * 64) + 80_000
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0).cast("long")


def rank_values(df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """(by, n, one column for each rank): the value at each 1-based rank, which may use the group's count ``n``; null values are left out, null keys are a group."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x")).withColumn("_b", _bucket(F.col("_x")))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    order, whole = Window.partitionBy(*by).orderBy("_b"), Window.partitionBy(*by)
    placed = counts.withColumn("_upto", F.sum("_c").over(order)).withColumn("n", F.sum("_c").over(whole))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    wanted = placed.select(*by, "_b", "_c", "_upto", "n", asked.alias("_q")).where((F.col("_q.rank") <= F.col("_upto")) & (F.col("_q.rank") > F.col("_upto") - F.col("_c")))
    wanted = wanted.select(*by, "_b", "n", F.col("_q.name").alias("name"), (F.col("_q.rank") - (F.col("_upto") - F.col("_c"))).alias("rank"))
    on = lambda keys: [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    keys = [*by, "_b"]
    near = rows.alias("l").join(wanted.select(*keys).distinct().alias("r"), on(keys), "left_semi")
    tied = near.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    tied = tied.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_x")))
    hits = tied.alias("l").join(wanted.alias("r"), on(keys)).where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("l._c")))
    return hits.groupBy(*(F.col(f"r.{k}").alias(k) for k in by)).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("_x"))).alias(name) for name in ranks))


def nearest_rank(q: float) -> Column:
    """The ceil(q n)-th value."""
    return F.ceil(F.lit(q) * F.col("n") - 1e-9)


def below(q: float) -> Column:
    return F.floor(F.lit(q) * (F.col("n") - 1) + 1e-9) + 1


def interpolated(name: str, q: float) -> tuple[dict[str, Column], Column]:
    """Ranks for, and value of, the linear interpolation at position (n - 1) q."""
    at = F.lit(q) * (F.col("n") - 1)
    weight = at - F.floor(at + 1e-9)
    return {f"{name}_lo": below(q), f"{name}_hi": F.least(F.col("n"), below(q) + 1)}, F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.greatest(F.lit(0.0), weight)


def _stats(df: DataFrame, by: Sequence[str], value: str, nearest: Mapping[str, float], linear: Mapping[str, float], extra: Sequence[Column] = ()) -> DataFrame:
    by = list(by)
    ranks, columns = {name: nearest_rank(q) for name, q in nearest.items()}, [F.col(name) for name in nearest]
    for name, q in linear.items():
        own, column = interpolated(name, q)
        ranks |= own
        columns.append(column.alias(name))
    valid = df.withColumn("_v", F.when(valid_number(F.col(value).cast("double")), F.col(value).cast("double")))
    sums = valid.groupBy(*by).agg(F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"), *extra)
    points = rank_values(valid, by, "_v", ranks).select(*by, "n", *columns)
    if by:
        joined = sums.alias("s").join(points.alias("p"), [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in by], "left").select("s.*", F.coalesce("p.n", F.lit(0)).alias("n"), *(F.col(f"p.{c}") for c in [*nearest, *linear]))
    else:
        joined = sums.join(points, how="left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined


def latency_nearest(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, p50 interpolated, p95 nearest rank) of the valid values; nulls where a group has none."""
    return _stats(df, by, value, {"p95": 0.95}, {"p50": 0.5}).select(*by, "n", "mean", "p50", "p95")


def latency_nearest_both(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, p50, p95), both percentiles by nearest rank."""
    return _stats(df, by, value, {"p50": 0.5, "p95": 0.95}, {}).select(*by, "n", "mean", "p50", "p95")


def latency_linear(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, min, max, mean, median, p95), percentiles interpolated at position (n - 1) q."""
    return _stats(df, by, value, {}, {"median": 0.5, "p95": 0.95}).select(*by, "n", "min", "max", "mean", "median", "p95")


def throughput(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, p50, p95, p99 interpolated, per_second = 1000 / mean milliseconds)."""
    return _stats(df, by, value, {}, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*by, "n", "mean", "p50", "p95", "p99", F.try_divide(F.lit(1000.0), "mean").alias("per_second"))


def with_total(df: DataFrame, by: str, label: str = "all") -> DataFrame:
    """Each row twice, once under ``label``: one plan then gives the groups and the whole."""
    return df.withColumn(by, F.explode(F.array(F.col(by).cast("string"), F.lit(label))))


def without_warmup(df: DataFrame, phase: str = "phase") -> DataFrame:
    """Rows outside the warm-up; a null phase is no warm-up."""
    return df.where(F.coalesce(F.col(phase) != "warmup", F.lit(True)))
