"""Percentiles of very large numeric columns from mergeable log-bucket counts.

A value x > 0 falls into bucket ceil(log_g x) with g = (1 + e) / (1 - e); every
value of a bucket is within a factor (1 +- e) of the bucket's mark
2 g^i / (g + 1).  Zero has its own bucket and negative values mirror the
positive ones, with the sign in the bucket.  Counts of equal buckets add up, so
sketches of days or partitions combine into that of the whole, and the mark of
the bucket that holds a rank is within relative error e of the value at that
rank.  All of it is built-in expressions; the partial aggregation reduces each
task's rows to its buckets before the shuffle, however hot a group is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.01
LARGEST = 1.7976931348623157e308
OWN = ("sign", "bucket", "n", "error_bound")


def gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the error bound must lie between 0 and 1")
    inner = error * (1 - 1e-9)
    return (1 + inner) / (1 - inner)


def valid(column: Column, negatives: bool = False) -> Column:
    """Finite, and not negative unless ``negatives``."""
    finite = column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))
    return finite if negatives else finite & (column >= 0)


def bucket_of(column: Column, error: float = ERROR) -> Column:
    """(sign, bucket) of a value as one sortable struct; for sign -1 the bucket is negated, so that order follows the values."""
    index = F.ceil(F.log(F.abs(column)) / F.lit(math.log(gamma(error)))).cast("int")
    return F.struct(
        F.when(column > 0, 1).when(column < 0, -1).otherwise(0).alias("sign"),
        F.when(column > 0, index).when(column < 0, -index).otherwise(0).alias("bucket"),
    )


def _keys(by: Sequence[str]) -> list[str]:
    if clash := sorted({*by} & {*OWN}):
        raise ValueError(f"rename the group columns {', '.join(clash)}: sketches have columns of these names")
    return list(by)


def sketch(df: DataFrame, value: str, by: Sequence[str], error: float = ERROR, negatives: bool = False) -> DataFrame:
    """(by, sign, bucket, error_bound, n): bucket counts of the valid values of each group.

    Null, NaN and infinite values don't count, nor negative ones unless ``negatives``; a group with no valid value has no rows; a null
    group key is a group of its own; an empty table gives an empty sketch.
    """
    by = _keys(by)
    rows = df.where(valid(F.col(value), negatives)).select(*by, bucket_of(F.col(value).cast("double"), error).alias("at"))
    return rows.groupBy(*by, F.col("at.sign").alias("sign"), F.col("at.bucket").alias("bucket")).agg(F.lit(float(error)).alias("error_bound"), F.count("*").alias("n"))


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of finer groups, days or partitions as those of ``by``.  Buckets of different error bounds stay apart, and ``percentiles`` refuses them."""
    return sketches.groupBy(*_keys(by), "sign", "bucket", "error_bound").agg(F.sum("n").alias("n"))


def _mark(sign: Column, bucket: Column, bound: Column) -> Column:
    """The value that stands for a bucket, within the bound of all its values.  The power is one below the bucket's upper end, so it is finite for every double."""
    inner = bound * (1 - 1e-9)
    g = (1 + inner) / (1 - inner)
    return sign * F.least(F.lit(LARGEST), F.pow(g, bucket * sign - 1) * (1 + inner))


def percentiles(sketches: DataFrame, by: Sequence[str], points: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(by, n, p<point>..., error_bound): the mark of the bucket that holds rank floor(q (n - 1)) + 1 of each group.

    The true value v at that rank satisfies |mark - v| <= error_bound |v|.  A group whose sketches have different bounds stops.  A group has
    at most 2 ln(1.8e308 / 4.9e-324) / ln g + 1 buckets, 146,000 at an error of 0.01, which bounds the window whatever the number of values.
    """
    by = _keys(by)
    order = Window.partitionBy(*by).orderBy("sign", "bucket")
    whole = Window.partitionBy(*by)
    ranked = sketches.withColumn("_upto", F.sum("n").over(order)).withColumn("_total", F.sum("n").over(whole))
    rank = lambda q: F.floor(F.lit(float(q)) * (F.col("_total") - 1))
    aggs = [F.min(F.when(F.col("_upto") > rank(q), F.struct("sign", "bucket"))).alias(f"p{q * 100:g}".replace(".", "_")) for q in points]
    made = ranked.groupBy(*by).agg(F.max("_total").alias("n"), *aggs, F.min("error_bound").alias("error_bound"), F.max("error_bound").alias("_other"))
    same = F.when(F.col("error_bound") == F.col("_other"), F.col("error_bound")).otherwise(F.raise_error(F.lit("sketches have different error bounds")).cast("double"))
    marks = [_mark(F.col(c)["sign"], F.col(c)["bucket"], F.col("error_bound")).alias(c) for c in (f"p{q * 100:g}".replace(".", "_") for q in points)]
    return made.select(*by, "n", *marks, F.when(F.col("n").isNotNull(), same).alias("error_bound"))
