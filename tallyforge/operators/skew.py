"""Joins whose left side may have most of its rows under a few keys.

A key is hot if it holds more than 1 / MOST of all rows and more than LEAST rows,
so there are fewer than MOST hot keys whatever the data, and their list may be
broadcast.  Rows of a hot key are spread over SALTS shares, and the right side's
row for it is repeated once for each share; all other keys are joined as usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 200
LEAST = 50_000
SALTS = 64


def hot_keys(counts: DataFrame, on: Sequence[str], n: str, most: int = MOST, least: int | None = None, known: tuple[int, int] | None = None) -> DataFrame | None:
    """The keys of ``counts(on, n)``, one row for each key, that hold more than 1 / ``most`` of all rows and more than ``least`` of them; None if there are none.

    ``known`` gives the number of all rows and of the largest key's, or a bound of the latter, where they need not be counted again.
    """
    least = LEAST if least is None else least
    if known is not None and (known[1] or 0) <= least:
        return None
    total, largest = known or counts.agg(F.sum(n), F.max(n)).first()
    bound = max((total or 0) / most, least)
    return counts.where(F.col(n) > F.lit(bound)).select(*on) if (largest or 0) > bound else None


def heavy_keys(df: DataFrame, on: Sequence[str], rows: int, most: int = MOST) -> DataFrame | None:
    """As ``hot_keys``, for keys that are nearly all different, so that counting them all would cost a shuffle of the table: keys that hold more than 1 / ``most`` of a
    sample of about 1000 ``most`` rows.  The sample only decides which keys are joined in shares; no row is left out of anything."""
    part = min(1.0, 1000 * most / max(1, rows))
    if rows <= LEAST:
        return None
    counts = df.select(*on).sample(part, seed=1).groupBy(*on).agg(F.count("*").alias("_n"))
    bound = part * max(rows / most, LEAST)
    keys = counts.where(F.col("_n") > F.lit(bound)).select(*on).collect()
    return df.sparkSession.createDataFrame(keys, df.select(*on).schema) if keys else None


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame | None, spread_by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right`` on the columns ``on``, hot keys of ``left`` in ``salts`` shares by the hash of ``spread_by``.

    ``hot`` has fewer than MOST rows, as ``hot_keys`` gives them; without any, this is a plain join.  Null keys match nothing.  ``how`` is inner, left or left_semi.
    """
    on = list(on)
    if hot is None:
        return left.join(right, on, how)
    marked = F.broadcast(hot.select(*on).distinct().withColumn("_hot", F.lit(True)))
    share = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    l = left.join(marked, on, "left").withColumn("_salt", F.when(F.col("_hot"), share).otherwise(0)).drop("_hot")  # noqa: E741
    shares = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    r = right.join(marked, on, "left").withColumn("_salt", shares).drop("_hot")
    return l.join(r, [*on, "_salt"], how).drop("_salt")
