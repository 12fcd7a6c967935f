"""Set operations over releases, families and inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.validate import demand_none, demand_unique


def union_releases(releases: Sequence[DataFrame], key: str, digest: str) -> DataFrame:
    """All releases as one; a repeated key or input stops."""
    out = releases[0]
    for part in releases[1:]:
        out = out.unionByName(part)
    return demand_unique(demand_unique(out, key), digest)


def overlaps(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of the non-null values that both sides have, for each column on its own, in one shuffle."""

    def values(df: DataFrame, side: int) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x"), F.lit(side).alias("s")).select("x.*", "s").where(F.col("value").isNotNull())

    return values(left, 1).unionByName(values(right, 2)).groupBy("column", "value").agg(F.bit_or("s").alias("s")).where("s = 3").drop("s")


def demand_separate(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> None:
    demand_none(overlaps(left, right, columns), "both sides have")


def split_families(rows: DataFrame, family: str, outer: DataFrame, inner: DataFrame) -> dict[str, DataFrame]:
    """Rows of outer families, of inner ones, of neither, and of the outer ones' complement."""
    out, rest = rows.join(outer.select(family).distinct(), family, "left_semi"), rows.join(outer.select(family).distinct(), family, "left_anti")
    chosen = inner.select(family).distinct()
    return {"outer": out, "complement": rest, "inner": rest.join(chosen, family, "left_semi"), "training": rest.join(chosen, family, "left_anti")}


def id_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, state): ids that are ``missing`` or ``extra``."""
    both = expected.select(key, F.lit(1).alias("s")).unionByName(actual.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.bit_or("s").alias("s"))
    return both.where("s < 3").select(key, F.when(F.col("s") == 1, "missing").otherwise("extra").alias("state"))


def disagreements(df: DataFrame, baseline: str, prediction: str) -> DataFrame:
    """Rows whose labels differ; null differs from a label but not from null."""
    return df.where(~F.col(baseline).eqNullSafe(F.col(prediction)))


def unique_inputs(df: DataFrame, digest: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(first of each input, the others), by digest; the first is that of the least key."""
    marked = df.withColumn("_d", digest)
    first = marked.groupBy("_d").agg(F.min(key).alias(key))
    return marked.join(first, ["_d", key], "left_semi").drop("_d"), marked.join(first, ["_d", key], "left_anti").drop("_d")


def repeated_inputs(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """(digest, first, n) of the inputs that occur more than once: the whole group is refused."""
    return df.groupBy(digest.alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
