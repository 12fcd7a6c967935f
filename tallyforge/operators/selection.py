"""Sorting, limits and label-blind samples.  Orders come from SHA-256 of seed and key, so every engine agrees on them."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int | str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def simple_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by hash order, sorted by key again."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n).orderBy(key)


def first_rows(df: DataFrame, order: str, n: int, offset: int = 0) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(n)


def _least_of_group(df: DataFrame, by: Sequence[str], hashed: Column, key: str, most: int) -> DataFrame:
    """Rows ranked by hash within groups, ranks above ``most`` left out; groups are spread by hash first, so a hot group's tail never meets in one task."""
    spread = df.withColumn("_h", hashed).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(32)))
    near = spread.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy("_h", key))).where(F.col("_r") <= most)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))).where(F.col("rank") <= most).drop("_h", "_salt", "_r")


def stratified_sample(df: DataFrame, outer: str, inner: str, key: str, per_outer: int, seed: int) -> DataFrame:
    """``per_outer`` rows of each outer group, evenly over its inner ones; the remainder rotates with the outer group's place."""
    cells = df.select(outer, inner).distinct()
    placed = cells.withColumn("_i", F.dense_rank().over(Window.orderBy(outer)) - 1).withColumn("_j", F.row_number().over(Window.partitionBy(outer).orderBy(inner)) - 1).withColumn("_m", F.count("*").over(Window.partitionBy(outer)))
    extra = F.pmod(F.col("_j") - F.col("_i"), F.col("_m")) < per_outer % F.col("_m")
    quota = placed.select(F.col(outer).alias("_o"), F.col(inner).alias("_n"), (F.floor(F.lit(per_outer) / F.col("_m")) + extra.cast("int")).alias("quota"))
    ranked = _least_of_group(df, [outer, inner], hash_order(F.col(key), seed), key, per_outer)
    return ranked.join(quota, F.col(outer).eqNullSafe(F.col("_o")) & F.col(inner).eqNullSafe(F.col("_n"))).where(F.col("rank") <= F.col("quota")).drop("_o", "_n", "quota", "rank")


def family_sample(df: DataFrame, family: str, domain: str, limit: int, seed: int) -> DataFrame:
    """Whole families, domains taking turns, until the first family that would exceed ``limit`` rows.

    Looks at no label.  A family's domain is its least one.  At most ``limit`` families of a domain can be taken, so only those are ordered.
    """
    families = df.groupBy(family).agg(F.min(domain).alias("_d"), F.count("*").alias("_n"))
    turn = _least_of_group(families, ["_d"], hash_order(F.col(family), seed), family, limit + 1)
    order = Window.orderBy("rank", "_d", family)
    first = turn.orderBy("rank", "_d", family).limit(limit + 1)
    running = first.withColumn("_upto", F.sum("_n").over(order))
    taken = running.where(F.col("_upto") <= limit).select(F.col(family).alias("_f"))
    return df.join(taken, F.col(family).eqNullSafe(F.col("_f")), "left_semi")


def exact_subset(families: Mapping[str, tuple[str, Mapping[str, int]]], count: int, seed: int, kinds: Sequence[str] = ("choice", "noul", "score")) -> list[str]:
    """Families that have exactly ``count`` rows together: of most domains, then with the most even rows of ``kinds``, then those first in hash order.

    ``families`` gives each family's domain and its rows of each type.  Evenness is the sum of (len(kinds) n - count)^2.  Of equal choices the
    one counts whose places in the order of SHA-256 of seed and name come first, compared place by place.  A dynamic programme over
    domains and, in them, families: a state is the rows of each type so far, with the number of domains and whether the present one is
    in use, and keeps its first choice, so the work grows with the number of states and not of subsets.  No choice stops.
    """
    names = sorted(families, key=lambda f: hashlib.sha256(f"{seed}:{f}".encode()).hexdigest())
    rows = [tuple(families[f][1].get(k, 0) for k in kinds) for f in names]
    totals = [sum(families[f][1].values()) for f in names]
    states: dict[tuple, tuple[int, ...]] = {(0, (0,) * len(kinds), 0): ()}
    for domain in sorted({families[f][0] for f in names}):
        inside = {(*state, False): chosen for state, chosen in states.items()}
        for i in (i for i, f in enumerate(names) if families[f][0] == domain and totals[i] > 0):
            for (total, by_kind, domains, used), chosen in list(inside.items()):
                if total + totals[i] > count:
                    continue
                state = (total + totals[i], tuple(map(sum, zip(by_kind, rows[i]))), domains + (not used), True)
                longer = tuple(sorted((*chosen, i)))
                if state not in inside or longer < inside[state]:
                    inside[state] = longer
        states = {}
        for (*state, _), chosen in inside.items():
            if (key := tuple(state)) not in states or chosen < states[key]:
                states[key] = chosen
    full = [(-domains, sum((len(kinds) * n - count) ** 2 for n in by_kind), chosen) for (total, by_kind, domains), chosen in states.items() if total == count and chosen]
    if not full:
        raise ValueError("no families have that many rows together")
    return sorted(names[i] for i in min(full)[2])


def exact_family_split(df: DataFrame, family: str, domain: str, kind: str, count: int, seed: int, kinds: Sequence[str] = ("choice", "noul", "score"), most: int = 200) -> DataFrame:
    """Rows of the families that ``exact_subset`` chooses.  A family's domain is its least one; more than ``most`` families stop the run, as the choice is made on the driver."""
    counted = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.min(domain).alias("_d"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds), F.count("*").alias("_n")).limit(most + 1).collect()
    if len(counted) > most:
        raise ValueError(f"more than {most} families")
    families = {r[family]: (r["_d"], {k: r[k] for k in kinds} | {"": r["_n"] - sum(r[k] for k in kinds)}) for r in counted}
    return df.where(F.col(family).isin(exact_subset(families, count, seed, kinds)))


def quotas(spark, domains: Sequence[str], kinds: Sequence[str], total: int) -> DataFrame:
    """(domain, kind, quota): rows dealt one by one to the domains in turn, each to the kind that turn asks for."""
    i = F.col("id")
    domain = F.get(F.array(*map(F.lit, domains)), (i % len(domains)).cast("int"))
    kind = F.get(F.array(*map(F.lit, kinds)), ((F.floor(i / len(domains)) + i % len(domains)) % len(kinds)).cast("int"))
    return spark.range(total).select(domain.alias("domain"), kind.alias("kind")).groupBy("domain", "kind").agg(F.count("*").alias("quota"))


def least_used(df: DataFrame, by: Sequence[str], source: str, uses: str) -> DataFrame:
    """The least used source of each group, the first by name of equal ones."""
    return df.groupBy(*by).agg(F.min_by(source, F.struct(uses, source)).alias(source))


def choose_source(pool: DataFrame, by: Sequence[str], source: str, attempted: str, selected: str, family_uses: str, ordinal: str, start: str, attempted_before: str | None = None, accepted_before: str | None = None, explore: int = 5) -> DataFrame:
    """(by, source): the source that each bucket tries next, from what its sources have tried and given.

    ``pool`` has a row for each bucket and source; ``ordinal`` and ``start`` are the bucket's.  Up to ``start``, where it is null, and at every ``explore``-th turn after it, the source
    with the fewest attempts is taken, then the one whose family has the fewest uses, that gave least, the first by name.  At other turns the best smoothed
    acceptance (s + 1) / (t + 4) wins, then fewest uses, gifts and attempts, then the name; attempts and gifts before a window are taken off first.  Counts that the
    window makes negative, or more gifts than attempts, stop.  A loop over turns calls this once for each turn of all buckets.
    """
    t = F.col(attempted) - (F.coalesce(F.col(attempted_before), F.lit(0)) if attempted_before else 0)
    s = F.col(selected) - (F.coalesce(F.col(accepted_before), F.lit(0)) if accepted_before else 0)
    rate = F.when((t < 0) | (s < 0) | (s > t), F.raise_error(F.lit("the acceptance window does not fit the history")).cast("double")).otherwise((s + 1) / (t + 4))
    explores = F.col(start).isNull() | (F.col(ordinal) < F.col(start)) | ((F.col(ordinal) - F.col(start)) % explore == explore - 1)
    plain = F.struct(F.col(attempted).alias("a"), F.col(family_uses).alias("f"), F.col(selected).alias("g"), F.col(source).alias("name"))
    scored = F.when(~explores, F.struct((-rate).alias("r"), F.col(family_uses).alias("f"), F.col(selected).alias("g"), F.col(attempted).alias("a"), F.col(source).alias("name")))
    best = pool.groupBy(*by).agg(F.min(plain).alias("plain"), F.min(scored).alias("scored"))
    return best.select(*by, F.coalesce("scored.name", "plain.name").alias(source))


def top_by(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), key).limit(n)


def label_blind_order(df: DataFrame, *content: str) -> DataFrame:
    """(place, columns): rows in an order fixed by their content's hash.

    Places come from range partitions' sizes: hash prefixes are counted and summed up, and rows are numbered within theirs.
    """
    hashed = df.withColumn("_h", F.sha2(F.to_json(F.struct(*content)), 256)).withColumn("_p", F.substring("_h", 1, 3))
    before = hashed.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    inside = hashed.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_h", *content)))
    return inside.join(before, "_p").withColumn("place", (F.col("_i") + F.col("_before")).cast("long")).drop("_h", "_p", "_i", "_before")
