"""Splits that keep related records together.

Records are related through shared values; sets are the connected components
of the graph whose nodes are values and whose edges are records.  Components
come from hash-to-min: every node holds a cluster, sends it to the cluster's
minimum and tells every member that minimum, until nothing changes.  Clusters
are rows ``(node, member)``, never arrays, so the smallest node of a giant
component holds many rows and not one large one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import skew
from tallyforge.operators.skew import hot_keys, spread_join
from tallyforge.operators.stages import drop_stage, stage

SPLIT_BITS = {"train": 1, "validation": 2, "eval": 4, "test": 8}
MAX_ROUNDS = 60


def clean_link(column: Column) -> Column:
    """A linking value without outer blanks, in lower case, with ``_`` as ``-``; null stays null."""
    return F.translate(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), "_", "-")


def clean_split(column: Column) -> Column:
    """A split name without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def split_bit(column: Column) -> Column:
    """1, 2, 4, 8 for train, validation, eval, test; 0 for other values and null."""
    cleaned = clean_split(column)
    return reduce(lambda c, kv: c.when(cleaned == kv[0], F.lit(kv[1])), list(SPLIT_BITS.items())[1:], F.when(cleaned == "train", F.lit(1))).otherwise(F.lit(0))


def hash_to_min(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph ``edges(a long, b long)``: rows ``(node, component)``, component the smallest node.

    Self-loops are nodes without neighbours; rows with a null end are left out; repeated edges count once.  The number of rounds grows
    with the logarithm of the longest chain.  Each round is written to the shared folder, so lost executors cost one round at most.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    pairs = edges.select(F.explode(F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("member")) for x, y in ("ab", "ba", "aa", "bb")))).alias("p")).select("p.*")
    clusters = stage(pairs.distinct().withColumn("open", F.lit(True)), "clusters")
    for _ in range(MAX_ROUNDS):
        is_any_open, n = clusters.agg(F.max("open"), F.count("*")).first()
        if not is_any_open:
            return clusters.groupBy("node").agg(F.min("member").alias("component"))
        minimum, hot = clusters.groupBy("node").agg(F.min("member").alias("least"), F.count("*").alias("n")), None
        if n > skew.LEAST:  # the least node of a giant component holds most rows
            minimum = stage(minimum, "minimum")
            hot = hot_keys(minimum, ["node"], "n")
        # open: a node that is not the least of its cluster holds more than that least one
        is_open = (F.col("node") != F.col("least")) & (F.col("member") != F.col("least"))
        known = spread_join(clusters.select("node", "member"), minimum.select("node", "least"), ["node"], hot, "member").select("member", "least", is_open.alias("open"))
        sent = known.select(F.explode(F.array(F.struct(F.col("least").alias("node"), F.col("member")), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("p"), "open").select("p.*", "open")
        after = stage(sent.groupBy("node", "member").agg(F.max("open").alias("open")), "clusters")
        drop_stage(clusters)
        if n > skew.LEAST:
            drop_stage(minimum)
        clusters = after
    raise RuntimeError(f"clusters still change after {MAX_ROUNDS} rounds")


class RelatedSets:
    """Connected sets of records that share a value in any of ``fields``.

    ``df`` needs the unique whole number ``key``.  Rows with a null key are left out, as nothing can name them; rows without any value
    are in no set.  A node is a distinct value, named by twice the smallest key that has it plus the field's number in binary, so the
    smallest node of a component also gives the smallest key of the set.
    """

    def __init__(self, df: DataFrame, key: str = "record_no", fields: Sequence[str] = ("family", "source_family"), split: str = "split"):
        if len(fields) != 2:
            raise ValueError("two linking fields are needed")
        cleaned = [clean_link(F.col(f)) for f in fields]
        self.rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), cleaned[0].alias("v0"), cleaned[1].alias("v1"), split_bit(F.col(split)).alias("bit"))
        # one row for each pair of values: a hot family is aggregated before anything is shuffled
        linked = self.rows.where(F.coalesce("v0", "v1").isNotNull())
        pairs = linked.groupBy("v0", "v1").agg(F.min("key").alias("key"), F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
        self.pairs = stage(pairs, "pairs")
        # no key has more rows than there are
        n_pairs, n_rows = self.pairs.agg(F.count("*"), F.sum("n")).first()
        self.most_pairs, self.most_rows = (n_pairs, n_pairs), (n_rows, n_rows)
        name = lambda i: F.struct(F.col(f"v{i}").alias("value"), (F.col("key") * 2 + i).alias("id"))
        values = self.pairs.select(F.explode(F.array(name(0), name(1))).alias("x")).select("x.*").where(F.col("value").isNotNull()).groupBy("value").agg(F.min("id").alias("node"))
        self.values = stage(values, "values")
        edges = self.pairs
        for i in (0, 1):
            ends = self.values.select(F.col("value").alias(f"v{i}"), F.col("node").alias(f"n{i}"))
            hot = hot_keys(self.pairs.where(F.col(f"v{i}").isNotNull()).groupBy(f"v{i}").agg(F.count("*").alias("_n")), [f"v{i}"], "_n", known=self.most_pairs)
            edges = spread_join(edges, ends, [f"v{i}"], hot, "key", "left")
        edges = edges.select(F.coalesce("n0", "n1").alias("a"), F.coalesce("n1", "n0").alias("b"))
        self.labels = stage(self.values.join(hash_to_min(edges), "node").select("value", F.shiftright("component", 1).alias("set_no")), "labels")

    def value_sets(self) -> DataFrame:
        """(value, set_no): each linking value with the smallest key of its set."""
        return self.labels

    def sets(self) -> DataFrame:
        """(set_no, n_records, bits): size and splits of each set."""
        valued = self.pairs.withColumn("value", F.coalesce("v0", "v1"))
        hot = hot_keys(valued.groupBy("value").agg(F.count("*").alias("_n")), ["value"], "_n", known=self.most_pairs)
        labelled = spread_join(valued, self.labels, ["value"], hot, "key")
        return labelled.groupBy("set_no").agg(F.sum("n").alias("n_records"), F.bit_or("bits").alias("bits"))

    def members(self, sets: DataFrame | None = None) -> DataFrame:
        """(key, set_no), of all records with a value or of those in ``sets(set_no)``."""
        labels = self.labels if sets is None else self.labels.join(sets.select("set_no"), "set_no", "left_semi")
        rows = self.rows.where(F.coalesce("v0", "v1").isNotNull()).select("key", F.coalesce("v0", "v1").alias("value"))
        hot = hot_keys(self.pairs.groupBy(F.coalesce("v0", "v1").alias("value")).agg(F.sum("n").alias("_n")), ["value"], "_n", known=self.most_rows)
        return spread_join(rows, labels, ["value"], hot, "key").select("key", "set_no")

    def torn(self) -> DataFrame:
        """Sets whose records lie in more than one split."""
        return self.sets().where(F.bit_count("bits") > 1)


def rendezvous(key: Column, weights: Mapping[str, float], seed: int = 0) -> Column:
    """The split with the best weighted rendezvous score: -w / ln(u) for a uniform hash u of key, split and seed.

    A split of weight 0 gets nothing.  Changing one weight moves keys only to or from that split.
    """
    if not any(w > 0 for w in weights.values()):
        raise ValueError("some weight must be positive")
    uniform = lambda name: (F.shiftrightunsigned(F.xxhash64(key, F.lit(name), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    scores = [F.struct((F.lit(-float(w)) / F.log(uniform(name))).alias("score"), F.lit(name).alias("split")) for name, w in weights.items() if w > 0]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["split"]


def assign_splits(df: DataFrame, weights: Mapping[str, float], key: str = "record_no", seed: int = 0, large_share: float | None = None, **fields) -> DataFrame:
    """(key, set_no, new_split): every set in one split by weighted rendezvous hashing, so that shares of sets, and of records but for very large sets, are near ``weights``.

    A set's split depends on its smallest key, the weights and the seed alone: other records, or more of them, do not move it.  Records without a
    linking value are sets of their own.  A set that holds a large part of all records puts that part into one split; ``large_sets`` lists
    such sets.  With ``large_share``, sets with at least that share of all records, at most 1 / large_share of them, go largest first to the
    split that is furthest below its share, and the others are hashed on what is left; then totals may move a set.
    """
    related = RelatedSets(df, key, **fields)
    alone = related.rows.where(F.coalesce("v0", "v1").isNull()).select("key", F.col("key").alias("set_no"))
    chosen = rendezvous(F.col("set_no"), weights, seed)
    if large_share is not None:
        total = related.rows.count()
        share = {name: w / sum(weights.values()) for name, w in weights.items()}
        left, placed = {name: s * total for name, s in share.items()}, {}
        for row in _large(related, total, large_share).collect():
            placed[row["set_no"]] = best = max(left, key=lambda name: (left[name], name))
            left[best] -= row["n_records"]
        rest = {name: max(0.0, v) for name, v in left.items()}
        chosen = rendezvous(F.col("set_no"), rest if any(rest.values()) else share, seed)
        if placed:
            chosen = F.coalesce(F.create_map(*(F.lit(x) for kv in placed.items() for x in kv))[F.col("set_no")], chosen)
    return related.members().unionByName(alone).select(F.col("key").alias(key), "set_no", chosen.alias("new_split"))


def _large(related: RelatedSets, total: int, share: float) -> DataFrame:
    """(set_no, n_records) of the sets with at least that share of all records, the largest first: at most 1 / share rows."""
    return related.sets().select("set_no", "n_records").where(F.col("n_records") >= max(2, share * total)).orderBy(F.desc("n_records"), "set_no").limit(int(1 / share))


def large_sets(df: DataFrame, key: str = "record_no", share: float = 0.005, **fields) -> DataFrame:
    """(set_no, n_records, share) of the sets that by their size alone move the shares of splits."""
    related = RelatedSets(df, key, **fields)
    total = related.rows.count()
    return _large(related, total, share).withColumn("share", F.col("n_records") / F.lit(max(1, total)))


def torn_records(df: DataFrame, key: str = "record_no", **fields) -> DataFrame:
    """(key, set_no): all records of the sets which the present split tears apart."""
    related = RelatedSets(df, key, **fields)
    return related.members(related.torn()).select(F.col("key").alias(key), "set_no").distinct()
