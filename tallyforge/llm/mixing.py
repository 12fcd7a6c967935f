"""Mixing sources to target weights, by systematic sampling of documents' copies."""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.sampling import crossings, ranked
from tallyforge.operators.stages import spread, stage


def clean_source(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def token_counts(df: DataFrame, columns: list[str], tokenizer: str, text: str = "text") -> DataFrame:
    """``columns`` and ``tokens``, the length of the whole text in tokens of a byte-level BPE; null and empty texts have 0.

    ``tokenizer`` is a file of ranks that every executor can read.
    """
    source = spread(df.select(*columns, F.col(text).cast("string").alias("_text")))

    def run(batches):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokenizer).read_bytes().splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*columns, "tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return source.mapInArrow(run, f"{schema}, tokens long")


class SourceMix:
    """Documents of the listed sources, repeated so that each source gives its target share of all tokens.

    The total is that of all documents of listed sources.  A document's expected copies are its source's target tokens by the source's
    tokens, at most ``max_repeats``.  Within a source, documents lie in order of their size, in random order among those of one size class,
    expected copies are summed up from one random offset, and a document comes out once for each whole number its stretch holds: its
    expected copies rounded up or down.  In order of size, what one document has too many another of about that size has too few, so
    the tokens of a source stay near their target and not only its documents.
    Null sources are not listed; null texts have no tokens; a listed source without documents gives nothing and falls short if its target is positive.
    ``tokenizer`` is a file of ranks that every executor can read.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int = 0):
        wanted = targets.select("source", clean_source(F.col("source")).alias("c_source"), F.coalesce("target_permille", F.lit(0)).cast("long").alias("target_permille"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"))
        listed = documents.select("doc_id", "text", clean_source(F.col("source")).alias("c_source")).join(wanted.select("c_source").distinct(), "c_source", "left_semi")
        self._plan(stage(token_counts(listed, ["doc_id", "c_source"], tokenizer), "tokens"), wanted, seed)

    @classmethod
    def of_sizes(cls, sizes: DataFrame, targets: DataFrame, seed: int = 0) -> SourceMix:
        """The mix of ``sizes(doc_id, c_source, tokens)``, whose tokens are counted already and whose sources are clean."""
        made = cls.__new__(cls)
        wanted = targets.select("source", clean_source(F.col("source")).alias("c_source"), F.coalesce("target_permille", F.lit(0)).cast("long").alias("target_permille"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"))
        made._plan(sizes, wanted, seed)
        return made

    def _plan(self, sizes: DataFrame, wanted: DataFrame, seed: int) -> None:
        self.seed, self.documents = seed, sizes
        sums = sizes.groupBy("c_source").agg(F.count("*").alias("documents"), F.sum("tokens").cast("long").alias("tokens"), F.max("tokens").alias("largest"))
        self.total = sizes.join(wanted.select("c_source"), "c_source", "left_semi").agg(F.sum("tokens")).first()[0] or 0
        tokens, wants = F.col("tokens"), F.col("target_permille").cast("double") * F.lit(float(self.total)) / 1000.0
        most = F.col("max_repeats").cast("double")
        self.sources = (
            wanted.join(sums, "c_source", "left")
            .fillna(0, ["documents", "tokens", "largest"])
            .withColumn("target_tokens", wants)
            .withColumn("rate", F.when(wants <= 0, 0.0).when(tokens > 0, F.least(most, wants / tokens)).otherwise(most))
        )

    def copies(self) -> DataFrame:
        """(doc_id, source, tokens, copies) of the documents in the mix."""
        # a coarse offset, which sums of whole copies leave exact
        offset = F.shiftrightunsigned(F.xxhash64("c_source", F.lit(self.seed)), 48).cast("double") / float(1 << 16)
        size_class = F.floor(F.log2(F.col("tokens") + 1.0) * 16)
        placed = ranked(self.documents, ["c_source"], "doc_id", self.seed, size_class).join(self.sources.select("c_source", "source", "rate"), "c_source")
        passed = lambda k: crossings(offset, F.col("rate"), k)
        return placed.withColumn("copies", passed(F.col("k")) - passed(F.col("k") - 1)).where("copies > 0").select("doc_id", "source", "tokens", "copies")

    def shares(self) -> DataFrame:
        """Each listed source with what it should give and what it gives.

        ``target_share`` and ``target_tokens`` refer to the tokens of all listed documents; ``actual_share`` is the share of the mix, which is smaller
        than that where sources fall short, so others' shares of it are larger; ``share_of_total`` is what the source gives of all tokens,
        and ``deviation`` that part's distance from its target, by the target; as documents come out whole, it is about the largest document at most.  ``short`` says that the source gives every document
        ``max_repeats`` times and still less than its target.
        """
        mixed = self.copies().groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.sum("copies").alias("copies"))
        joined = self.sources.join(mixed, "source", "left").fillna(0, ["mixed_tokens", "copies"])
        all_mixed, total = F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(self.total).cast("long")
        short = (F.col("copies") == F.col("max_repeats") * F.col("documents")) & (F.col("mixed_tokens") * 1000 < F.col("target_permille") * total)
        return joined.select(
            "source", "documents", "tokens", "largest", "max_repeats", (F.col("target_permille") / 1000.0).alias("target_share"), "target_tokens", "copies", "mixed_tokens", F.try_divide(F.col("mixed_tokens"), all_mixed).alias("actual_share"),
            F.try_divide(F.col("mixed_tokens"), total).alias("share_of_total"), F.try_divide(F.col("mixed_tokens") - F.col("target_tokens"), F.col("target_tokens")).alias("deviation"), short.alias("short"),
        )

    def short_sources(self) -> DataFrame:
        """Sources which fall short of their target in the mix even with every document repeated ``max_repeats`` times."""
        return self.shares().where("short")
