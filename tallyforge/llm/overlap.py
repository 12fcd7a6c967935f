"""Same or near-same records across splits: minwise hashing with banded buckets.

1. Each record's text becomes its set of words, written once to the shared
   folder with a 128-bit digest.  Records with equal sets, compared in full, are
   one class from here on, named by the least key, so a group of copies costs one
   signature, however large it is.
2. Minwise signatures of BANDS x ROWS hash functions; each band of a signature
   is one bucket.  Only buckets that hold both a train class and an evaluation
   class matter: evaluation buckets go into a fixed-size bit array, and train
   buckets which are certainly in none are dropped before the shuffle.
3. Buckets join train classes with evaluation classes only; no pair of one
   side is ever formed.
4. Each candidate pair is verified on its exact word sets.
5. Pairs of classes, with the membership of classes, give pairs of records.

At a similarity of exactly 0.8, the least that counts, a pair shares no bucket
with probability (1 - 0.8^11)^88 = 0.0004; at 0.85 it is 1e-7.  Eleven rows keep
unrelated records apart that are written after the same pattern: two sets that
share three words in ten meet in a bucket once in 6,000 pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import state_words
from tallyforge.llm import bits
from tallyforge.llm.components import clean_split
from tallyforge.operators.skew import heavy_keys, hot_keys, spread_join
from tallyforge.operators.stages import drop_stage, spread, stage

ROWS, BANDS = 11, 88
THRESHOLD = 0.8
_FUNCTIONS = np.random.default_rng(20240917).integers(1, 1 << 32, size=(2, ROWS * BANDS), dtype=np.uint32)
XORS, ODDS = _FUNCTIONS[0], _FUNCTIONS[1] | np.uint32(1)
_MIX = np.random.default_rng(7).integers(1, 1 << 63, size=ROWS, dtype=np.uint64) | np.uint64(1)
_CHUNK = 512
_CELLS = 1 << 16


def digest(data: bytes) -> tuple[int, int]:
    """128 bits of BLAKE2b as two whole numbers."""
    made = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(made[:8], "little", signed=True), int.from_bytes(made[8:], "little", signed=True)


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise signatures of non-empty sets of word hashes, one column for each: uint32[ROWS * BANDS, sets].

    Sets of similar size form a matrix with one set to a column, filled up with the set's own first word, so that minima run over rows.
    """
    out = np.empty((ROWS * BANDS, len(sets)), np.uint32)
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(sets[order[end]]) * (end + 1 - at) <= _CELLS:
            end += 1
        columns = order[at:end]
        cells = np.empty((len(sets[columns[-1]]), len(columns)), np.uint32)
        for j, k in enumerate(columns):
            cells[: len(sets[k]), j] = sets[k]
            cells[len(sets[k]) :, j] = sets[k][0]
        room = np.empty_like(cells)
        for i in range(ROWS * BANDS):
            np.bitwise_xor(cells, XORS[i], out=room)
            np.multiply(room, ODDS[i], out=room)
            np.minimum.reduce(room, axis=0, out=out[i, at:end])
        at = end
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return out[:, back]


def band_keys(signature: np.ndarray) -> np.ndarray:
    """uint64[BANDS, sets]: the bucket of each band, with the band's number mixed in."""
    rows = signature.reshape(BANDS, ROWS, -1).astype(np.uint64)
    mixed = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93), (BANDS, rows.shape[2])).copy()
    for r in range(ROWS):
        mixed = (mixed ^ rows[:, r]) * _MIX[r]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def word_sets(df: DataFrame, key: str, text: str, side: Column, words_of: Callable[[str | None], list[str]] = state_words) -> DataFrame:
    """(key, side, d1, d2, words): sorted distinct words as one text and a 128-bit digest of it, for the rows with a side and at least one word."""
    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), side.alias("side"), F.col(text).cast("string").alias("text")).where(F.col("side").isNotNull() & F.col("text").isNotNull() & F.col("key").isNotNull())

    def run(batches):
        for batch in batches:
            keep, digests, texts = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                joined = " ".join(sorted(set(words_of(text))))
                if joined:
                    keep.append(i)
                    digests.append(digest(joined.encode()))
                    texts.append(joined)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(texts, pa.string())], names=["key", "side", "d1", "d2", "words"])

    return spread(source).mapInArrow(run, f"key {kind}, side string, d1 long, d2 long, words string")


def _batch_buckets(batch: pa.RecordBatch):
    """(places, sizes, buckets uint64[BANDS, sets]) of the classes of a batch (cls, words), in pieces that fit the cache."""
    known: dict[str, int] = {}
    texts = batch.column(1).to_pylist()
    for i in range(0, len(texts), _CHUNK):
        lists = [words.split(" ") for words in texts[i : i + _CHUNK]]
        for w in {w for ws in lists for w in ws if w not in known}:
            known[w] = word_hash(w)
        sets = [np.fromiter((known[w] for w in ws), np.uint32, len(ws)) for ws in lists]
        yield np.arange(i, i + len(sets)), np.array([len(ws) for ws in lists], np.int32), band_keys(signatures(sets))
        if len(known) > 500_000:
            known.clear()


def buckets(classes: DataFrame, only=None) -> DataFrame:
    """(bucket, cls, size) of the word sets ``classes(cls, words)``; with the broadcast bit array ``only``, without buckets that are certainly not in it."""
    kind = classes.schema["cls"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for places, sizes, keys in _batch_buckets(batch):
                flat, owners, lengths = keys.ravel(), np.tile(places, BANDS), np.tile(sizes, BANDS)
                if only is not None:
                    mask = bits.maybe_present(only.value, flat)
                    flat, owners, lengths = flat[mask], owners[mask], lengths[mask]
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column(0).take(pa.array(owners)), pa.array(lengths)], names=["bucket", "cls", "size"])

    return classes.select("cls", "words").mapInArrow(run, f"bucket long, cls {kind}, size int")


def signed(classes: DataFrame) -> DataFrame:
    """(cls, size, buckets) of the word sets, one row for each class with the buckets of all bands."""
    kind = classes.schema["cls"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for places, sizes, keys in _batch_buckets(batch):
                flat = pa.array(np.ascontiguousarray(keys.T).ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(sizes), lists], names=["cls", "size", "buckets"])

    return classes.select("cls", "words").mapInArrow(run, f"cls {kind}, size int, buckets array<long>")


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts of distinct words."""
    left, right = F.split(a, " "), F.split(b, " ")
    both = F.size(F.array_intersect(left, right))
    return both / (F.size(left) + F.size(right) - both)


class CrossSplitOverlap:
    """Pairs of records of side ``t`` and side ``e`` whose word sets have a similarity of at least ``threshold``.

    ``side`` gives "t", "e" or null (not compared).  Null, empty and wordless texts are left out.  Ties and repeated rows all count.
    """

    def __init__(self, df: DataFrame, key: str, text: str, side: Column, threshold: float = THRESHOLD, words_of=state_words):
        self.threshold = threshold
        sets = stage(word_sets(df, key, text, side, words_of), "sets")
        # counted map-side first; rows of one class have the same words and not only the same digest
        counted = sets.groupBy("d1", "d2", "words").agg(F.min("key").alias("cls"), F.count_if(F.col("side") == "t").alias("t"), F.count_if(F.col("side") == "e").alias("e"))
        self.classes = stage(counted, "classes")
        hot = hot_keys(self.classes.select("d1", "d2", (F.col("t") + F.col("e")).alias("n")), ["d1", "d2"], "n")
        named = spread_join(sets.select("key", "side", "d1", "d2"), self.classes.select("d1", "d2", "cls"), ["d1", "d2"], hot, "key")
        self._members = stage(named.select("key", "side", "cls"), "members")
        drop_stage(sets)

    def class_pairs(self) -> DataFrame:
        """(cls_t, cls_e, similarity) of pairs of different classes."""
        held = stage(signed(self.classes.where("e > 0")), "held", "lz4").select("cls", "size", F.explode("buckets").alias("bucket"))
        n = held.count()
        t, e = buckets(self.classes.where("t > 0"), bits.build(held.select("bucket"), bits.column, n)), held
        hot = heavy_keys(held, ["bucket"], n)
        t, e = t.select("bucket", F.col("cls").alias("cls_t"), F.col("size").alias("size_t")), e.select("bucket", F.col("cls").alias("cls_e"), F.col("size").alias("size_e"))
        # sets of too different sizes cannot be similar enough
        near = F.least("size_t", "size_e") >= F.greatest("size_t", "size_e") * (self.threshold - 1e-9)
        met = spread_join(t, e, ["bucket"], hot, "cls_t").where((F.col("cls_t") != F.col("cls_e")) & near)
        pairs = stage(met.select("cls_t", "cls_e").distinct(), "candidates")
        # both word sets of a pair in one pass over the classes: a pair asks for two classes and is put together again
        asked = pairs.select("cls_t", "cls_e", F.explode(F.array("cls_t", "cls_e")).alias("cls"))
        texts = bits.only_present(self.classes.select("cls", "words"), F.xxhash64("cls"), bits.build(asked.select(F.xxhash64("cls").alias("h")), bits.column, asked.count()))
        both = asked.join(texts, "cls").groupBy("cls_t", "cls_e").agg(F.min("words").alias("a"), F.max("words").alias("b"))
        return both.select("cls_t", "cls_e", similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= self.threshold)

    def linked_classes(self) -> DataFrame:
        """(cls_t, cls_e, similarity): class pairs, with each class that is on both sides paired with itself; with ``members`` all that there is to say, at a row for each pair of different texts."""
        own = self.classes.where("t > 0 and e > 0").select(F.col("cls").alias("cls_t"), F.col("cls").alias("cls_e"), F.lit(1.0).alias("similarity"))
        return self.class_pairs().unionByName(own)

    def members(self) -> DataFrame:
        """(key, side, cls): the class of each record that has words, named by the least key of its records."""
        return self._members

    def held_counts(self) -> DataFrame:
        """(e, pairs): each record of side ``e`` with the number of its pairs, counted by class; no pair of records is formed."""
        train = self.classes.select(F.col("cls").alias("cls_t"), F.col("t").alias("n"))
        by_class = self.linked_classes().join(train, "cls_t").groupBy("cls_e").agg(F.sum("n").alias("pairs"))
        hot = hot_keys(self.classes.select(F.col("cls").alias("cls_e"), F.col("e").alias("n")), ["cls_e"], "n")
        held = self.members().where("side = 'e'").select(F.col("key").alias("e"), F.col("cls").alias("cls_e"))
        return spread_join(held, by_class, ["cls_e"], hot, "e").select("e", "pairs")

    def record_pairs(self) -> DataFrame:
        """(t, e, similarity): every pair of records.  ``linked_classes`` and ``members`` say the same in fewer rows."""
        members, linked = self.members(), self.linked_classes()
        hot_e, hot_t = (hot_keys(self.classes.select(F.col("cls").alias(f"cls_{s}"), F.col(s).alias("n")), [f"cls_{s}"], "n") for s in "et")
        held = members.where("side = 'e'").select(F.col("key").alias("e"), F.col("cls").alias("cls_e"))
        train = members.where("side = 't'").select(F.col("key").alias("t"), F.col("cls").alias("cls_t"))
        of_held = spread_join(held, linked, ["cls_e"], hot_e, "e").select("e", "cls_t", "similarity")
        return spread_join(train, of_held, ["cls_t"], hot_t, "t").select("t", "e", "similarity")


def decision_overlap(records: DataFrame) -> CrossSplitOverlap:
    """Train states against those of validation, eval and test."""
    split = clean_split(F.col("split"))
    side = F.when(split == "train", "t").when(split.isin("validation", "eval", "test"), "e")
    return CrossSplitOverlap(records.select("record_no", F.col("input.state").alias("state"), "split"), "record_no", "state", side)
