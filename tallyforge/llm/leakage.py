"""Evaluation texts leaking into training text: broadcast n-grams, scanned windows, verified hits."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyforge.functions.rolling import code_points, joined_windows, window_runs
from tallyforge.functions.text import WORD, bare, words
from tallyforge.operators.stages import spread

WORDS, CHARACTERS = 12, 30
BLOCK_CHARS = 8_000_000
_TABLE = 20
_PIECE_CHARS = 2_000_000


@dataclass
class Item:
    item_id: int
    by_chars: bool
    tokens: list[str] | str


def _word_values(tokens: list[str]) -> np.ndarray:
    """Numbers that tell words apart within one process; hits are verified on the words."""
    return np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)


_TABLES: dict[str, list[Grams]] = {}


def _tables(block: tuple[str, list[Item]]) -> list[Grams]:
    """The n-gram tables of a block of items, by words and by characters, made once in each worker process and kept for the tasks that follow."""
    name, items = block
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = [Grams(items, by_chars) for by_chars in (False, True)]
    return _TABLES[name]


class Grams:
    """The n-grams of one block of items: a sorted hash table with a small presence table before it."""

    def __init__(self, items: list[Item], by_chars: bool):
        self.items = [i for i in items if i.by_chars == by_chars]
        self.width = CHARACTERS if by_chars else WORDS
        self.values = code_points if by_chars else _word_values
        parts = [self.values(i.tokens) for i in self.items]
        hashes, owner, position = joined_windows(parts, self.width)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.position = hashes[order], owner[order], position[order]
        self.present = np.zeros(1 << _TABLE, bool)
        self.present[(self.hashes >> np.uint64(64 - _TABLE)).astype(np.int64)] = True

    def hits(self, texts: list):
        """(text number, position, item number) of each verified window of the token sequences ``texts``."""
        if not self.items:
            return
        for hashes, owner, position in window_runs([self.values(t) for t in texts], self.width):
            maybe = np.flatnonzero(self.present[(hashes >> np.uint64(64 - _TABLE)).astype(np.int64)])
            left = np.searchsorted(self.hashes, hashes[maybe], "left")
            right = np.searchsorted(self.hashes, hashes[maybe], "right")
            some = right > left
            for at, lo, hi in zip(maybe[some].tolist(), left[some].tolist(), right[some].tolist()):
                text, p = int(owner[at]), int(position[at])
                window = texts[text][p : p + self.width]
                for k in range(lo, hi):
                    item, q = int(self.owner[k]), int(self.position[k])
                    if self.items[item].tokens[q : q + self.width] == window:
                        yield text, p, item


def _lowered(text: str) -> tuple[str, list[int]]:
    """The lower-cased text and the place in ``text`` of each of its characters."""
    lowered = text.lower()
    if len(lowered) == len(text):
        return lowered, list(range(len(text)))
    pieces = [c.lower() for c in text]
    return "".join(pieces), [i for i, piece in enumerate(pieces) for _ in piece]


def _token_places(text: str, by_chars: bool) -> list[tuple[int, int]]:
    """Begin and end in ``text`` of each word, or of each character of the bare text."""
    lowered, place = _lowered(text)
    if by_chars:
        return [(place[i], place[i] + 1) for m in WORD.finditer(lowered) for i in range(m.start(), m.end())]
    return [(place[m.start()], place[m.end() - 1] + 1) for m in WORD.finditer(lowered)]


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def _blocks(items: DataFrame, id_column: str, text: str, lang: str):
    """The items in blocks of about BLOCK_CHARS characters; each block is small enough to broadcast, however many there are."""
    rows = items.select(F.col(id_column).alias("i"), F.col(text).alias("t"), (F.lower(F.trim(lang)) == "zh").alias("zh")).where("i is not null and t is not null").distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        tokens = bare(row["t"]) if row["zh"] else words(row["t"])
        if len(tokens) >= (CHARACTERS if row["zh"] else WORDS):
            block.append(Item(row["i"], bool(row["zh"]), tokens))
            size += len(row["t"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _pieces(ids, texts):
    """Documents in runs of about _PIECE_CHARS characters, so that memory doesn't follow the batch."""
    run, size = [], 0
    for i, t in zip(ids, texts):
        if t:
            run.append((i, t))
            size += len(t)
        if size >= _PIECE_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def leaked_spans(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, item_id, begin, end): the stretches of each document that hold a passage of an item, as character places in its text.

    A passage is WORDS consecutive words of the item, or for items in ``zh`` CHARACTERS consecutive characters of its bare text.
    Overlapping passages of one item are one stretch.  Items shorter than a passage match nothing; rows with null text or null id are left
    out; repeated documents and items with equal texts all come out.  The items are the stated query set: they are broadcast in blocks of
    bounded size, one scan of the documents for each block.
    """
    spark = documents.sparkSession
    schema = f"{doc_id} {documents.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, begin int, end int"
    id_type = to_arrow_type(items.schema[item_id].dataType)
    source = spread(documents.select(doc_id, F.col(text).cast("string").alias("_text")).where(F.col("_text").isNotNull() & F.col(doc_id).isNotNull()))
    out = None
    for block in _blocks(items, item_id, text, lang):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches, shared=shared):
            tables = _tables(shared.value)
            for batch in batches:
                kind, rows = batch.schema.field(0).type, []
                for piece in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tokens = [words(t) for _, t in piece]
                    for table, texts in zip(tables, (tokens, ["".join(t) for t in tokens])):
                        found: dict[tuple[int, int], list[int]] = {}
                        for at, p, item in table.hits(texts):
                            found.setdefault((at, item), []).append(p)
                        places: dict[int, list] = {}
                        for (at, item), starts in found.items():
                            if at not in places:
                                places[at] = _token_places(piece[at][1], table.values is code_points)
                            spans = [(places[at][p][0], places[at][p + table.width - 1][1]) for p in starts]
                            rows += [(piece[at][0], table.items[item].item_id, *span) for span in merge_spans(spans)]
                ids, of, begin, end = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(of, id_type), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=[doc_id, item_id, "begin", "end"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def leaks(documents: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """(doc_id, item_id): each document with each item it leaks."""
    spans = leaked_spans(documents, items, **columns)
    return spans.select(spans.columns[:2]).distinct()


def without_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """(doc_id, text, removed_chars) of all documents, with leaked stretches cut out; null texts stay null.

    Only the spans are shuffled to the documents' keys; a document's spans are bounded by its own length.
    """
    spans = leaked_spans(documents, items, doc_id=doc_id, text=text, **columns).groupBy(doc_id).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("kept")),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["kept"], F.when(s["begin"] > acc["at"], F.substring(F.col(text), acc["at"] + 1, s["begin"] - acc["at"])).otherwise("")).alias("kept")),
    )
    joined = documents.select(doc_id, text).join(spans, doc_id, "left").withColumn("_m", merged)
    clean = F.when(F.col("spans").isNull(), F.col(text)).otherwise(F.concat(F.col("_m.kept"), F.substring(F.col(text), F.col("_m.at") + 1, F.length(text))))
    return joined.select(doc_id, clean.alias("_c"), F.col(text)).select(doc_id, F.col("_c").alias(text), (F.length(text) - F.length("_c")).alias("removed_chars"))
