"""Long exact spans shared between records, by fixed-block anchors.

1. Every text is cut into non-overlapping blocks of BLOCK characters, half of
   the least span, so that a shared span of SPAN characters holds at least one
   whole block of either text.  Their hashes are the index, written once.
2. Every rolling window of BLOCK characters of every text probes the index: a bit
   array, where the blocks are few enough for one that hardly errs.  Else a
   hash is kept with the least and greatest text that has it, which tells whether
   another text does, so no pairs are formed within a hash, however many texts
   share it.  Probes whose block is in another text of the same piece of the
   table are hits at once; the others go through a bit array of all blocks, as
   long as there are few enough for one, and are joined with the index.  So the
   hottest passages, which every piece holds many times, are never shuffled.
3. Hits are extended: the segments around them are laid side by side in order of
   their least hash, so that copies of a passage mostly lie in one piece.
   Around each hit, every window of SPAN characters that may hold it gets a
   128-bit hash.  Windows that another text of the piece has too are shared;
   their runs leave the piece as one row each.  Windows not found there are looked
   up among those of all pieces: each piece packs its hashes, a bit array tells
   which of them two pieces have, and only those are unpacked and shuffled.
4. Runs and windows unite to the maximal stretches in which every window of SPAN
   characters occurs elsewhere; what they cover is what is shared.

Exact copies of a text, told by 128 bits, are one text throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.rolling import BASE, OTHER_BASE, code_points, mix, window_runs, windows
from tallyforge.llm import bits
from tallyforge.llm.overlap import digest
from tallyforge.operators.skew import heavy_keys, hot_keys, spread_join
from tallyforge.operators.stages import spread, stage

SPAN = 150
BLOCK = 75
# places of hits are kept in steps of so many characters
STEP = 15
_PIECE_CHARS = 1_000_000
_MOST_HOT = 5_000
_MARKS, _RATIO = 4, 24
_POWERS = np.array([pow(BASE, i, 1 << 64) for i in range(BLOCK)], np.uint64)
TEXT = ["c1", "c2"]
ALONE, SHARED = range(2)
WINDOW = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("before", pa.int32()), ("upto", pa.int32())])
_PACK = 200_000


def _distinct(*columns):
    """Rows of a batch, the first of each text."""
    seen = set()
    for row in zip(*columns):
        if row[:2] not in seen:
            seen.add(row[:2])
            yield row


def _runs(rows):
    """Rows with a text in runs of about _PIECE_CHARS characters, so that memory doesn't follow the batch."""
    run, size = [], 0
    for row in rows:
        run.append(row)
        size += max(len(x) for x in row if isinstance(x, str))
        if size >= _PIECE_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _segments(rows):
    """Record batches of the segments of texts (c1, c2, text, places)."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64())
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*TEXT, "at", "before", "text", "places", "anchor"])
    out, size = [], 0
    for c1, c2, text, places in rows:
        points = code_points(text)
        hashes = windows(points, BLOCK)
        at = np.sort(np.asarray(places, np.int64)) * STEP
        solid = np.concatenate(([0], np.cumsum(~np.fromiter(map(str.isspace, text), bool, len(text)))))
        for hit in np.split(at, np.flatnonzero(np.diff(at) > SPAN - BLOCK + STEP) + 1):
            begin, end = max(0, int(hit[0]) - (SPAN - BLOCK)), min(len(points), int(hit[-1]) + STEP + SPAN)
            if end - begin >= SPAN:
                anchor = int(hashes[hit[0] : hit[-1] + STEP].view(np.int64).min())
                out.append((c1, c2, begin, int(solid[begin]), text[begin:end], (hit - begin).tolist(), anchor))
                size += end - begin
        if size >= _PIECE_CHARS:
            yield pack(out)
            out, size = [], 0
    if out:
        yield pack(out)


def block_hashes(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, part) of each non-overlapping block of BLOCK characters: the hashes that ``windows`` gives at multiples of BLOCK."""
    cut = [p[: len(p) // BLOCK * BLOCK] for p in parts]
    values = mix(np.concatenate(cut)) if cut else np.empty(0, np.uint64)
    hashes = (values.reshape(-1, BLOCK) * _POWERS).sum(axis=1, dtype=np.uint64)
    return hashes, np.repeat(np.arange(len(cut)), [len(c) // BLOCK for c in cut])


def _owners(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, least owner, greatest owner)."""
    order = np.argsort(hashes, kind="stable")
    ordered, whose = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
    if not len(first):
        return ordered, whose, whose
    return ordered[first], np.minimum.reduceat(whose, first), np.maximum.reduceat(whose, first)


def _table(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


class SharedSpans:
    """Spans of at least SPAN characters that occur verbatim in more than one text.

    Null texts and texts shorter than SPAN have none.  Characters are code points; spans are compared as they stand.  Documents with
    equal texts share all of them.  Rows with a null ``doc_id`` are left out.
    """

    def __init__(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        kind = documents.schema[doc_id].dataType.simpleString()
        source = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= SPAN))

        def named(batches):
            for batch in batches:
                made = [digest(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
                yield _table(["doc", "c1", "c2", "text"], batch.column(0), pa.array([d[0] for d in made], pa.int64()), pa.array([d[1] for d in made], pa.int64()), batch.column(1))

        self.doc_id = doc_id
        blankless = F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]", ""))
        made = spread(source).mapInArrow(named, f"doc {kind}, c1 long, c2 long, text string")
        # read by every step that follows, each of the columns it needs
        self.documents = stage(made.select("doc", *TEXT, blankless.alias("blankless"), "text"), "documents")
        self.texts = self.documents.select(*TEXT, "text")
        self.members = self.documents.select("doc", *TEXT, "blankless")

    def hits(self) -> DataFrame:
        """(c1, c2, places): the steps of STEP characters of a text in which a window begins that is a block of another text; as many as a text has steps at most."""

        def index(batches):
            for batch in batches:
                for piece in _runs(_distinct(*(batch.column(i).to_pylist() for i in range(3)))):
                    hashes, owner = block_hashes([code_points(t) for _, _, t in piece])
                    one, two = (np.array([p[i] for p in piece], np.int64) for i in (0, 1))
                    yield _table(["hash", *TEXT], hashes.view(np.int64), one[owner], two[owner])

        index_rows = stage(self.texts.mapInArrow(index, "hash long, c1 long, c2 long"), "blocks", "lz4")
        present = bits.build(index_rows.select("hash"), bits.column, index_rows.count(), twice=True)

        def probe(batches):
            for batch in batches:
                for piece in _runs(_distinct(*(batch.column(i).to_pylist() for i in range(3)))):
                    parts = [code_points(t) for _, _, t in piece]
                    one, two = (np.array([p[i] for p in piece], np.int64) for i in (0, 1))
                    known, least, most = _owners(*block_hashes(parts))
                    for hashes, owner, position in window_runs(parts, BLOCK):
                        if present is not None:
                            once, twice = present.value
                            maybe = bits.maybe_present(once, hashes)
                            # a text's own block is no hit unless it is a block elsewhere too
                            own = np.flatnonzero(maybe & (position % BLOCK == 0))
                            maybe[own] = bits.maybe_present(twice, hashes[own])
                            hashes, owner, position = hashes[maybe], owner[maybe], position[maybe]
                        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                        hit = (known[at] == hashes) & ((least[at] != owner) | (most[at] != owner)) if len(known) else np.zeros(len(hashes), bool)
                        # of the hits, one row for each step of each text
                        code = owner[hit] * (1 << 32) + position[hit] // STEP
                        _, first = np.unique(code, return_index=True)
                        keep = np.concatenate((np.flatnonzero(hit)[first], np.flatnonzero(~hit)))
                        yield _table(["hash", *TEXT, "at", "hit"], hashes[keep].view(np.int64), one[owner[keep]], two[owner[keep]], (position[keep] // STEP).astype(np.int32), np.arange(len(keep)) < len(first))

        probes = self.texts.mapInArrow(probe, "hash long, c1 long, c2 long, at int, hit boolean")
        probes = stage(probes, "probes", "lz4") if present is not None else probes
        span = lambda c: [F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}")]
        blocks = index_rows.groupBy("hash").agg(*span("c1"), *span("c2"))
        asked = probes.where(~F.col("hit"))
        hot = heavy_keys(asked, ["hash"], asked.count(), _MOST_HOT) if present is not None else None
        other = F.lit(False)
        for c in TEXT:
            other = other | (F.col(f"least_{c}") != F.col(c)) | (F.col(f"most_{c}") != F.col(c))
        found = spread_join(asked, blocks, ["hash"], hot, "at").where(other).select(*TEXT, "at")
        every = found.unionByName(probes.where("hit").select(*TEXT, "at"))
        return every.groupBy(*TEXT).agg(F.collect_set("at").alias("places"))

    def segments(self) -> DataFrame:
        """(c1, c2, at, before, text, places, anchor): the parts of a text that windows with hits cover, from character ``at`` on, with ``before`` non-blank
        characters before them, the places of hits relative to ``at``, and the least hash of a window of BLOCK characters between the first hit and the last, which copies of a passage mostly have in common.

        Where all blocks fit a bit array that errs once in a thousand times, what it says are hits, and one pass over the texts gives the segments: a false hit
        costs some windows more, which the next step finds alone.  Else hits are those of ``hits``, found by a join.
        """
        schema = "c1 long, c2 long, at int, before int, text string, places array<int>, anchor long"
        n = self.documents.agg(F.sum(F.floor(F.length("text") / BLOCK))).first()[0] or 0
        pieces = lambda batch: _runs(_distinct(*(batch.column(i).to_pylist() for i in range(3))))
        present = bits.build(self.texts, lambda batch: (block_hashes([code_points(x[2]) for x in piece])[0] for piece in pieces(batch)), n, twice=True, marks=_MARKS, ratio=_RATIO)
        if present is not None:

            def find(batches):
                once, twice = present.value
                for batch in batches:
                    for piece in pieces(batch):
                        found = []
                        for hashes, owner, position in window_runs([code_points(x[2]) for x in piece], BLOCK):
                            maybe = bits.maybe_present(once, hashes, _MARKS)
                            # a text's own block is no hit unless it is a block elsewhere too
                            own = np.flatnonzero(maybe & (position % BLOCK == 0))
                            maybe[own] = bits.maybe_present(twice, hashes[own], _MARKS)
                            found.append(np.unique(owner[maybe] * (1 << 32) + position[maybe] // STEP))
                        steps = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
                        owners, first = np.unique(steps >> 32, return_index=True)
                        for i, places in zip(owners.tolist(), np.split(steps & 0xFFFFFFFF, first[1:])):
                            yield (*piece[i], places)

            return self.texts.mapInArrow(lambda batches: _segments(find(batches)), schema)
        # one document of each text carries it to the hits
        carriers = self.members.groupBy(*TEXT).agg(F.min("doc").alias("doc"))
        asked = stage(self.hits().join(carriers, TEXT).select("doc", "places"), "hits")
        key = F.xxhash64("doc")
        holders = bits.only_present(self.documents.select("doc", *TEXT, "text"), key, bits.build(asked.select(key.alias("h")), bits.column, asked.count()))
        joined = holders.join(asked, "doc").select(*TEXT, "text", "places")
        return joined.mapInArrow(lambda batches: _segments(row for batch in batches for row in _distinct(*(batch.column(i).to_pylist() for i in range(4)))), schema)

    def windows(self) -> DataFrame:
        """(c1, c2, begin, end, before, upto, n, packed): what extending the hits gives, written once.

        A row is a run, or ``n`` rows (kind, h1, h2, c1, c2, begin, end, before, upto) packed as one Arrow message, of which most will not be asked for.
        Run: a stretch from ``begin`` to ``end`` whose every window of SPAN characters is in another text.  ALONE: one window that no other text
        of the piece has.  SHARED: the hash of windows that several texts of the piece have.  ``before`` and ``upto`` count the
        non-blank characters before begin and end.
        """
        ordered = stage(self.segments(), "segments").repartitionByRange("anchor", *TEXT).sortWithinPartitions("anchor", *TEXT, "at")
        names = [*TEXT, "begin", "end", "before", "upto", "n", "packed"]

        def packs(kind, h1, h2, c1, c2, *places):
            columns = [pa.array(np.full(len(h1), kind, np.int8)), *(pa.array(h.view(np.int64)) for h in (h1, h2)), pa.array(c1), pa.array(c2), *(pa.array(x.astype(np.int32)) for x in places)]
            whole = pa.RecordBatch.from_arrays(columns, schema=WINDOW)
            for at in range(0, len(h1), _PACK):
                part = whole.slice(at, _PACK)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, WINDOW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), *[pa.int32()] * 4)]
                yield _table(names, *none, pa.array([part.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()))

        last = [None]

        def unlike(rows):
            """Without the same segment of further documents with the same text, which lie next to each other."""
            for row in rows:
                if row[:3] != last[0]:
                    last[0] = row[:3]
                    yield row

        def extend(batches):
            for batch in batches:
                for piece in _runs(unlike(zip(*(batch.column(i).to_pylist() for i in range(6))))):
                    parts = [code_points(x[4]) for x in piece]
                    one, two, start, lead = (np.array([x[i] for x in piece], np.int64) for i in range(4))
                    # segments of one text are one owner
                    _, whose = np.unique(np.stack([one, two], axis=1), axis=0, return_inverse=True)
                    whose = whose.ravel()
                    room = np.array([len(p) - SPAN + 1 for p in parts], np.int64)
                    first = np.cumsum(room) - room
                    marks = np.zeros(int(room.sum()) + 1, np.int32)
                    for i, x in enumerate(piece):
                        at = np.asarray(x[5], np.int64)
                        np.add.at(marks, first[i] + np.clip(at - (SPAN - BLOCK), 0, room[i]), 1)
                        np.add.at(marks, first[i] + np.clip(at + STEP, 0, room[i]), -1)
                    wanted = np.cumsum(marks[:-1]) > 0
                    solid = [np.concatenate(([0], np.cumsum(~np.fromiter(map(str.isspace, x[4]), bool, len(x[4]))))).astype(np.int32) for x in piece]
                    offsets = np.cumsum([len(c) for c in solid]) - np.array([len(c) for c in solid])
                    counts = np.concatenate(solid)
                    kept = []
                    for (h1, owner, position), (h2, _, _) in zip(window_runs(parts, SPAN), window_runs(parts, SPAN, OTHER_BASE, 1)):
                        keep = wanted[first[owner] + position]
                        kept.append((h1[keep], h2[keep], owner[keep], position[keep]))
                    h1, h2, owner, position = (np.concatenate(c) for c in zip(*kept))
                    order = np.lexsort((h2, h1))
                    new = np.ones(len(order), bool)
                    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
                    starts = np.flatnonzero(new)
                    if not len(starts):
                        continue
                    texts = whose[owner[order]]
                    several = np.minimum.reduceat(texts, starts) != np.maximum.reduceat(texts, starts)
                    shared = np.empty(len(order), bool)
                    shared[order] = several[np.cumsum(new) - 1]
                    base = offsets[owner] + position
                    alone = ~shared
                    placed = lambda x: (one[owner[x]], two[owner[x]], start[owner[x]] + position[x], start[owner[x]] + position[x] + SPAN, lead[owner[x]] + counts[base[x]], lead[owner[x]] + counts[base[x] + SPAN])
                    yield from packs(ALONE, h1[alone], h2[alone], *placed(np.flatnonzero(alone)))
                    sample = order[starts[several]]
                    zero = np.zeros(len(sample), np.int32)
                    yield from packs(SHARED, h1[sample], h2[sample], one[owner[sample]], two[owner[sample]], zero, zero, zero, zero)
                    # windows are kept in order of text and position, so runs are neighbours
                    at = np.flatnonzero(shared)
                    if len(at):
                        breaks = (owner[at][1:] != owner[at][:-1]) | (position[at][1:] != position[at][:-1] + 1)
                        begin, end = at[np.concatenate(([True], breaks))], at[np.concatenate((breaks, [True]))]
                        origin = owner[begin]
                        runs = (x.astype(np.int32) for x in (start[origin] + position[begin], start[origin] + position[end] + SPAN, lead[origin] + counts[base[begin]], lead[origin] + counts[base[end] + SPAN]))
                        yield _table(names, one[owner[begin]], two[owner[begin]], *runs, pa.nulls(len(begin), pa.int32()), pa.nulls(len(begin), pa.binary()))

        return stage(ordered.mapInArrow(extend, "c1 long, c2 long, begin int, end int, before int, upto int, n int, packed binary"), "windows", "lz4")

    @staticmethod
    def asked_windows(packed: DataFrame) -> DataFrame:
        """(kind, h1, h2, c1, c2, begin, end, before, upto) of the packed windows, without those whose hash certainly no other piece has sent.

        A bit array tells which hashes were sent twice, as long as there are few enough for one; else all windows come out.
        """

        def unpacked(batch):
            for data in batch.column(0):
                yield from pa.ipc.open_stream(data.as_buffer())

        n = packed.agg(F.sum("n")).first()[0] or 0
        present = bits.build(packed.select("packed"), lambda batch: (w.column(1).to_numpy().view(np.uint64) for w in unpacked(batch)), n, twice=True)

        def survive(batches):
            for batch in batches:
                for w in unpacked(batch):
                    yield w if present is None else w.filter(pa.array(bits.maybe_present(present.value[1], w.column(1).to_numpy().view(np.uint64))))

        return packed.select("packed").mapInArrow(survive, "kind byte, h1 long, h2 long, c1 long, c2 long, begin int, end int, before int, upto int")

    def shared_runs(self) -> DataFrame:
        """(c1, c2, begin, end, before, upto): stretches whose every window another text has too; they may overlap and adjoin."""
        every = self.windows()
        sent = self.asked_windows(every.where("n is not null"))
        span = lambda c: F.min(c) != F.max(c)
        several = sent.groupBy("h1", "h2").agg((span("c1") | span("c2") | F.max(F.col("kind") == SHARED)).alias("several")).where("several").select("h1", "h2")
        place = [*TEXT, "begin", "end", "before", "upto"]
        return every.where("n is null").select(*place).unionByName(sent.where(F.col("kind") == ALONE).join(several, ["h1", "h2"], "left_semi").select(*place))

    def extents(self) -> DataFrame:
        """(doc_id, extent, shared_chars, blankless): how much of each document is shared; documents without a shared span are left out.

        ``blankless`` counts the non-blank characters of a text and ``shared_chars`` those within shared spans.  A text that several documents
        have is shared as a whole.
        """
        order = Window.partitionBy(*TEXT).orderBy("begin", "end")
        earlier = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.greatest(F.lit(0), F.col("upto") - F.greatest("before", F.coalesce(earlier, F.lit(0))))
        covered = self.shared_runs().select(*TEXT, fresh.alias("fresh")).groupBy(*TEXT).agg(F.sum("fresh").alias("shared_chars"))
        by_text = covered.join(self._copied(), TEXT, "full")
        extent = F.when(F.col("docs").isNotNull() | (F.col("shared_chars") == F.col("blankless")), "whole").when(F.col("shared_chars") * 2 >= F.col("blankless"), "most").otherwise("part")
        joined = self._of_documents(by_text)
        return joined.select(F.col("doc").alias(self.doc_id), extent.alias("extent"), F.when(F.col("docs").isNull(), F.col("shared_chars")).otherwise(F.col("blankless")).cast("long").alias("shared_chars"), F.col("blankless").cast("long").alias("blankless")).distinct()

    def _copied(self) -> DataFrame:
        """(c1, c2, docs): texts of several documents.  Repeated rows are first made one; the count per text then combines map-side."""
        return self.members.select("doc", *TEXT).distinct().groupBy(*TEXT).agg(F.count("*").alias("docs")).where("docs > 1")

    def _of_documents(self, by_text: DataFrame) -> DataFrame:
        """Members with what is known of their text; a text that many documents have is spread over many tasks."""
        hot = hot_keys(self.members.groupBy(*TEXT).agg(F.count("*").alias("n")), TEXT, "n")
        return spread_join(self.members, by_text, TEXT, hot, "doc")

    def stretches(self) -> DataFrame:
        """(c1, c2, begin, end): maximal stretches in which each window of SPAN characters occurs in another text."""
        order = Window.partitionBy(*TEXT).orderBy("begin", "end")
        earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        # the windows of two runs are neighbours if they share all but one character of a window
        apart = F.coalesce(F.col("begin") > earlier - SPAN + 1, F.lit(True))
        numbered = self.shared_runs().withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("long")).over(order))
        return numbered.groupBy(*TEXT, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")

    def document_stretches(self) -> DataFrame:
        """(doc_id, begin, end): the stretches of every document; that of a document with exact copies is its whole text."""
        copied = self._copied().select(*TEXT)
        whole = self.documents.join(copied, TEXT, "left_semi").select("doc", F.lit(0).alias("begin"), F.length("text").alias("end"))
        parts = self._of_documents(self.stretches().join(copied, TEXT, "left_anti")).select("doc", "begin", "end")
        return whole.unionByName(parts).select(F.col("doc").alias(self.doc_id), "begin", "end").distinct()
