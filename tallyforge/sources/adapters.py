"""Upstream tables as decision records: one adapter for each source, in a registry.

An adapter is a projection of raw rows to (id, family, domain, type, state, criteria, target, distribution, status, reason); status is
``ok``, ``skip`` (counted and left out) or ``raise`` (stops the build).  Criteria and target are JSON texts.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.parse import csv_cell, modal, short_hash, vote_share
from tallyforge.functions.stats import half_up_level
from tallyforge.operators.ordered import numbered

COLUMNS = ("id", "family", "domain", "type", "state", "criteria", "target", "distribution", "status", "reason")


@dataclass(frozen=True)
class SourceAdapter:
    """What a source must state about itself, and its projection."""

    name: str
    domain: str
    kind: str
    license: str
    source_url: str
    release_year: int
    record: Callable[[DataFrame], DataFrame]


REGISTRY: dict[str, SourceAdapter] = {}


def register(adapter: SourceAdapter) -> SourceAdapter:
    """Add an adapter; a repeated name, an unknown kind or an empty field stops."""
    if adapter.name in REGISTRY:
        raise ValueError(f"{adapter.name} is registered already")
    if adapter.kind not in ("choice", "noul", "score") or not all((adapter.name, adapter.domain, adapter.license)) or not callable(adapter.record):
        raise ValueError(f"{adapter.name} is no complete adapter")
    REGISTRY[adapter.name] = adapter
    return adapter


def convert(name: str, raw: DataFrame, **options: str) -> DataFrame:
    """All rows of a source with their status; a row whose status is ``raise`` stops when it is read.  ``options`` go to the adapter, as massive's locale."""
    made = REGISTRY[name].record(raw, **options).select(*COLUMNS)
    return made.where(F.when(F.col("status") == "raise", F.raise_error(F.concat(F.lit(f"{name}: "), F.col("reason"))).cast("boolean")).otherwise(True))


def accepted(made: DataFrame) -> DataFrame:
    return made.where("status = 'ok'").drop("status", "reason")


def build_summary(made: DataFrame, length: Column | None = None, most: int | None = None) -> DataFrame:
    """(converted, skipped, dropped_over_length, kept) of a build, in one pass."""
    ok = F.col("status") == "ok"
    over = ok & (length > most) if length is not None else F.lit(False)
    return made.agg(F.count_if(ok).alias("converted"), F.count_if(F.col("status") == "skip").alias("skipped"), F.count_if(over).alias("dropped_over_length"), F.count_if(ok & ~over).alias("kept"))


def _texts(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _object(options: dict[str, str]) -> Column:
    return F.to_json(F.create_map(*(F.lit(x) for kv in options.items() for x in kv)))


def _spelt(options: list[str]) -> dict[str, str]:
    return {o: o.lower() for o in options}


def _made(raw: DataFrame, adapter: str, kind: str, id: Column, family: Column, state: Column, criteria: Column, target: Column, distribution: Column | None = None, skip: Column | None = None, bad: Column | None = None) -> DataFrame:  # noqa: A002
    none = F.lit(None).cast("map<string,double>")
    broken = F.coalesce(bad, F.lit(True)) if bad is not None else F.lit(False)
    left = F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)
    status = F.when(left, "skip").when(broken | target.isNull(), "raise").otherwise("ok")
    reason = F.when(status == "skip", "left out").when(status == "raise", "no valid target")
    return raw.select(F.concat(F.lit(f"{adapter}-"), id.cast("string")).alias("id"), family.cast("string").alias("family"), F.lit(adapter).alias("domain"), F.lit(kind).alias("type"), state.alias("state"), criteria.alias("criteria"), target.alias("target"), (none if distribution is None else distribution).alias("distribution"), status.alias("status"), reason.alias("reason"))


_c = F.col
_text = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)  # noqa: E731 - a JSON string of a column
_true = lambda c: F.when(c, "true").when(~c, "false")


def vitaminc(raw: DataFrame) -> DataFrame:
    labels = ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO"]
    return _made(raw, "vitaminc", "choice", _c("unique_id"), _c("case_id"), _texts(claim=_c("claim"), evidence=_c("evidence")), F.lit(None).cast("string") if not labels else _object(_spelt(labels)), F.when(_c("label").isin(labels), _text(_c("label"))))


MASSIVE_CRITERIA = {
    "alarm": "Setting, changing, or querying alarms.",
    "audio": "Volume, mute, or audio output settings.",
    "calendar": "Events, meetings, reminders on a calendar.",
    "cooking": "Recipes and cooking instructions.",
    "datetime": "The current time, date, or time conversions.",
    "email": "Reading, sending, or checking email and contacts.",
    "general": "Small talk, jokes, greetings, or general assistant control such as repeat or confirm.",
    "iot": "Controlling lights, plugs, heating, cleaners, coffee machines, or wemo devices.",
    "lists": "Creating, querying, or removing list items.",
    "music": "Music preferences, likes, or music settings, not playing a specific item.",
    "news": "News headlines or updates.",
    "play": "Playing a specific song, podcast, radio, audiobook, or game.",
    "qa": "Factual questions, definitions, math, currency, stock prices.",
    "recommendation": "Suggestions for events, movies, or locations.",
    "social": "Social media posts or queries.",
    "takeaway": "Food orders and delivery status.",
    "transport": "Taxis, tickets, traffic, or travel directions.",
    "weather": "Weather forecasts or conditions.",
}


def massive(raw: DataFrame, locale: str | None = None) -> DataFrame:
    """Test rows of one locale; the scenario is the target among the 18 scenarios.

    Rows of other partitions and locales and blank utterances are skipped; an unknown scenario stops.  Without ``locale`` the table must be of one locale, else every row stops.
    """
    of_one = raw.withColumn("_several", F.lit(locale is None and raw.select("locale").distinct().limit(2).count() > 1))
    known = F.coalesce(_c("scenario").isin(list(MASSIVE_CRITERIA)), F.lit(False))
    elsewhere = ~_c("partition").eqNullSafe(F.lit("test")) | (F.lit(False) if locale is None else ~_c("locale").eqNullSafe(F.lit(locale)))
    blank = F.coalesce(_c("utt").rlike(r"(?U)^[\s\x1c-\x1f]*$"), F.lit(True))
    skip = ~_c("_several") & (elsewhere | known & blank)
    return _made(of_one, "massive", "choice", F.concat_ws("-", "locale", "id"), F.concat(F.lit("massive-"), _c("id").cast("string")), _c("utt"), _object(MASSIVE_CRITERIA), _text(_c("scenario")), skip=skip, bad=~known | _c("_several"))


def boolq(raw: DataFrame) -> DataFrame:
    return _made(raw, "boolq", "noul", short_hash(F.concat_ws("\n", "passage", "question")), short_hash(_c("passage")), _texts(passage=_c("passage"), question=_c("question")), _object({"false": "no", "true": "yes"}), _true(_c("answer")))


def squad2_flat(documents: DataFrame) -> DataFrame:
    """data > paragraphs > qas as one row for each question."""
    p = documents.select(F.explode("data").alias("d")).select(_c("d.title").alias("title"), F.explode("d.paragraphs").alias("p"))
    q = p.select("title", _c("p.context").alias("context"), F.explode("p.qas").alias("q"))
    answers = F.struct(F.transform("q.answers", lambda a: a["text"]).alias("text"), F.transform("q.answers", lambda a: a["answer_start"]).alias("answer_start"))
    return q.select(_c("q.id").alias("id"), "title", "context", _c("q.question").alias("question"), answers.alias("answers"), _c("q.is_impossible").alias("is_impossible"))


def squad2(raw: DataFrame) -> DataFrame:
    """Whether the context answers the question; rows whose official flag says otherwise are skipped.  Takes the flat or the nested layout."""
    flat = squad2_flat(raw) if "data" in raw.columns else raw
    flat = flat if "is_impossible" in flat.columns else flat.withColumn("is_impossible", F.lit(None).cast("boolean"))
    answerable = F.size("answers.text") > 0
    return _made(flat, "squad2", "noul", _c("id"), short_hash(_c("context")), _texts(context=_c("context"), question=_c("question")), _object({"false": "not answered", "true": "answered"}), _true(answerable), skip=_c("is_impossible") == answerable)


def paws(raw: DataFrame) -> DataFrame:
    return _made(raw, "paws", "noul", _c("id"), _c("id"), _texts(sentence1=_c("sentence1"), sentence2=_c("sentence2")), _object({"false": "different meaning", "true": "same meaning"}), _true(F.when(_c("label").isin(0, 1), _c("label") == 1)))


def multinli(raw: DataFrame) -> DataFrame:
    """The gold label must be modal among the votes; rows without gold are skipped."""
    options = ["entailment", "neutral", "contradiction"]
    shares = vote_share(_c("annotator_labels"), options)
    return _made(raw, "multinli", "choice", _c("pairID"), _c("promptID"), _texts(premise=_c("sentence1"), hypothesis=_c("sentence2")), _object(_spelt(options)), F.when(_c("gold_label").isin(options), _text(_c("gold_label"))), shares, skip=~_c("gold_label").isin(options), bad=~F.coalesce(modal(shares, _c("gold_label")), F.lit(False)))


def civil_comments(raw: DataFrame) -> DataFrame:
    t = _c("toxicity")
    return _made(raw, "civil_comments", "noul", _c("row_index"), _c("row_index"), _c("text"), _object({"false": "not toxic", "true": "toxic"}), _true(t >= 0.5), F.create_map(F.lit("false"), 1 - t, F.lit("true"), t), bad=~t.between(0, 1))


def aegis2(raw: DataFrame) -> DataFrame:
    """Human-labelled prompts that were not redacted."""
    state = F.when(_c("response").isNull(), _c("prompt")).otherwise(_texts(prompt=_c("prompt"), response=_c("response")))
    label = F.coalesce(F.when(_c("response").isNotNull(), _c("response_label")), _c("prompt_label"))
    source = F.when(_c("response").isNotNull(), _c("response_label_source")).otherwise(_c("prompt_label_source"))
    skip = ~F.coalesce(source == "human", F.lit(False)) | _c("reconstruction_id_if_redacted").isNotNull()
    return _made(raw, "aegis2", "noul", _c("id"), _c("id"), state, _object({"false": "safe", "true": "unsafe"}), _true(F.when(label.isin("safe", "unsafe"), label == "unsafe")), skip=skip)


def aegis2_categories(raw: DataFrame) -> DataFrame:
    return raw.select("id", F.explode(csv_cell(_c("violated_categories"))).alias("category"))


def _levels(n: int) -> Column:
    return F.to_json(F.array(*(F.lit(f"level {i}") for i in range(n))))


def helpsteer2(raw: DataFrame) -> DataFrame:
    return _made(raw, "helpsteer2", "score", _c("row_index"), short_hash(_c("prompt")), _texts(prompt=_c("prompt"), response=_c("response")), _levels(5), F.when(_c("helpfulness").between(0, 4), _c("helpfulness").cast("string")))


def summeval_rows(raw: DataFrame, aspect: str = "relevance") -> DataFrame:
    """One row for each summary of a document; a score array of another length stops."""
    matched = F.when(F.size("machine_summaries") == F.size(aspect), F.arrays_zip(F.col("machine_summaries").alias("s"), F.col(aspect).alias("m"))).otherwise(F.raise_error(F.lit("scores and summaries differ in number")).cast("array<struct<s:string,m:double>>"))
    return raw.select("id", "text", F.posexplode(matched).alias("n", "z")).select(_c("id").alias("article"), "text", "n", _c("z.s").alias("summary"), _c("z.m").alias("mean"))


def summeval(raw: DataFrame) -> DataFrame:
    rows = summeval_rows(raw)
    return _made(rows, "summeval", "score", F.concat_ws("-", "article", "n"), _c("article"), _texts(document=_c("text"), summary=_c("summary")), _levels(5), half_up_level(_c("mean")).cast("string"), bad=~_c("mean").between(1, 5))


def pubmedqa(raw: DataFrame) -> DataFrame:
    decision = F.lower("final_decision")
    return _made(raw, "pubmedqa", "choice", _c("pubid"), _c("pubid"), F.to_json(F.struct(_c("context.contexts").alias("contexts"), _c("question").alias("question"))), _object(_spelt(["yes", "no", "maybe"])), F.when(decision.isin("yes", "no", "maybe"), _text(decision)))


for _name, _kind, _record, _license, _year in (
    ("vitaminc", "choice", vitaminc, "CC-BY-SA-3.0", 2021),
    ("massive", "choice", massive, "CC-BY-4.0", 2022),
    ("boolq", "noul", boolq, "CC-BY-SA-3.0", 2019),
    ("squad2", "noul", squad2, "CC-BY-SA-4.0", 2018),
    ("paws", "noul", paws, "free use", 2019),
    ("multinli", "choice", multinli, "mixed, see source", 2018),
    ("civil_comments", "noul", civil_comments, "CC0-1.0", 2019),
    ("aegis2", "noul", aegis2, "CC-BY-4.0", 2025),
    ("helpsteer2", "score", helpsteer2, "CC-BY-4.0", 2024),
    ("summeval", "score", summeval, "MIT", 2021),
    ("pubmedqa", "choice", pubmedqa, "MIT", 2019),
):
    register(SourceAdapter(_name, _name, _kind, _license, "", _year, _record))


# -- plain sources ---------------------------------------------------------


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts, names from the first line."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def read_sheet_column(spark: SparkSession, path: str, column: str = "C", first: int = 2, last: int = 61, sheet: int = 1) -> DataFrame:
    """(path, row, value): the cells of one column of a workbook's sheet, from row ``first`` to ``last``, as texts; empty cells give no row.

    A workbook is a ZIP archive of XML parts: shared texts, and one part for each sheet.  Each file is read in one task, as it is one archive.
    """
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def cells(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    shared = []
                    if "xl/sharedStrings.xml" in book.namelist():
                        shared = ["".join(t.text or "" for t in item.iter(space + "t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(space + "si")]
                    for _, cell in ElementTree.iterparse(io.BytesIO(book.read(f"xl/worksheets/sheet{sheet}.xml"))):
                        if cell.tag != space + "c":
                            continue
                        at = _CELL.fullmatch(cell.get("r", ""))
                        if at and at[1] == column and first <= int(at[2]) <= last:
                            value = cell.find(space + "v")
                            inline = "".join(t.text or "" for t in cell.iter(space + "t"))
                            text = inline if cell.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text
                            if text not in (None, ""):
                                rows.append((name, int(at[2]), text))
                yield pd.DataFrame(rows, columns=["path", "row", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, row int, value string")


def read_shards(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_tar_member(spark: SparkSession, path: str, suffix: str, schema: T.StructType) -> DataFrame:
    """Rows of the one JSON-lines member of each archive whose name ends with ``suffix``; none or several stop."""

    def lines(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    members = [m for m in archive.getmembers() if m.name.endswith(suffix)]
                    if len(members) != 1:
                        raise ValueError(f"{len(members)} members end with {suffix}")
                    text = archive.extractfile(members[0]).read().decode("utf-8")
                yield pd.DataFrame({"value": [x for x in text.split("\n") if x.strip()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def with_row_index(df: DataFrame, order: str) -> DataFrame:
    """``df`` with row_index, its place from 0 by an ordering column, from prefix sums over spans of the order."""
    return numbered(df, [], [order], "row_index").withColumn("row_index", F.col("row_index") - 1)


def cached_responses(requests: DataFrame, cache: DataFrame, rejected: DataFrame, key: str = "request_sha256") -> tuple[DataFrame, DataFrame]:
    """(hits, pending): requests with a cached response whose digest is right, and those in neither cache; a wrong digest stops."""
    hits = requests.join(cache, key)
    good = F.sha2("response", 256) == F.col("response_sha256")
    hits = hits.where(F.when(~good, F.raise_error(F.lit("cached response does not match its digest")).cast("boolean")).otherwise(True))
    return hits, requests.join(cache.select(key).unionByName(rejected.select(key)), key, "left_anti")
