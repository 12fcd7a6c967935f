"""JSON-lines files and reports: reading with line numbers and rejects, writing with safe separators and guards."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.validate import InvalidRows, demand_unique


def read_jsonl(spark: SparkSession, path: str, schema, strict: bool = True) -> DataFrame:
    """One object for each ``\\n`` line; other line separators stay inside values; blank lines are passed over."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_unique(spark: SparkSession, path: str, schema, key: str = "id") -> DataFrame:
    """As ``read_jsonl``; an empty file or a repeated key stops."""
    return demand_unique(read_jsonl(spark, path, schema), key)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text): lines of a file with their number from 1, a leading byte-order mark removed.

    Lines carry the start of their block, and blocks are numbered by prefix sums of their line counts, so a large file stays split.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i"))
    counts = raw.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")).select("_file", "_block", "_first", "_before")
    joined = raw.join(before, ["_file", "_block"])
    text = F.regexp_replace(F.col("value"), "\r$", "")
    line = (F.col("_i") - F.col("_first") + F.col("_before") + 1).cast("long")
    return joined.select(line.alias("line"), F.when(line == 1, F.regexp_replace(text, "^﻿", "")).otherwise(text).alias("text"))


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with ``line``, rejects of line and reason): blank lines count as lines, bad ones become rejects."""
    lines = numbered_lines(spark, path).where(F.trim("text") != "")
    good = F.try_parse_json("text").isNotNull() & F.ltrim("text").startswith("{")
    rows = lines.where(good).select("line", F.from_json("text", schema).alias("r")).select("line", "r.*")
    return rows, lines.where(~good).select("line", F.lit("not a JSON object").alias("reason"))


def read_range(spark: SparkSession, path: str, schema: T.StructType, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Non-blank records from ``offset`` on, at most ``limit`` of them, in file order."""
    lines = numbered_lines(spark, path).where(F.trim("text") != "").orderBy("line").offset(offset)
    lines = lines if limit is None else lines.limit(limit)
    bad = F.raise_error(F.concat(F.lit(f"{path}:"), F.col("line").cast("string"))).cast(schema)
    parsed = F.when(F.try_parse_json("text").isNotNull(), F.from_json("text", schema)).otherwise(bad)
    return lines.select("line", parsed.alias("r")).select("line", "r.*")


def split_header(df: DataFrame, marker: str = "__type__", value: str = "meta") -> tuple[dict | None, DataFrame]:
    """(metadata of the header row or None, the other rows)."""
    head = df.where(F.col(marker) == value).limit(1).collect()
    return (head[0].asDict(recursive=True) if head else None), df.where(~F.col(marker).eqNullSafe(value))


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms, so that shared and local folders are handled alike."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file that is complete or not there at all: written beside its place and renamed onto it, over what is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.partial")
    fs, target = _hadoop(spark, path)
    out = fs.create(beside, True)
    try:
        out.write(data)
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    qualified = fs.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(fs.makeQualified(beside), qualified, options)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is none."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _ends_torn(spark: SparkSession, path: str) -> bool:
    """Whether a file's last byte is no line feed."""
    fs, at = _hadoop(spark, path)
    size = fs.getFileStatus(at).getLen()
    if not size:
        return False
    stream = fs.open(at)
    try:
        stream.seek(size - 1)
        return stream.read() != 10
    finally:
        stream.close()


def read_progress(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of an append-only log; only an unterminated last line may fail to parse, and is left out."""
    rows, rejects = read_with_rejects(spark, path, schema)
    bad = rejects.orderBy("line").limit(2).collect()
    if bad:
        last = numbered_lines(spark, path).agg(F.max("line")).first()[0]
        if len(bad) > 1 or bad[0]["line"] != last or not _ends_torn(spark, path):
            raise InvalidRows(f"{path}:{bad[0]['line']}: {bad[0]['reason']}")
    return rows


def latest_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last logged row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_r")).select("_r.*")


def json_line(*columns: str | Column, escape_separators: bool = True) -> Column:
    """A row as JSON text with nulls kept; the line separators of Unicode escaped."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    for code in ("2028", "2029", "0085") if escape_separators else ():
        text = F.replace(text, F.lit(chr(int(code, 16))), F.lit("\\u" + code))
    return text


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", escape_separators: bool = True) -> None:
    """One JSON object for each row; an existing output stops unless ``mode`` says otherwise."""
    df.select(json_line("*", escape_separators=escape_separators).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split."""
    df.select(json_line("*").alias("value"), F.col(split).alias(split)).write.partitionBy(split).option("lineSep", "\n").text(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.select(json_line("*").alias("value")).write.mode("append").option("lineSep", "\n").text(path)


def atomic_json(spark: SparkSession, path: str, value) -> None:
    """A small document, complete or not there at all, in any folder that Hadoop's file systems reach."""
    put_bytes(spark, path, (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def table_fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows regardless of their order: sums of row hashes under two seeds, and the count."""
    a, b = (F.sum(F.xxhash64(F.lit(s), F.to_json(F.struct("*"))).cast("decimal(20,0)")) for s in (1, 2))
    row = df.agg(F.count("*"), a, b).first()
    return ":".join(str(x or 0) for x in row)


def write_once(df: DataFrame, path: str) -> bool:
    """Write unless the path already holds the same rows (then False); other rows there stop."""
    spark = df.sparkSession
    fs, at = _hadoop(spark, path)
    if fs.exists(at):
        if table_fingerprint(spark.read.schema(df.schema).parquet(path)) != table_fingerprint(df):
            raise InvalidRows(f"{path} holds other rows")
        return False
    df.write.parquet(path)
    return True


def manifest(df: DataFrame, key: str = "id", facets: tuple[str, ...] = ("type", "label", "domain"), most: int = 100_000, ids_path: str | None = None, **facts) -> dict:
    """Counts, histograms, a digest and the id list of a selected subset.

    Ids come into the manifest for at most ``most`` rows.  A larger subset stops, or with ``ids_path`` has them written there in order, and
    the manifest names that table.  A facet of more than ``most`` values stops.
    """
    count = df.count()
    counts = {}
    for f in (f for f in facets if f in df.columns):
        values = df.groupBy(f).count().limit(most + 1).collect()
        if len(values) > most:
            raise InvalidRows(f"{f} has more than {most} values")
        counts[f] = {str(r[0]): r[1] for r in values}
    made = {"count": count, "dataset_digest": table_fingerprint(df), **counts, **facts}
    if count <= most:
        return made | {"ids": [r[0] for r in df.select(key).orderBy(key).collect()]}
    if ids_path is None:
        raise InvalidRows(f"{count} ids are more than {most}; name an ids_path for them")
    df.select(key).orderBy(key).write.parquet(ids_path)
    return made | {"ids_table": ids_path}


def manifest_text(value: dict) -> str:
    """The manifest with one field to a line, the ids on one."""
    body = ",\n".join(f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False, sort_keys=True)}" for k, v in value.items())
    return "{\n" + body + "\n}\n"


def markdown_table(rows: list[dict], columns: list[str] | None = None, digits: int = 4) -> str:
    """A small summary as a Markdown table; null is an empty cell."""
    columns = columns or (list(rows[0]) if rows else [])
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


def report(df: DataFrame, title: str, order: list[str], most: int = 1000) -> str:
    """A Markdown report of a summary table of at most ``most`` rows."""
    rows = [r.asDict() for r in df.orderBy(*order).limit(most + 1).collect()]
    if len(rows) > most:
        raise InvalidRows("too many rows for a report")
    return f"# {title}\n\n{markdown_table(rows)}"
