"""Sources and sinks, by round trips through the shared folder."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.ordered import numbered
from tallyforge.operators.stages import shared_folder
from tallyforge.operators.validate import InvalidRows
from tallyforge.plans.catalog import query
from tallyforge.sources import adapters, jsonl
from tallyforge.streaming import calls


def _place(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _lines(df, path: str) -> None:
    """``df`` as one JSON-lines file in order of its first column."""
    jsonl.write_jsonl(df.orderBy(df.columns[0]).coalesce(1), path)


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def read_back_lines(t):
    path = _place(t, "lines")
    jsonl.write_jsonl(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return jsonl.read_jsonl(t.spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT doc_id::VARCHAR AS id, replace(replace(text, chr(13), ''), 'a', chr(8232)) AS text FROM documents")
def separators_kept(t):
    """Texts with Unicode line separators, nulls and line feeds, written safely and read again; ids unique."""
    path = _place(t, "separators")
    rows = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("a"), F.lit(" ")).alias("text"))
    jsonl.write_jsonl(rows, path)
    return jsonl.read_unique(t.spark, path, "id string, text string")


@query("SELECT line, o_orderkey, o_totalprice FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS line, o_orderkey, o_totalprice FROM orders) WHERE line > 100 AND line <= 600")
def lines_from_offset(t):
    path = _place(t, "range")
    _lines(t.orders.select("o_orderkey", "o_totalprice"), path)
    return jsonl.read_range(t.spark, path, _schema("o_orderkey long, o_totalprice double"), 100, 500)


@query("SELECT s_suppkey, s_name, 'suppliers' AS made_of, (SELECT count(*) FROM supplier) AS stated FROM supplier")
def header_and_rows(t):
    rows = t.supplier.select(F.lit(None).cast("string").alias("__type__"), "s_suppkey", "s_name", F.lit(None).cast("string").alias("made_of"), F.lit(None).cast("long").alias("stated"))
    head = t.supplier.agg(F.count("*").alias("stated")).select(F.lit("meta").alias("__type__"), F.lit(None).cast("long").alias("s_suppkey"), F.lit(None).cast("string").alias("s_name"), F.lit("suppliers").alias("made_of"), "stated")
    path = _place(t, "header")
    jsonl.write_jsonl(head.unionByName(rows), path)
    meta, rest = jsonl.split_header(jsonl.read_jsonl(t.spark, path, "__type__ string, s_suppkey long, s_name string, made_of string, stated long"))
    return rest.select("s_suppkey", "s_name", F.lit(meta["made_of"]).alias("made_of"), F.lit(meta["stated"]).cast("long").alias("stated"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT -1, 'torn tail left out' UNION ALL SELECT -2, 'broken line refused'")
def progress_with_torn_tail(t):
    """A log whose last line was cut off gives all rows before it; one with a broken line inside is refused."""
    rows = [json.dumps(r.asDict()) for r in t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    schema, place = _schema("n_nationkey int, n_name string"), _place(t, "progress")
    jsonl.put_bytes(t.spark, f"{place}/torn.jsonl", ("\n".join(rows) + '\n{"n_nationkey": 9').encode())
    jsonl.put_bytes(t.spark, f"{place}/broken.jsonl", ("\n".join([rows[0], "{", *rows[1:]]) + "\n").encode())
    try:
        jsonl.read_progress(t.spark, f"{place}/broken.jsonl", schema)
        said = "broken line taken"
    except InvalidRows:
        said = "broken line refused"
    read = jsonl.read_progress(t.spark, f"{place}/torn.jsonl", schema).select("n_nationkey", "n_name")
    return read.unionByName(t.spark.createDataFrame([(-1, "torn tail left out"), (-2, said)], "n_nationkey int, n_name string"))


@query("SELECT line, CASE WHEN line % 7 = 0 THEN 'not a JSON object' END AS reason, CASE WHEN line % 7 <> 0 THEN c_custkey END AS c_custkey FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS line, c_custkey FROM customer)")
def numbered_with_rejects(t):
    """Every seventh line is spoilt: good rows and rejects together account for each line."""
    path = _place(t, "numbered")
    rows = numbered(t.customer.select("c_custkey"), [], ["c_custkey"], "n")
    text = F.when(F.col("n") % 7 == 0, F.concat(F.lit("spoilt "), F.col("n").cast("string"))).otherwise(F.to_json(F.struct("c_custkey")))
    rows.select("c_custkey", text.alias("value")).orderBy("c_custkey").select("value").coalesce(1).write.text(path)
    good, rejects = jsonl.read_with_rejects(t.spark, path, _schema("c_custkey long"))
    return good.select("line", F.lit(None).cast("string").alias("reason"), "c_custkey").unionByName(rejects.select("line", "reason", F.lit(None).cast("long").alias("c_custkey")))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part")
def csv_as_texts(t):
    path = _place(t, "csv")
    t.part.select("p_partkey", "p_name", "p_size").write.option("header", True).csv(path)
    return adapters.read_csv(t.spark, path)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def shards_as_one(t):
    parts = [_place(t, "shard") for _ in range(3)]
    for i, path in enumerate(parts):
        t.orders.where(F.pmod("o_orderkey", F.lit(3)) == i).write.parquet(path)
    return adapters.read_shards(t.spark, *parts).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _archive(rows: list[dict]) -> bytes:
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for name, lines in (("top/data/en-US.jsonl", rows), ("top/data/de-DE.jsonl", rows[:1]), ("top/readme", [])):
            body = "".join(json.dumps(r) + "\n" for r in lines).encode()
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return data.getvalue()


@query("SELECT n_nationkey, n_name FROM nation")
def archive_member(t):
    path = f"{_place(t, 'archive')}/x.tar.gz"
    jsonl.put_bytes(t.spark, path, _archive([r.asDict() for r in t.nation.select("n_nationkey", "n_name").collect()]))
    return adapters.read_tar_member(t.spark, path, "/data/en-US.jsonl", _schema("n_nationkey int, n_name string"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events")
def row_indexes(t):
    keyed = t.events.select("event_id", F.struct("ts", "event_id").alias("at"))
    return adapters.with_row_index(keyed, "at").select("event_id", "row_index")


def _workbook(values: list[str]) -> bytes:
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    texts = "".join(f"<si><t>{v}</t></si>" for v in values)
    rows = "".join(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{i}</v></c><c r="C{i + 1}" t="s"><v>{i}</v></c></row>' for i in range(len(values)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>{texts}</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{rows}</sheetData></worksheet>")
    return data.getvalue()


@query("SELECT n_nationkey + 1 AS row, n_name AS value FROM nation WHERE n_nationkey BETWEEN 1 AND 60")
def sheet_range(t):
    """Rows 2 to 61 of column C of a workbook that lists the nations."""
    path = f"{_place(t, 'book')}/nations.xlsx"
    jsonl.put_bytes(t.spark, path, _workbook([r[0] for r in t.nation.orderBy("n_nationkey").select("n_name").collect()]))
    return adapters.read_sheet_column(t.spark, path, "C", 2, 61).select("row", "value")


@query(
    """WITH q AS (SELECT gold_no, sha256(question) AS k FROM gold_template WHERE question IS NOT NULL)
    SELECT CASE WHEN gold_no % 3 = 0 THEN 'hit' ELSE 'pending' END AS state, count(*) AS n FROM q WHERE gold_no % 3 < 2 GROUP BY 1"""
)
def cached_and_pending(t):
    """A third of the questions is in the cache, a third among the rejected, the rest is pending."""
    requests = t.gold_template.where("question is not null").select("gold_no", F.sha2(F.concat_ws(":", "gold_no", "question"), 256).alias("request_sha256"))
    response = F.concat(F.lit("answer "), F.col("gold_no").cast("string"))
    cache = requests.where("gold_no % 3 = 0").select("request_sha256", response.alias("response"), F.sha2(response, 256).alias("response_sha256"))
    hits, pending = adapters.cached_responses(requests, cache, requests.where("gold_no % 3 = 2"))
    both = hits.select(F.lit("hit").alias("state")).unionByName(pending.select(F.lit("pending").alias("state")))
    return both.groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def documents_replaced(t):
    """A small document is written over an earlier one, whole."""
    path = f"{_place(t, 'document')}/counts.json"
    for names in (["orders"], ["orders", "customer"]):
        jsonl.atomic_json(t.spark, path, {name: getattr(t, name).count() for name in names})
    return t.spark.createDataFrame(list(json.loads(jsonl.get_text(t.spark, path)).items()), "name string, rows long")


@query("SELECT * FROM (VALUES ('first', 'written'), ('same rows again', 'kept'), ('other rows', 'refused')) v(attempt, outcome)")
def written_once(t):
    path, rows = _place(t, "once"), t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")

    def outcome(df) -> str:
        try:
            return "written" if jsonl.write_once(df, path) else "kept"
        except InvalidRows:
            return "refused"

    made = [(name, outcome(df)) for name, df in (("first", rows), ("same rows again", rows.orderBy("l_quantity")), ("other rows", rows.withColumn("l_quantity", F.col("l_quantity") + 1)))]
    return t.spark.createDataFrame(made, "attempt string, outcome string")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upserted_users(t):
    """Three batches of events, one of them given twice, upserted by user: what remains is each user's last event."""
    target = _place(t, "upserts")
    rows = t.events.select("user_id", "event_id", "value")
    write = calls.upsert(target, "user_id", "event_id", 16)
    for epoch in (0, 1, 1, 2):
        write(rows.where(F.pmod("event_id", F.lit(3)) == epoch), epoch)
    return calls.current_table(t.spark, target, rows.schema)


@query("SELECT o_orderpriority AS split, count(*) AS n FROM orders GROUP BY 1")
def split_folders(t):
    path = _place(t, "splits")
    jsonl.write_splits(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("split")), path)
    read = t.spark.read.schema("value string, split string").text(path)
    return read.groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_type = 'error')")
def appended_rows(t):
    path = _place(t, "log")
    jsonl.append_rows(t.events.select("event_id"), path)
    jsonl.append_rows(t.events.where("event_type = 'error'").select("event_id"), path)
    return jsonl.read_jsonl(t.spark, path, "event_id long").agg(F.count("*").alias("rows"))


@query(
    r"""WITH r AS (SELECT o_orderstatus s, count(*) n, avg(o_totalprice) m FROM orders GROUP BY 1)
    SELECT '# Orders' || chr(10) || chr(10) || '| status | orders | mean |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || s || ' | ' || n || ' | ' || printf('%.4f', m) || ' |' || chr(10), '' ORDER BY s) AS report FROM r"""
)
def order_report(t):
    """A Markdown report, as a text."""
    summary = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean"))
    return t.spark.createDataFrame([(jsonl.report(summary, "Orders", ["status"]),)], "report string")


@query(
    """SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS rows, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_mktsegment = 'BUILDING') AS domains,
    (SELECT string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING') AS ids, true AS read_back"""
)
def subset_manifest(t):
    """The manifest of a selected subset, by its text; the ids of a large one from the table that the manifest names."""
    chosen = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("domain"))
    place = _place(t, "manifest")
    made = jsonl.manifest(chosen, seed=7, ids_path=f"{place}/ids")
    path = f"{place}/m.json"
    jsonl.put_bytes(t.spark, path, jsonl.manifest_text(made).encode())
    read = json.loads(jsonl.get_text(t.spark, path))
    if "ids" in read:
        ids = t.spark.createDataFrame([(",".join(map(str, read["ids"])),)], "ids string")
    else:
        listed = t.spark.read.schema(chosen.select("id").schema).parquet(read["ids_table"])
        ids = listed.agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    return ids.select(F.lit(read["count"]).cast("long").alias("rows"), F.lit(len(read["domain"])).cast("long").alias("domains"), "ids", F.lit(read == made and read["seed"] == 7).alias("read_back"))
