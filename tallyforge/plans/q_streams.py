"""Streams over the tables, run over all that is available."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyforge.operators.stages import shared_folder, spread
from tallyforge.plans.catalog import query
from tallyforge.streaming import calls


def _stream(t, name: str):
    """A table's files as a stream; a table that is one file is read through its folder."""
    whole = getattr(t, name)
    single = all(f.endswith(f"/{name}.parquet") for f in whole.inputFiles())
    path, pattern = (t.folder, f"{name}.parquet") if single else (f"{t.folder}/{name}.parquet", "*.parquet")
    return t.spark.readStream.schema(whole.schema).option("pathGlobFilter", pattern).parquet(path)


def _checkpoint(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _result(t, df, mode="append"):
    """Run to the end into Parquet files of the shared folder and read them."""
    out = _checkpoint(t)
    if mode != "append":
        return calls.run_available(df, "s" + uuid.uuid4().hex, mode, _checkpoint(t))
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", _checkpoint(t)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_progress(t):
    return _result(t, calls.progress(_stream(t, "events"), "event_type"), "complete")


@query("SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS start, count(*) AS requests, round(sum(value), 6) AS tokens FROM events GROUP BY 1")
def stream_minutes(t):
    """Requests and amounts of each minute."""
    rows = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _result(t, calls.rolling_requests(rows, "ts", "value", "60 seconds", "60 seconds"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "requests", F.round("tokens", 6).alias("tokens"))


@query("SELECT DISTINCT o_custkey FROM orders")
def stream_coalesced(t):
    """One request for each customer within the watermark, which here spans all orders."""
    rows = _stream(t, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return _result(t, calls.coalesced(rows, "o_custkey", "ts", "10000 days").select("o_custkey"))


@query("SELECT o_orderkey::VARCHAR AS request_id, o_orderpriority || ' ' || o_orderstatus AS text, 2::INT AS chunks, true AS complete FROM orders")
def stream_folds(t):
    """Event streams of three events for each order, folded as they arrive."""
    event = lambda c: F.concat(F.lit('{"choices": [{"index": 0, "delta": {"content": '), F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6), F.lit("}}]}"))
    data = F.array(event(F.concat("o_orderpriority", F.lit(" "))), event(F.col("o_orderstatus")), F.lit("[DONE]"))
    rows = _stream(t, "orders").select(F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.posexplode(data).alias("seq", "data"))
    rows = rows.withColumn("arrival_ms", F.col("seq") * 10.0)
    return _result(t, calls.fold_stream(rows, "10000 days")).select("request_id", "text", "chunks", "complete")


@query("SELECT o_orderkey::VARCHAR AS request_id, o_orderpriority || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' ' || o_orderstatus END AS text, o_orderkey % 4 <> 0 AS complete FROM orders")
def stream_late_ends(t):
    """Event streams in reverse order of their events, a quarter of them without an end: these come out incomplete once nothing came for long."""
    event = lambda c: F.concat(F.lit('{"choices": [{"index": 0, "delta": {"content": '), F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6), F.lit("}}]}"))
    cut = F.col("o_orderkey") % 4 == 0
    data = F.when(cut, F.array(F.struct(F.lit(0).alias("seq"), event(F.col("o_orderpriority")).alias("data")))).otherwise(F.array(F.struct(F.lit(2).alias("seq"), F.lit("[DONE]").alias("data")), F.struct(F.lit(1).alias("seq"), event(F.concat(F.lit(" "), F.col("o_orderstatus"))).alias("data")), F.struct(F.lit(0).alias("seq"), event(F.col("o_orderpriority")).alias("data"))))
    rows = spread(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")).select(F.col("o_orderkey").cast("string").alias("request_id"), F.explode(data).alias("x")).select("request_id", "x.seq", "x.data", F.lit(1000).alias("t"), (F.col("x.seq") * 10.0).alias("arrival_ms"))
    folder = f"{shared_folder(t.spark)}/late-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    files = len(t.spark.read.schema(rows.schema).parquet(folder).inputFiles())
    for t_end in (100_000, 200_000):  # as many files each, so that a trigger takes what one write made
        end = t.spark.range(0, files, 1, files).select(F.lit("").alias("request_id"), F.lit(0).alias("seq"), F.lit("[DONE]").alias("data"), F.lit(t_end).alias("t"), F.lit(0.0).alias("arrival_ms"))
        end.write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.timestamp_seconds("t"))
    return _result(t, calls.fold_stream(stream)).where("request_id <> ''").select("request_id", "text", "complete")
