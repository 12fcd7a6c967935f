"""Structured Streaming forms of the logs' behaviour: folding event streams, idempotent upserts, rolling budgets, coalescing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tallyforge.functions.parse import delta_text, fold_events
from tallyforge.functions.parse import events as parsed_events
from tallyforge.sources.jsonl import get_text, put_bytes

FOLDED = "request_id string, text string, chunks int, ttft_ms double, last_ms double, complete boolean"


def fold_stream(events: DataFrame, timeout: str = "10 minutes", groups: int = 1024) -> DataFrame:
    """(request_id, text, chunks, ttft_ms, last_ms, complete): each request's stream of (request_id, seq, arrival_ms, ts, data), where seq counts from 0.

    Events are taken in order of ``seq``, in whatever order and trigger they arrive: one that comes early waits for those before it.  A request
    comes out when everything up to ``[DONE]`` is there, or, incomplete but with all that had arrived, when nothing came for ``timeout`` of
    event time.  Late events of a finished request and repeated ones are dropped.  State is one row for each of ``groups`` groups of requests by
    their hash, with all of the open ones and the ids of the finished ones until their timeout: a call of Python for each request would cost far
    more than its events, and a trigger writes the groups that it has events of.  ``groups`` stays as it is for the life of a checkpoint.
    """
    patience = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state):
        # by id: [deadline] of a finished request, [deadline, text, chunks, first, last, at, early] of an open one
        known: dict[str | None, list] = {i: held for i, *held in json.loads(state.get[0])} if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        latest: dict[str | None, int] = {}
        out: list[tuple] = []

        def take(held, piece, arrival):
            if piece:
                held[1], held[2] = held[1] + piece, held[2] + 1
                held[3] = arrival if held[3] < 0 else held[3]
                held[4] = arrival

        for batch in batches if not state.hasTimedOut else ():
            times = batch["ts"].astype("datetime64[ms]").astype("int64").tolist()
            for i, seq, ms, piece, arrival, closing in zip(batch["request_id"].tolist(), batch["seq"].tolist(), times, batch["piece"].tolist(), batch["arrival_ms"].tolist(), batch["closing"].tolist()):
                latest[i] = max(latest.get(i, 0), ms)
                held = known.get(i)
                if held is None:
                    held = known[i] = [0, "", 0, -1.0, -1.0, 0, {}]
                if len(held) > 1 and seq >= held[5]:
                    held[6].setdefault(str(int(seq)), [piece if isinstance(piece, str) else None, arrival, bool(closing)])
        for i, ms in latest.items():
            held = known[i]
            held[0] = max(ms, watermark) + patience
            while len(held) > 1 and (event := held[6].pop(str(held[5]), None)):
                piece, arrival, closing = event
                held[5] += 1
                take(held, None if closing else piece, arrival)
                if closing:
                    out.append((i, *held[1:5], True))
                    del held[1:]
        for i in [i for i, held in known.items() if held[0] < watermark]:
            held = known.pop(i)
            if len(held) > 1:
                for _, (piece, arrival, closing) in sorted(held[6].items(), key=lambda x: int(x[0])):
                    if not closing:
                        take(held, piece, arrival)
                out.append((i, *held[1:5], False))
        if known:
            state.update((json.dumps([[i, *held] for i, held in known.items()]),))
            state.setTimeoutTimestamp(min(held[0] for held in known.values()))
        else:
            state.remove()
        if out:
            ids, texts, chunks, first, last, complete = map(list, zip(*out))
            times = lambda xs: pd.array([x if x >= 0 else None for x in xs], dtype="Float64")
            yield pd.DataFrame({"request_id": ids, "text": texts, "chunks": chunks, "ttft_ms": times(first), "last_ms": times(last), "complete": complete})

    event = F.get(parsed_events(F.concat(F.lit("data: "), F.col("data"))), 0)
    group = F.pmod(F.xxhash64("request_id"), F.lit(groups)).cast("int")
    parsed = events.withWatermark("ts", timeout).select("request_id", group.alias("group"), F.col("seq").cast("long").alias("seq"), "ts", F.col("arrival_ms").cast("double").alias("arrival_ms"), (F.col("data") == "[DONE]").alias("closing"), F.when(F.col("data") != "[DONE]", F.get(event["choices"], 0)["delta"]).alias("delta"))
    prepared = parsed.withColumn("delta", F.when(~F.col("closing"), delta_text(F.col("delta")))).withColumnRenamed("delta", "piece")
    return prepared.groupBy("group").applyInPandasWithState(fold, FOLDED, "requests string", "append", GroupStateTimeout.EventTimeTimeout)


def fold_batch(events: DataFrame) -> DataFrame:
    """(request_id, content, complete) of recorded bodies (request_id, body), as a batch: what the stream must agree with."""
    return events.select("request_id", fold_events(parsed_events(F.col("body")))["content"].alias("content"))


BUCKETS = 64


def _pointer(spark: SparkSession, target: str) -> dict:
    """What is current: the version of each bucket, the last batch, and folders that nothing names any more."""
    text = get_text(spark, f"{target}/_current.json")
    return json.loads(text) if text else {"epoch": -1, "buckets": {}, "stale": []}


def upsert(target: str, key: str, order: str, buckets: int = BUCKETS):
    """A ``foreachBatch`` function that keeps the last row of each key in a Parquet table, also if a batch is given twice.

    Keys lie in ``buckets`` by their hash.  A batch reads and writes the buckets its keys fall into, and no others, then a pointer file that
    names each bucket's current version is renamed into place, so readers see the whole batch or nothing of it.  Versions replaced by
    the batch before are deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        current = _pointer(spark, target)
        if current["epoch"] >= epoch:
            return
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())
            known = [current["buckets"][str(b)] for b in touched if str(b) in current["buckets"]]
            rows = batch.select("*")
            if known:
                rows = spark.read.schema(batch.schema).parquet(*(f"{target}/{v}" for v in known)).unionByName(batch)
            latest = rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_r")).select("_r.*")
            if touched:
                latest.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/v{epoch}")
        finally:
            batch.unpersist()
        made = {str(b): f"v{epoch}/_bucket={b}" for b in touched}
        put_bytes(spark, f"{target}/_current.json", json.dumps({"epoch": epoch, "buckets": current["buckets"] | made, "stale": known}).encode())
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for old in current["stale"]:
            fs.delete(fs_path(f"{target}/{old}"), True)

    return write


def current_table(spark: SparkSession, target: str, schema) -> DataFrame:
    """The table as its last whole batch left it; no rows before the first."""
    paths = [f"{target}/{v}" for v in _pointer(spark, target)["buckets"].values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def rolling_requests(calls: DataFrame, ts: str = "ts", tokens: str = "tokens", width: str = "60 seconds", step: str = "1 second", late: str = "2 minutes") -> DataFrame:
    """(start, end, requests, tokens) of sliding windows; rows later than ``late`` are dropped."""
    w = calls.withWatermark(ts, late).groupBy(F.window(ts, width, step)).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests", "tokens")


def coalesced(requests: DataFrame, key: str = "request_sha256", ts: str = "ts", within: str = "10 minutes") -> DataFrame:
    """The first of equal requests within the watermark."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def progress(calls: DataFrame, state: str) -> DataFrame:
    """Running counts by state, for update or complete mode."""
    return calls.groupBy(state).agg(F.count("*").alias("n"))


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is available now into an in-memory table, for tests and small reports."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
