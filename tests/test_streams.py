import json

from pyspark.sql import functions as F

from tallyforge.plans import q_streams
from tallyforge.streaming import calls


def event(text):
    return json.dumps({"choices": [{"index": 0, "delta": {"content": text}}]})


def test_fold_emits_complete_and_timed_out_requests(spark, tmp_path):
    rows = [("a", 0, 5.0, 1000, event("x")), ("a", 1, 9.0, 1001, event("y")), ("a", 2, 9.5, 1002, "[DONE]"), ("b", 0, 3.0, 1000, event("z"))]
    schema = "request_id string, seq int, arrival_ms double, t int, data string"
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    spark.createDataFrame([("c", 0, 1.0, 100_000, event("w"))], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("d", 0, 1.0, 200_000, event("v")), ("d", 1, 2.0, 200_000, "[DONE]")], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_seconds("t"))
    got = {r["request_id"]: r for r in calls.run_available(calls.fold_stream(stream), "folded", checkpoint=str(tmp_path / "cp")).collect()}
    assert (got["a"]["text"], got["a"]["chunks"], got["a"]["ttft_ms"], got["a"]["complete"]) == ("xy", 2, 5.0, True)
    assert got["d"]["complete"] and not got["b"]["complete"] and got["b"]["text"] == "z"


def test_upsert_is_idempotent(spark, tmp_path):
    target = str(tmp_path / "t")
    write = calls.upsert(target, "id", "v")
    one = spark.createDataFrame([(1, 1), (2, 1)], "id int, v int")
    two = spark.createDataFrame([(2, 2), (3, 1)], "id int, v int")
    for batch, epoch in ((one, 0), (two, 1), (two, 1), (one, 0)):
        write(batch, epoch)
    assert sorted(map(tuple, calls.current_table(spark, target, one.schema).collect())) == [(1, 1), (2, 2), (3, 1)]


def test_upsert_writes_only_the_buckets_of_a_batch(spark, tmp_path):
    target = str(tmp_path / "t")
    write = calls.upsert(target, "id", "v", 16)
    many = spark.range(1000).select(F.col("id").cast("int").alias("id"), F.lit(1).alias("v"))
    assert calls.current_table(spark, target, many.schema).count() == 0
    write(many, 0)
    for epoch in range(1, 4):
        write(spark.createDataFrame([(7, epoch + 1)], many.schema), epoch)
        written = [p for p in (tmp_path / "t" / f"v{epoch}").glob("_bucket=*")]
        assert len(written) == 1
    got = {r["id"]: r["v"] for r in calls.current_table(spark, target, many.schema).collect()}
    assert len(got) == 1000 and got[7] == 4 and set(got.values()) == {1, 4}
    assert len(list((tmp_path / "t" / "v0").glob("_bucket=*"))) == 15
    write(many.limit(0), 9)
    assert calls.current_table(spark, target, many.schema).count() == 1000


def test_events_are_folded_in_their_order_whenever_they_come(spark, tmp_path):
    schema = "request_id string, seq int, arrival_ms double, t int, data string"
    folder = str(tmp_path / "in")
    batches = [[("a", 2, 7.0, 1002, event("c")), ("a", 0, 5.0, 1000, event("a")), ("b", 1, 2.0, 1000, "[DONE]")], [("a", 3, 8.0, 1003, "[DONE]"), ("a", 2, 9.0, 1004, event("no"))], [("a", 1, 6.0, 1001, event("b")), ("c", 1, 4.0, 1001, event("late"))], [("z", 0, 1.0, 100_000, event("w"))], [("z", 1, 1.0, 200_000, "[DONE]")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_seconds("t"))
    got = {r["request_id"]: r for r in calls.run_available(calls.fold_stream(stream), "ordered", checkpoint=str(tmp_path / "cp")).collect()}
    assert (got["a"]["text"], got["a"]["chunks"], got["a"]["ttft_ms"], got["a"]["last_ms"], got["a"]["complete"]) == ("abc", 3, 5.0, 7.0, True)
    assert not got["b"]["complete"] and got["b"]["chunks"] == 0 and got["c"]["text"] == "late" and not got["c"]["complete"] and got["z"]["complete"]


def test_coalescing_and_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("k", 1, 5), ("k", 2, 7), ("j", 61, 1)], "request_sha256 string, t int, tokens int").write.parquet(folder)
    stream = spark.readStream.schema("request_sha256 string, t int, tokens int").parquet(folder).withColumn("ts", F.timestamp_seconds("t"))
    assert calls.run_available(calls.coalesced(stream), "one", checkpoint=str(tmp_path / "a")).count() == 2
    rows = calls.run_available(calls.rolling_requests(stream, width="60 seconds", step="60 seconds"), "two", "complete", str(tmp_path / "b")).orderBy("start").collect()
    assert [(r["requests"], r["tokens"]) for r in rows] == [(2, 12), (1, 1)]


def test_many_requests_share_state_and_calls_and_come_out_alone(spark, tmp_path):
    schema = "request_id string, seq int, arrival_ms double, t int, data string"
    folder = str(tmp_path / "in")
    rows = [(f"r{i}", seq, 10.0 * seq, 1000 + seq, "[DONE]" if seq == 2 else event(f"{i}.{seq} ")) for i in range(3000) for seq in range(3) if i % 4 or seq < 2]
    first, second = [r for r in rows if r[1] != int(r[0][1:]) % 3], [r for r in rows if r[1] == int(r[0][1:]) % 3 or r[1] == 1]
    for part in (first, second, [("x", 0, 1.0, 100_000, event("w"))], [("x", 1, 1.0, 200_000, "[DONE]")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_seconds("t"))
    query = calls.fold_stream(stream).writeStream.format("memory").queryName("many").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    got = sorted((r["request_id"], r["text"], r["chunks"], r["ttft_ms"], r["last_ms"], r["complete"]) for r in spark.table("many").collect())
    assert got == sorted([(f"r{i}", f"{i}.0 {i}.1 ", 2, 0.0, 10.0, bool(i % 4)) for i in range(3000)] + [("x", "w", 1, 1.0, 1.0, True)])
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 1024


def test_late_ends_are_written_by_many_tasks_and_each_write_is_one_trigger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_streams, "shared_folder", lambda spark: str(tmp_path))
    orders = spark.range(400).select(F.col("id").alias("o_orderkey"), F.lit("HIGH").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"))
    orders.coalesce(1).write.parquet(str(tmp_path / "tables/orders.parquet"))
    got = sorted(map(tuple, q_streams.stream_late_ends(spark, str(tmp_path / "tables")).collect()))
    assert got == sorted((str(i), "HIGH" if i % 4 == 0 else "HIGH F", i % 4 != 0) for i in range(400))
    assert len(list(next(tmp_path.glob("late-*")).glob("*.parquet"))) == 3 * spark.sparkContext.defaultParallelism > 3
