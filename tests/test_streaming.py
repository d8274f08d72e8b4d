from pyspark.sql import functions as F

from lexigrove.sources.versions import Versions
from lexigrove.streaming import events as S

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def write(spark, path, rows):
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)


def test_latest_from_a_stream(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/state"
    write(spark, src, [(1, "2024-01-01 00:00:00", 7, "a", 1.0), (2, "2024-01-01 01:00:00", 7, "b", 2.0)])
    for rows in ([], [(3, "2024-01-01 02:00:00", 7, "c", 3.0), (4, "2024-01-01 00:30:00", 8, "d", 4.0)]):
        if rows:
            write(spark, src, rows)
        stream = spark.readStream.schema(EVENTS).parquet(src)
        S.keep_latest(stream, ["user_id"], ["ts", "event_id"], out, f"{tmp_path}/ck").awaitTermination()
    latest = lambda: sorted((r.user_id, r.event_id) for r in S.read_latest(spark, out, ["user_id"], ["ts", "event_id"]).collect())
    assert latest() == [(7, 3), (8, 4)]
    changes = Versions(spark, out)
    assert changes.read().count() == 3
    # A late row and a repeated one write nothing; a null place is before all others.
    write(spark, src, [(0, "2023-01-01 00:00:00", 7, "late", 0.0), (4, "2024-01-01 00:30:00", 8, "again", 4.0), (9, None, 8, "no time", 0.0), (5, None, 9, "e", 1.0)])
    S.keep_latest(spark.readStream.schema(EVENTS).parquet(src), ["user_id"], ["ts", "event_id"], out, f"{tmp_path}/ck").awaitTermination()
    assert changes.read().count() == 4 and latest() == [(7, 3), (8, 4), (9, 5)]
    S.compact_latest(spark, out, ["user_id"], ["ts", "event_id"])
    assert changes.read().count() == 3 and latest() == [(7, 3), (8, 4), (9, 5)]
    # The batch of a stream that is written again is left out.
    last = max(changes.current()[1]["batches"].values())
    assert not changes.append(spark.read.parquet(src).limit(1), (f"{tmp_path}/ck", last)) and changes.read().count() == 3


def test_tumbling_stream_equals_batch(spark, tmp_path):
    src = f"{tmp_path}/in"
    write(spark, src, [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 2, "t", float(i)) for i in range(30)])
    stream = S.tumbling(spark.readStream.schema(EVENTS).parquet(src), "1 day", late="1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = S.tumbling(spark.read.parquet(src), "1 day")
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, batch.collect()))
    assert S.tumbling(spark.read.parquet(src), "1 day", "12 hours").count() > batch.count()


def test_pending_work_is_resumed(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/points"
    calls = []

    def work(batch):
        ids = [r.chunk_id for r in batch.select("chunk_id").collect()]
        calls.append(sorted(ids))
        status = F.when((F.col("chunk_id") == "b") & F.lit(len(calls) == 1), "error").otherwise("success")
        return batch.select("chunk_id", status.alias("status"), F.lit(0).alias("record_count"), F.lit("").alias("error_message"))

    for n in range(2):
        spark.createDataFrame([("a",), ("b",)], "chunk_id string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("chunk_id string").parquet(src)
        S.process_pending(stream, work, out, f"{tmp_path}/ck").awaitTermination()
    assert calls == [["a", "b"], ["b"]]
    assert {(r.chunk_id, r.status) for r in S.records(spark, out).collect()} == {("a", "success"), ("b", "success")}
    assert Versions(spark, out).read().count() == 3


def test_keys_are_worked_once(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/points"

    def work(rows):
        if rows["part"].iloc[0] == 0 and rows["chunk_id"].iloc[0] == "c":
            raise ValueError("not yet")
        return ("error" if rows["chunk_id"].iloc[0] == "b" else "success"), len(rows), ""

    for part in range(3):
        keys = [("a", part), ("a", part), ("b", part), ("c", part)]
        spark.createDataFrame(keys, "chunk_id string, part int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("chunk_id string, part int").parquet(src)
        S.process_keys(stream, work, out, f"{tmp_path}/ck").awaitTermination()
    log = sorted((r.chunk_id, r.status, r.record_count, r.error_message) for r in Versions(spark, out).read().collect())
    assert log == [("a", "success", 2, ""), ("b", "error", 1, ""), ("b", "error", 1, ""), ("b", "error", 1, ""), ("c", "error", 0, "not yet"), ("c", "success", 1, "")]
    assert {(r.chunk_id, r.status) for r in S.records(spark, out).collect()} == {("a", "success"), ("b", "error"), ("c", "success")}


def test_sessions(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 7), (2, "2024-01-01 00:20:00", 7), (3, "2024-01-01 02:00:00", 7)], "event_id long, ts string, user_id long")
    assert sorted(r.n for r in S.sessions(df.withColumn("ts", F.to_timestamp("ts"))).collect()) == [1, 2]
