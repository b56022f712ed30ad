import datetime as dt

from pyspark.sql import functions as F

from quartier.streaming import ingest


def feed(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_upsert_keeps_the_last_of_each_key(spark, tmp_path):
    schema = "k int, v int"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.stream_upsert(feed(spark, tmp_path, [[(1, 1), (2, 1)], [(2, 2), (2, 3), (3, 1)]], schema), out, ["k"], state, order=["v"]).awaitTermination(120)
    assert sorted(map(tuple, ingest.current_table(spark, out).collect()))[0] == (1, 1)
    assert {r.k for r in ingest.current_table(spark, out).collect()} == {1, 2, 3}
    spark.createDataFrame([(1, 9)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.stream_upsert(again, out, ["k"], state).awaitTermination(120)
    assert (1, 9) in set(map(tuple, ingest.current_table(spark, out).collect()))


def test_weekly_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.stream_weekly_counts(stream, "event_type", "ts", "90 days").writeStream.outputMode("complete").format("memory").queryName("weekly").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy("event_type", F.date_trunc("week", "ts").cast("date").alias("w")).count()
    assert sorted(map(tuple, spark.table("weekly").collect())) == sorted(map(tuple, want.collect()))


def test_dedupe_and_usage(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [("a", t, "m", 1000, 0), ("a", t, "m", 1000, 0), ("b", t, "x", 5, 5)]
    spark.createDataFrame(rows, "id string, ts timestamp, model string, tokens_in long, tokens_out long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp, model string, tokens_in long, tokens_out long").parquet(str(tmp_path / "in"))
    q = ingest.stream_dedupe(stream, ["id"], "ts", "1 hour").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2
    prices = spark.createDataFrame([("m", 2.0, 1.0)], "model string, usd_in double, usd_out double")
    q = ingest.stream_usage(stream, prices).writeStream.outputMode("complete").format("memory").queryName("spent").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.model, r.calls, r.cost) for r in spark.table("spent").collect()) == [("m", 2, 0.004), ("x", 1, 0.0)]


def test_added_columns_are_not_added_twice(spark, tmp_path):
    schema = "k int, n long"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.stream_upsert(feed(spark, tmp_path, [[(1, 1), (2, 1), (1, 4)], [(2, 2), (None, 5)]], schema), out, ["k"], state, add=["n"], buckets=3).awaitTermination(120)
    assert sorted(map(tuple, ingest.current_table(spark, out).collect()), key=str) == [(1, 5), (2, 3), (None, 5)]
    # a run without the stream's state repeats its batches: each starts from the table as it was before that batch
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.stream_upsert(again, out, ["k"], state + "2", add=["n"], buckets=3).awaitTermination(120)
    assert {r.k: r.n for r in ingest.current_table(spark, out).collect()}[1] == 5
    before = sorted(map(tuple, ingest.current_table(spark, out).collect()), key=str)
    assert ingest.vacuum(spark, out) > 0 and sorted(map(tuple, ingest.current_table(spark, out).collect()), key=str) == before


def test_rows_before_the_cursor_are_ignored(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3)), (3, None)]
    stream = feed(spark, tmp_path, [rows], "k int, ts timestamp")
    out = str(tmp_path / "out")
    ingest.stream_upsert(ingest.stream_later_than(stream, "ts", dt.datetime(2024, 1, 2)), out, ["k"], str(tmp_path / "state")).awaitTermination(120)
    assert [r.k for r in ingest.current_table(spark, out).collect()] == [2]
