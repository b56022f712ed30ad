import datetime as dt

import duckdb
from pyspark.sql import functions as F

from quartier.plans import catalog
from quartier.streaming import alerts

SPANS = "ts timestamp, model string, tokens_in long, tokens_out long"


def at(day, hour=0):
    return dt.datetime(2024, 3, day, hour, tzinfo=dt.UTC).replace(tzinfo=None)


def test_alert_once_totals_at_the_end_and_late_rows_dropped(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    prices = spark.createDataFrame([("m", 1e6, 2e6)], "model string, usd_in double, usd_out double")  # a dollar a token in, two out
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def put(number, rows):
        spark.createDataFrame(rows, SPANS).coalesce(1).write.parquet(f"{source}/{number}")

    def run():
        stream = spark.readStream.schema(SPANS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        query = alerts.write_batches(alerts.stream_spend(stream, prices, limit=10.0, delay="6 hours"), out, checkpoint)
        query.awaitTermination()
        return alerts.dropped_late(query)

    def told():
        return sorted((r.day.day, r.kind, r.calls, r.cost) for r in alerts.read_batches(spark, out).collect())

    try:
        put(0, [(at(1, 1), "m", 4, 0), (at(1, 2), "m", 1, 2), (at(1, 3), "none", 999, 999), (None, "m", 50, 50), (at(1, 4), "m", None, None)])
        assert run() == 0 and told() == []  # 9 dollars so far
        put(1, [(at(1, 23), "m", 3, 0), (at(2, 1), "m", 1, 0)])
        assert run() == 0 and told() == [(1, "alert", 5, 12.0)]
        put(2, [(at(1, 20), "m", 100, 0)])  # six hours are not over: it counts, and no second alert comes
        assert run() == 0 and told() == [(1, "alert", 5, 12.0)]
        put(3, [(at(4, 12), "m", 0, 6)])
        run()
        assert told() == [(1, "alert", 5, 12.0), (1, "total", 6, 112.0), (2, "total", 1, 1.0), (4, "alert", 1, 12.0)]
        put(4, [(at(1, 5), "m", 500, 0), (at(2, 5), "m", 500, 0), (at(4, 13), "m", 1, 0)])  # two days that are over
        assert run() == 2
        assert told() == [(1, "alert", 5, 12.0), (1, "total", 6, 112.0), (2, "total", 1, 1.0), (4, "alert", 1, 12.0)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_costs_are_added_in_order_of_time(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    prices = spark.createDataFrame([("m", 1e6, 0.0)], "model string, usd_in double, usd_out double")
    rows = [(at(1, 1), "m", 10**16, 0), (at(1, 2), "m", 1, 0), (at(1, 2), "none", 9, 0), (at(1, 3), "m", 1, 0)]  # a dollar added to 1e16 is lost, two are not
    spark.createDataFrame(rows[::-1], SPANS).coalesce(1).write.parquet(f"{tmp_path}/in")
    try:
        stream = spark.readStream.schema(SPANS).parquet(f"{tmp_path}/in")
        alerts.write_batches(alerts.stream_spend(stream, prices), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        assert [(r.kind, r.calls, r.cost) for r in alerts.read_batches(spark, f"{tmp_path}/out").collect()] == [("alert", 4, 1e16)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_spend_alerts_equal_sql_to_the_last_digit(spark, tmp_path):
    given = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(given).orderBy(F.xxhash64("event_id")).repartition(5).write.parquet(f"{tmp_path}/events.parquet")  # files in no order of time
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{given}')")
    got = catalog.QUERIES["st5_spend_alerts"](spark, str(tmp_path)).select("day", "kind", "calls", "cost", "dropped").collect()
    want = con.execute(f"SELECT day, kind, calls, cost, dropped FROM ({catalog.ORACLES['st5_spend_alerts']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
