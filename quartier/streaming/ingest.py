"""Keyed ingest, weekly counts, duplicate suppression and spending as streams."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.store import last_rows, upsert, upsert_add

POINTER = "number long, bucket int, version string"


def _pointers(spark: SparkSession, path: str, before: int | None = None) -> list[tuple[int, str]]:
    """The newest version of each bucket, of batches before a number. There are as many rows as buckets."""
    rows = spark.read.schema(POINTER).parquet(f"{path}/_current")
    if before is not None:
        rows = rows.where(F.col("number") < before)
    return sorted((r.bucket, r.version) for r in rows.groupBy("bucket").agg(F.max_by("version", "number").alias("version")).collect())


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that the pointers name: the newest complete version of each bucket. None before the first batch."""
    return _read(spark, path, _pointers(spark, path))


def _read(spark: SparkSession, path: str, pointers: list[tuple[int, str]]) -> DataFrame | None:
    return spark.read.parquet(*[f"{path}/{version}/bucket={bucket}" for bucket, version in pointers]) if pointers else None


def stream_upsert(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, order: Sequence[str] | None = None, available_now: bool = True, add: Sequence[str] = (), buckets: int = 16) -> StreamingQuery:
    """Writes each micro-batch into a keyed table: last writer wins, or the columns ``add`` are added to what is there.

    The table is dealt by key hash into buckets. A batch writes new versions of the buckets that it touches, from those of earlier batches, and
    then pointers that carry its number; a batch that is repeated after a failure so replaces its own work, adds nothing twice, and readers
    always find a whole table. ``vacuum`` removes versions that no pointer needs.
    """
    keys = list(keys)
    spark = stream.sparkSession
    spark.createDataFrame([], POINTER).write.mode("ignore").parquet(f"{path}/_current")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in add]) if add else last_rows(batch, keys, order)
        of = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = {r.bucket for r in new.select(of.alias("bucket")).distinct().collect()}
        if not touched:
            return
        held = [(b, v) for b, v in _pointers(spark, path, number) if b in touched]
        old = _read(spark, path, held)
        if old is not None:
            new = upsert_add(old, new, keys, add) if add else upsert(old, new, keys, order=order)
        version = f"v{number:012d}-{uuid.uuid4().hex}"
        new.withColumn("bucket", of).write.partitionBy("bucket").parquet(f"{path}/{version}")
        rows = [(number, b, version) for b in sorted(touched)]
        spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("append").parquet(f"{path}/_current")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes versions that no bucket's newest pointer names; the number of those. For a table that no stream is writing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    used = {version for _, version in _pointers(spark, path)}
    old = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("v") and f.getPath().getName() not in used]
    return sum(bool(store.delete(p, True)) for p in old)


def stream_weekly_counts(stream: DataFrame, key: str, ts: str, delay: str = "0 seconds") -> DataFrame:
    """(key, week_start, n) of Monday weeks; rows later than the delay are dropped."""
    week = F.window(ts, "7 days", "7 days", "4 days")
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    counts = stream.withWatermark(ts, delay).groupBy(key, week.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("w.start").cast("date").alias("week_start"), "n")


def stream_later_than(stream: DataFrame, ts: str, cursor) -> DataFrame:
    """Rows beyond a source's cursor; those that came before, or have no time, are ignored."""
    return stream if cursor is None else stream.where(F.col(ts) > F.lit(cursor))


def stream_dedupe(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_usage(spans: DataFrame, prices: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """(day, model, calls, cost) of daily windows; the price table has a row a model."""
    cost = (F.col("tokens_in") * F.coalesce("usd_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("usd_out", F.lit(0.0))) / 1e6
    rows = spans.withWatermark(ts, delay).join(prices, "model", "left").withColumn("cost", cost)
    days = rows.groupBy(F.window(ts, "1 day").alias("w"), "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost"))
    return days.select(F.col("w.start").cast("date").alias("day"), "model", "calls", F.round("cost", 6).alias("cost"))
