"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots, by id, size and checksum of the text. Bytes are summed per slot, and a small versioned table
in the shared folder maps slots to shards; rebalancing adds an edited version and moves only the slots it names. Everything is DataFrame
expressions; the only table gathered into one row is the slot table, whose size is the ``slots`` parameter.

Rows that repeat id and text all hash alike. A slot of more than a quarter of a shard's share so is spread over all slots, by a number that each row got when
ids, sizes and checksums were first written down; no more than four such slots fit into a shard.

Nulls and edge cases: a null text has size 1 and a null checksum; a null id is hashed as such and sharded like
any other row; repeated rows each take a position of their own; a shard is as uneven as the largest single text; an empty table gives an empty result. Only the
id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import io

SLOTS = 4096
MAP = "version int, virtual_slot int, shard int, slot_rows long, slot_bytes long"


def virtual_slot(*keys: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_stats(rows: DataFrame) -> DataFrame:
    """(virtual_slot, slot_rows, slot_bytes) of rows with virtual_slot and size."""
    return rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def _fold(entries: Column, shards: int, start: Column) -> Column:
    """Each entry, largest first, goes to the shard with the fewest bytes so far."""

    def step(acc: Column, e: Column) -> Column:
        least = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        load = F.transform(acc["load"], lambda x, i: F.when(i == least, x + e["slot_bytes"]).otherwise(x))
        return F.struct(load.alias("load"), F.array_append(acc["shard"], least).alias("shard"))

    zero = F.struct(start.alias("load"), F.array().cast("array<int>").alias("shard"))
    return F.aggregate(entries, zero, step, lambda acc: acc["shard"])


def initial_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map: (version, virtual_slot, shard, slot_rows, slot_bytes), shard sizes near equal in bytes."""
    entry = F.struct((-F.col("slot_bytes")).alias("order"), "virtual_slot", "slot_rows", "slot_bytes")
    one = stats.agg(F.array_sort(F.collect_list(entry)).alias("e"))
    folded = one.select("e", _fold(F.col("e"), shards, F.array_repeat(F.lit(0).cast("long"), shards)).alias("s"))
    return folded.select(F.posexplode("e").alias("i", "e"), "s").select(
        F.lit(0).alias("version"), "e.virtual_slot", F.col("s")[F.col("i")].alias("shard"), "e.slot_rows", "e.slot_bytes"
    )


def rebalance(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version: slots stay where they are until their shard has its fair share; the rest move.

    Works for more or fewer shards and for changed sizes. A shard keeps its smallest slots first, up to the mean
    number of bytes a shard; the slots beyond it, new slots and those of removed shards go, largest first, to the
    shard with the fewest bytes.
    """
    known = old.select("virtual_slot", F.col("shard").alias("was"), F.col("version").alias("v"))
    rows = stats.join(known, "virtual_slot", "left")
    fair = rows.agg((F.sum("slot_bytes") / shards).alias("fair"), F.coalesce(F.max("v"), F.lit(-1)).alias("last"))
    kept = F.sum("slot_bytes").over(Window.partitionBy("was").orderBy("slot_bytes", "virtual_slot"))
    # one row a slot at most: both sides of this join are bounded by the number of slots
    rows = rows.withColumn("kept", kept).join(F.broadcast(fair))
    stay = F.col("was").isNotNull() & (F.col("was") < shards) & (F.col("kept") <= F.col("fair"))
    entry = F.struct((-F.col("slot_bytes")).alias("order"), "virtual_slot", "slot_rows", "slot_bytes", F.when(stay, F.col("was")).alias("was"))
    one = rows.agg(F.array_sort(F.collect_list(entry)).alias("all"), F.max("last").alias("last"))
    stays = F.filter("all", lambda e: e["was"].isNotNull())
    load = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda k: F.aggregate(stays, F.lit(0).cast("long"), lambda a, e: a + F.when(e["was"] == k, e["slot_bytes"]).otherwise(0)),
    )
    one = one.select("last", stays.alias("stays"), F.filter("all", lambda e: e["was"].isNull()).alias("moves"), load.alias("load"))
    one = one.select("last", "stays", "moves", _fold(F.col("moves"), shards, F.col("load")).alias("to"))
    columns = [(F.col("last") + 1).alias("version"), "e.virtual_slot", "shard", "e.slot_rows", "e.slot_bytes"]
    moved = one.select("last", F.posexplode("moves").alias("i", "e"), "to").withColumn("shard", F.col("to")[F.col("i")])
    stayed = one.select("last", F.explode("stays").alias("e")).withColumn("shard", F.col("e.was"))
    return stayed.select(*columns).unionByName(moved.select(*columns))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Appends a version to the stored map; earlier versions stay readable."""
    slot_map.select("version", "virtual_slot", "shard", "slot_rows", "slot_bytes").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    stored = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame, order: str) -> DataFrame:
    """Adds shard and slot, the row's gapless position in its shard.

    Rows are numbered inside their virtual slot, and each virtual slot starts where the one before it in the
    shard ends; the numbering so runs over thousands of small groups and not over whole shards.
    """
    before = F.sum("slot_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(order, "text_crc32", "size"))
    return (
        rows.withColumn("within", within)
        .join(F.broadcast(starts), "virtual_slot")  # a row for each virtual slot
        .withColumn("slot", (F.col("start") + F.col("within") - 1).cast("long"))
        .drop("within", "start")
    )


def sized_rows(docs: DataFrame, shards: int, slots: int) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every document, written to the shared folder."""
    text = F.col("text")
    rows = docs.select("doc_id", record_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("salt"))
    rows = io.written(rows.withColumn("virtual_slot", virtual_slot(F.col("doc_id"), F.col("size"), F.col("text_crc32"), slots=slots)), "shard-rows")
    stats = slot_stats(rows)
    most = stats.agg((F.sum("slot_bytes") / (4 * shards)).alias("most"))  # one row
    hot = stats.join(F.broadcast(most), F.col("slot_bytes") > F.col("most")).where("slot_rows > 1").select("virtual_slot", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), "virtual_slot", "left")  # 4 * shards rows at most
    spread = virtual_slot(F.col("virtual_slot"), F.col("salt"), slots=slots)
    return rows.withColumn("virtual_slot", F.when(F.col("hot"), spread).otherwise(F.col("virtual_slot"))).select("doc_id", "size", "text_crc32", "virtual_slot")


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, stored: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot of every document, shard sizes near equal in bytes.

    stored: the folder of a map with a version at least, which is rebalanced as a next version. Without one, version 0 is
    written to a new folder. Rows are assigned by what is read back from there.
    """
    spark = docs.sparkSession
    rows = sized_rows(docs, shards, slots)
    stats = slot_stats(rows)
    if stored is None:
        stored = io.shared_folder(spark, "slot-map")
        write_map(initial_map(stats, shards), stored)
    else:
        write_map(rebalance(read_map(spark, stored), stats, shards), stored)
    return assign(rows, read_map(spark, stored), "doc_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard_documents(docs, shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
