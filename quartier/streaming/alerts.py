"""Daily spending as a stream with state of its own: an alert once a day, totals when a day is over, late rows dropped and counted."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "day date, kind string, calls long, cost double"


class DailySpend(StatefulProcessor):
    """Keeps calls and cost of a day until the watermark passes its end.

    The state of a day is one row. The alert goes out in the micro-batch in which the cost passes the limit, and never again for that day, restarts
    included; a timer at the day's end gives the total and clears the state, so no day is kept for ever. Sums of doubles depend on their order: a micro-batch
    adds a day's costs one by one in order of time (at one time the least first), however files and tasks deal them, and holds 16 bytes for each that is not zero.
    """

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "calls long, cost double, told boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        day = key[0]
        if self.spent.exists():
            calls, cost, told = self.spent.get()
        else:
            calls, cost, told = 0, 0.0, False
            end = dt.datetime.combine(day + dt.timedelta(days=1), dt.time(), dt.UTC)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        times, costs = [], [np.array([cost])]
        for pdf in rows:
            paid = pdf["cost"].abs().to_numpy() > 0
            calls += len(pdf)
            times.append(pdf["micros"].to_numpy()[paid])
            costs.append(pdf["cost"].to_numpy()[paid])
        new = np.concatenate(costs)
        new[1:] = new[1:][np.lexsort((new[1:], np.concatenate(times)))]
        cost = float(np.add.accumulate(new)[-1])  # sum() would add by pairs
        alert = not told and cost > self.limit
        self.spent.update((calls, cost, told or alert))
        if alert:
            yield pd.DataFrame({"day": [day], "kind": ["alert"], "calls": [calls], "cost": [cost]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        calls, cost, _ = self.spent.get()
        self.spent.clear()
        yield pd.DataFrame({"day": [key[0]], "kind": ["total"], "calls": [calls], "cost": [cost]})

    def close(self) -> None:
        pass


def stream_spend(spans: DataFrame, prices: DataFrame, limit: float = 1.0, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """(day, kind, calls, cost): one ``alert`` a day when its cost has passed the limit, and one ``total`` when the day (of UTC) is over.

    spans: (ts, model, tokens_in, tokens_out); prices: (model, usd_in, usd_out) for a million tokens, a row a model. Rows that come after
    the watermark has passed their time are dropped, and ``dropped_late`` counts them; rows without a time are left out, a model without a price costs nothing. Costs are
    doubles, added in order of time within a micro-batch. The session's state store becomes the one that such operators need.
    """
    spans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    usd = lambda tokens, price: F.coalesce(F.col(tokens), F.lit(0)) * F.coalesce(F.col(price), F.lit(0.0))
    rows = spans.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    cost = (usd("tokens_in", "usd_in") + usd("tokens_out", "usd_out")) / 1e6
    priced = rows.join(prices, "model", "left").select(ts, _utc_day(F.col(ts)).alias("day"), F.unix_micros(ts).alias("micros"), cost.alias("cost"))
    return priced.groupBy("day").transformWithStateInPandas(DailySpend(limit), OUT, "Append", "EventTime")


def _utc_day(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators dropped as late, in the progress reports that are kept (100 unless set otherwise)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream gives to a table, one folder a micro-batch, which a repeated batch replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str, schema: str = OUT) -> DataFrame:
    return spark.read.option("basePath", path).schema(f"{schema}, batch int").parquet(f"{path}/*")
