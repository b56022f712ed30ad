"""A stored panel that grows by loads: only the weeks that a load touches, and those whose lags look back at them, are built again.

Facts are kept by week and load. A load writes its own folders alone, so one that was cut off is simply repeated; the panel's weeks are derived
from the facts and replaced whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from ..functions.dates import week_start
from ..sources.store import last_rows

#: Weeks after a fact in which a panel row may depend on it: its own, and those of the lags.
REACH = (0, 1, 4, 12)


def _by_week(df: DataFrame, path: str, *folders: str) -> None:
    # rebalancing gathers a week's rows in few files and splits a week that is far larger than others
    df.hint("rebalance", *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def add_facts(facts: DataFrame, path: str, load: int, date: str) -> list[dt.date]:
    """Writes a load's facts below path and returns the weeks it touches, some hundreds for ten years. Facts without a date are left out.

    ``load`` numbers the loads in their order; a number given again replaces that load's rows of the weeks it touches.
    """
    rows = facts.where(F.col(date).isNotNull()).withColumns({"week": week_start(F.col(date)), "load": F.lit(load).cast("long")})
    _by_week(rows, path, "week", "load")
    spark = facts.sparkSession
    # the folders' names tell the weeks, so neither the source nor the files are read for them
    written = spark.read.schema(rows.schema).parquet(path).where(F.col("load") == load)
    return sorted(r.week for r in written.select("week").distinct().collect())


def read_facts(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], weeks: Iterable[dt.date] | None = None) -> DataFrame:
    """The facts of the given weeks (all, if none are given), of each key and week the row of the latest load.

    A fact's key holds its date, as the composite keys of inspections do, or else a fact that moves to another week stands in both.
    """
    placed = StructType([*schema.fields, StructField("week", DateType()), StructField("load", LongType())])
    rows = spark.read.schema(placed).parquet(path)
    if weeks is not None:
        rows = rows.where(F.col("week").isin(list(weeks)))
    return last_rows(rows, ["week", *keys], ["load"]).drop("week", "load")


def refresh(facts: Callable[[Iterable[dt.date]], DataFrame], touched: Iterable[dt.date], path: str, build: Callable[[DataFrame], DataFrame], reach: Sequence[int] = REACH, week: str = "week_start") -> list[dt.date]:
    """Builds the panel's weeks that depend on the touched ones and replaces them below path; returns them.

    ``facts`` reads the facts of given weeks, ``build`` makes panel rows of facts, with lags by calendar. It sees all weeks that the rows to be replaced look back at.
    """
    wanted = sorted({w + dt.timedelta(weeks=r) for w in touched for r in reach})
    if not wanted:
        return []
    needed = sorted({w - dt.timedelta(weeks=r) for w in wanted for r in reach})
    rows = build(facts(needed)).where(F.col(week).isin(wanted))
    _by_week(rows, path, week)
    return wanted


def load(delta: DataFrame, folder: str, number: int, keys: Sequence[str], date: str, build: Callable[[DataFrame], DataFrame], reach: Sequence[int] = REACH, week: str = "week_start") -> list[dt.date]:
    """One load: its facts into ``folder``/facts, and the weeks of ``folder``/panel that depend on them; returns these. Repeating a load changes nothing."""
    spark = delta.sparkSession
    touched = add_facts(delta, f"{folder}/facts", number, date)
    return refresh(lambda weeks: read_facts(spark, f"{folder}/facts", delta.schema, keys, weeks), touched, f"{folder}/panel", build, reach, week)
