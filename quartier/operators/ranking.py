"""Top rows, unions and set differences."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import within_join


def recent_in_area(points: DataFrame, polys: DataFrame, area: str, since: dt.date, n: int = 500, date: str = "inspection_date", key: str = "nta_id", cell: float = 0.02) -> DataFrame:
    """An area's latest points since a date, newest first."""
    rows = within_join(points.where(F.col(date) >= F.lit(since)), polys.where(F.col(key) == area), cell)
    ties = [c for c in points.columns if c != date and not points.schema[c].dataType.typeName().startswith(("map", "struct"))]
    return rows.orderBy(F.desc(date), *ties).limit(n)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group (of the whole table with no group) with their rank; "-" before a name means descending."""
    sort = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    if not by:
        first = df.orderBy(*sort).limit(n)  # n rows
        return first.withColumn("rank", F.row_number().over(Window.orderBy(*sort)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*sort))).where(F.col("rank") <= n)


def top_factors(df: DataFrame, array: str, n: int = 5, out: str = "top_factors") -> DataFrame:
    """The n entries (feature, contribution) of an array column with the greatest absolute contribution."""
    keyed = F.transform(array, lambda f: F.struct((-F.abs(f["contribution"])).alias("k"), f["feature"].alias("feature"), f["contribution"].alias("contribution")))
    best = F.transform(F.slice(F.array_sort(keyed), 1, n), lambda f: F.struct(f["feature"].alias("feature"), f["contribution"].alias("contribution")))
    return df.withColumn(out, best)


def latest_weeks(df: DataFrame, date: str = "week_start", n: int = 12) -> DataFrame:
    return df.select(date).distinct().orderBy(F.desc(date)).limit(n)


def union_results(results: Mapping[str, DataFrame], name: str = "model") -> DataFrame:
    """All result tables in one, tagged by name; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in results.items()])


def missing_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids of a that b lacks."""
    return a.select(key).subtract(b.select(key))


def shared_dates(a: DataFrame, b: DataFrame, date: str) -> DataFrame:
    return a.select(date).intersect(b.select(date))
