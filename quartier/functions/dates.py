"""Weeks, quarters, calendars and policy periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Policy periods (name, first day, last day or none); a period without a first day never holds.
REGIMES = (
    ("regime_covid", "2020-03-01", "2020-06-30"),
    ("regime_8pm_setout", "2023-04-01", None),
    ("regime_commercial_containerization", "2024-03-01", None),
    ("regime_residential_containerization", "2024-11-01", None),
    ("regime_rmz_active", None, None),
)


def week_start(date: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_trunc("week", date).cast("date")


def current_week() -> Column:
    return week_start(F.current_date())


def week_number(date: Column) -> Column:
    """Whole weeks since Monday, 5 January 1970."""
    return F.floor(F.datediff(date, F.lit("1970-01-05").cast("date")) / 7).cast("int")


def safe_date(text: Column) -> Column:
    """The date in the first ten characters, null if they hold none."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def quarters_between(spark: SparkSession, start: dt.date, end: dt.date, today: dt.date | None = None) -> DataFrame:
    """(quarter, first_day, last_day) of the calendar quarters from start's to end's; the last is cut at today."""
    today = today or dt.date.today()
    first = F.trunc(F.lit(start), "quarter")
    days = spark.range(1).select(F.explode(F.sequence(first, F.lit(min(end, today)), F.expr("interval 3 months"))).alias("first_day"))
    label = F.format_string("%d-Q%d", F.year("first_day"), F.quarter("first_day"))
    return days.select(label.alias("quarter"), "first_day", F.least(F.last_day(F.add_months("first_day", 2)), F.lit(today)).alias("last_day"))


def week_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """week_start: the Mondays from start's week to end's."""
    steps = F.sequence(week_start(F.lit(start)), F.lit(end), F.expr("interval 7 days"))
    return spark.range(1).select(F.explode(steps).alias("week_start"))


def regime_flags(df: DataFrame, date: str = "week_start", regimes=REGIMES) -> DataFrame:
    """One boolean column for each policy period."""
    flags = {}
    for name, first, last in regimes:
        if first is None:
            flags[name] = F.lit(False)
        elif last is None:
            flags[name] = F.col(date) >= F.lit(first).cast("date")
        else:
            flags[name] = F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return df.withColumns(flags)
