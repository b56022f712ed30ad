"""Lags, gap filling, calendars, splits and bins of weekly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import exact_quantiles

from ..functions.dates import week_number


def lags(df: DataFrame, column: str, steps: Sequence[int] = (1, 4, 12), key: str = "nta_id", order: str = "week_start", mode: str = "rows") -> DataFrame:
    """Adds ``<column>_lag_<n>w`` for each n: the n-th row before ("rows"), or the row n weeks before if there is one ("calendar")."""
    if mode == "rows":
        w = Window.partitionBy(key).orderBy(order)
        return df.withColumns({f"{column}_lag_{n}w": F.lag(column, n).over(w) for n in steps})
    if mode != "calendar":
        raise ValueError(f"mode is 'rows' or 'calendar', not {mode!r}")
    w = Window.partitionBy(key).orderBy(week_number(F.col(order)))
    return df.withColumns({f"{column}_lag_{n}w": F.max(column).over(w.rangeBetween(-n, -n)) for n in steps})


def fill_series(df: DataFrame, columns: Sequence[str], key: str = "nta_id", order: str = "week_start") -> DataFrame:
    """Each series' gaps take the value before, else the value after, else 0."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after), F.lit(0))
    return df.withColumns({c: fill(c) for c in columns})


def regularize(df: DataFrame, key: str = "nta_id", week: str = "week_start") -> DataFrame:
    """A row for every week from each series' first to its last; numbers of added rows are 0, other columns null."""
    span = df.groupBy(key).agg(F.min(week).alias("_a"), F.max(week).alias("_b"))
    weeks = span.select(key, F.explode(F.sequence("_a", "_b", F.expr("interval 7 days"))).alias(week))
    out = weeks.join(df, [key, week], "left")
    numeric = [c for c, t in df.dtypes if c not in (key, week) and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    return out.fillna(0, subset=numeric).select(*df.columns) if numeric else out.select(*df.columns)


def min_length(df: DataFrame, key: str = "nta_id", n: int = 52) -> DataFrame:
    """Series of at least n rows."""
    long = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return df.join(long.select(key), key, "left_semi")


def static_last(df: DataFrame, columns: Sequence[str], key: str = "nta_id", order: str = "week_start") -> DataFrame:
    """Each series' latest values of some columns."""
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def tail_split(df: DataFrame, key: str = "nta_id", order: str = "week_start", n: int = 12) -> DataFrame:
    """Adds role: "test" for each series' last n rows, "train" before; series of n rows or fewer go."""
    w = Window.partitionBy(key)
    out = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_back", F.row_number().over(w.orderBy(F.desc(order))))
    return out.where(F.col("_n") > n).withColumn("role", F.when(F.col("_back") <= n, "test").otherwise("train")).drop("_n", "_back")


def quantile_bins(df: DataFrame, column: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """Bins 0, 1, ... between exact quantiles; equal edges are merged, equal values share a bin, the least value is in the first."""
    edges = exact_quantiles(df, column, [i / bins for i in range(bins + 1)], "_edges").withColumn("_edges", F.array_distinct("_edges"))
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    place = F.size(F.filter(inner, lambda e: e < F.col(column)))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(column).isNotNull(), place)).drop("_edges")  # one row


def extend_known(df: DataFrame, key: str = "nta_id", week: str = "week_start", n: int = 12) -> DataFrame:
    """Each series' last row repeated for the n weeks after it."""
    rest = [c for c in df.columns if c not in (key, week)]
    last = df.groupBy(key).agg(F.max_by(F.struct(week, *rest), week).alias("_r"))
    step = last.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return step.select(key, F.date_add(F.col(f"_r.{week}"), 7 * F.col("_i")).alias(week), *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def flat_forecast(scores: DataFrame, n: int = 12, band: float = 0.05, key: str = "nta_id", week: str = "week_start", score: str = "score") -> DataFrame:
    """The score itself for n weeks ahead, with a fixed band, clipped to 0..1 and flagged as a stub."""
    clip = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 6)
    s = F.col(score)
    rows = scores.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select(
        key, F.date_add(F.col(week), 7 * F.col("step")).alias("forecast_week"), clip(s - band).alias("ci_low"), clip(s).alias("score"), clip(s + band).alias("ci_high"), F.lit(True).alias("is_stub")
    )


def series_bundle(panel: DataFrame, target: str, past: Sequence[str], future: Sequence[str], static: Sequence[str], key: str = "nta_id", week: str = "week_start") -> DataFrame:
    """One row an area: arrays in week order of the target and its past and future covariates, and the latest static ones.

    A series has one row a week, so an area's array is as long as its history.
    """
    order = F.array_sort(F.collect_list(F.struct(week, *dict.fromkeys([target, *past, *future]))))
    rows = panel.groupBy(key).agg(order.alias("_s"), *[F.max_by(c, week).alias(c) for c in static])
    pick = lambda c: F.transform("_s", lambda r: r[c])
    return rows.select(
        key, pick(week).alias("weeks"), pick(target).alias("target"),
        F.struct(*[pick(c).alias(c) for c in past]).alias("past"), F.struct(*[pick(c).alias(c) for c in future]).alias("future"), F.struct(*static).alias("static"),
    )


def relative_share(df: DataFrame, key: str, value: str, out: str = "share_pct") -> DataFrame:
    """Absolute value as a rounded percent of the key's largest."""
    top = F.max(F.abs(value)).over(Window.partitionBy(key))
    return df.withColumn(out, F.coalesce(F.round(100 * F.abs(value) / F.nullif(top.cast("double"), F.lit(0.0))), F.lit(0.0)).cast("int"))


def feature_matrix(panel: DataFrame, features: Sequence[str], key: str = "nta_id", week: str = "week_start", label: str | None = None, vector_prefix: str = "vec_") -> DataFrame:
    """Key, week, borough code source, features as doubles (booleans as 0 and 1), and any vector columns there are."""
    kinds = dict(panel.dtypes)
    vectors = [c for c in panel.columns if c.startswith(vector_prefix) and c not in features]

    def number(c: str) -> Column:
        if c not in kinds:
            return F.lit(None).cast("double").alias(c)
        return (F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).cast("double").alias(c)

    out = panel.select(key, week, F.substring(F.col(key).cast("string"), 1, 2).alias("borough"), *[number(c) for c in features if c != "borough"], *vectors, *([label] if label else []))
    return out.sort(week, key)


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Nulls of the columns replaced; columns that are missing are created."""
    df = df.withColumns({c: F.lit(value) for c in columns if c not in df.columns})
    return df.fillna(value, subset=list(columns))
