"""Probabilistic forecasts of many series, their back-tests and their storage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import flat_forecast, tail_split

QUANTILES = (0.1, 0.5, 0.9)


def forecast(series: DataFrame, key: str, date: str, value: str, horizon: int = 12, context: int = 52, quantiles: Sequence[float] = QUANTILES, season: int = 52, clip: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(key, step, forecast_week, p10, p50, p90): seasonal-naive forecasts with empirical residual quantiles.

    The level is the value one season before where the series reaches back that far, else the mean of the context. Residuals are those of a
    one-step naive forecast over the context. Series shorter than the context give no rows.
    """
    back = Window.partitionBy(key).orderBy(F.desc(date))
    rows = series.select(key, date, F.col(value).cast("double").alias("_v")).withColumn("_back", F.row_number().over(back))
    rows = rows.withColumn("_prev", F.lag("_v").over(Window.partitionBy(key).orderBy(date)))
    recent = rows.where(F.col("_back") <= context)
    fit = recent.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.max(date).alias("_last"), F.avg("_v").alias("_mean"),
        F.percentile(F.col("_v") - F.col("_prev"), F.array(*[F.lit(q) for q in quantiles])).alias("_res"),
    ).where(F.col("_n") >= context)
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("forecast_week", F.date_add("_last", 7 * F.col("step")))
    before = rows.select(key, F.col(date).alias("_at"), F.col("_v").alias("_season"))
    out = steps.withColumn("_at", F.date_sub("forecast_week", 7 * season)).join(before, [key, "_at"], "left")
    level = F.coalesce("_season", "_mean")
    bound = lambda c: F.round(F.least(F.greatest(c, F.lit(clip[0])), F.lit(clip[1])), 6)
    names = [f"p{round(q * 100)}" for q in quantiles]
    return out.select(key, "step", "forecast_week", *[bound(level + F.coalesce(F.col("_res")[i], F.lit(0.0))).alias(n) for i, n in enumerate(names)])


def _line(series: DataFrame, key: str, date: str, value: str, horizon: int, recent: int, season: int) -> DataFrame:
    """Each row with its errors as seen from 1, 2, ... weeks before, ``_p1``, ... of plain and ``_s1``, ... of seasonal forecasts, and with the forecasts that start from it.

    A plain forecast is the mean of the last ``recent`` rows at its origin; a seasonal one adds what the week one season before the target was above
    that mean one season before the origin. Every step is a range frame over one window, so the rows are shuffled and sorted once.
    """
    if season < horizon:
        raise ValueError("the season must reach over the horizon, so that a forecast looks at no week after its origin")
    line = Window.partitionBy(key).orderBy("_day")

    def at(column: str, weeks: int) -> Column:
        return F.max(column).over(line.rangeBetween(7 * weeks, 7 * weeks))

    rows = series.select(key, date, F.col(value).cast("double").alias("_v"), F.unix_date(F.col(date).cast("date")).alias("_day"))
    rows = rows.withColumn("_level", F.avg("_v").over(line.rowsBetween(1 - recent, 0)))
    steps = range(1, horizon + 1)
    plain = {f"_p{i}": F.col("_v") - at("_level", -i) for i in steps}
    seasonal = {f"_s{i}": F.col("_v") - at("_level", -i) - (at("_v", -season) - at("_level", -i - season)) for i in steps}
    ahead = F.array(*[F.col("_level") + (at("_v", i - season) - at("_level", -season)) for i in steps])
    return rows.withColumns(plain | seasonal).withColumn("_ahead", ahead)


def forecast_by_step(series: DataFrame, key: str, date: str, value: str, horizon: int = 12, recent: int = 4, season: int = 52, origins: int = 104, least: int = 8, quantiles: Sequence[float] = QUANTILES, clip: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(key, step, forecast_week, p10, p50, p90, n_errors): each step's band comes from the errors of that step in forecasts from earlier origins.

    The origins roll over the history: every one of the last ``origins`` rows is compared with the forecasts made 1 to ``horizon`` weeks before it, so
    the band is as wide as forecasts of that step were wrong. A step is forecast by season where its target has a week one season before and at least ``least`` errors of
    seasonal forecasts are known, else plainly with the errors of plain forecasts; with fewer than ``least`` of these too (there may be no such pairs of
    weeks) it takes the band of the step before. Series without that many at step one give no rows. Null values are no errors; a (key, date) is one row.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_day")))
    rows = _line(series, key, date, value, horizon, recent, season).withColumn("_back", back)
    steps = range(1, horizon + 1)
    wanted = F.array(*[F.lit(q) for q in quantiles])
    tried = {f"{kind}{i}": F.when(F.col("_back") <= origins, F.col(f"_{kind}{i}")) for i in steps for kind in "ps"}
    fit = rows.groupBy(key).agg(
        F.max(date).alias("_last"), F.max_by("_level", "_day").alias("_level"), F.max_by("_ahead", "_day").alias("_ahead"),
        *[F.percentile(e, wanted).alias(f"_q{name}") for name, e in tried.items()], *[F.count(e).alias(f"_n{name}") for name, e in tried.items()],
    ).where(F.col("_np1") >= least)
    bands, before = [], F.lit(None)
    for i in steps:
        made = lambda level, kind: F.struct(level.alias("level"), F.col(f"_q{kind}{i}").alias("q"), F.col(f"_n{kind}{i}").alias("n"))  # noqa: B023, E731
        ahead = F.col("_ahead")[i - 1]
        found = F.when((F.col(f"_ns{i}") >= least) & ahead.isNotNull(), made(ahead, "s")).when(F.col(f"_np{i}") >= least, made(F.col("_level"), "p"))
        fit = fit.withColumn(f"_b{i}", found.otherwise(before))
        before = F.struct(F.col("_level").alias("level"), F.col(f"_b{i}.q"), F.col(f"_b{i}.n"))
        bands.append(F.struct(F.lit(i).alias("step"), f"_b{i}.level", f"_b{i}.q", f"_b{i}.n"))
    out = fit.select(key, "_last", F.explode(F.array(*bands)).alias("s")).select(key, "_last", "s.*")
    bound = lambda c: F.round(F.least(F.greatest(c, F.lit(clip[0])), F.lit(clip[1])), 6)
    named = [bound(F.col("level") + F.col("q")[j]).alias(f"p{round(q * 100)}") for j, q in enumerate(quantiles)]
    return out.select(key, "step", F.date_add("_last", 7 * F.col("step")).alias("forecast_week"), *named, F.col("n").alias("n_errors"))


def backtest_bands(series: DataFrame, key: str, date: str, value: str, horizon: int = 12, **settings) -> DataFrame:
    """(step, n, covered, width, mae): forecasts of every series without its last ``horizon`` rows, held against those rows.

    covered is the share of values from p10 to p90, which a good band holds in eight of ten cases.
    """
    parts = tail_split(series, key, date, horizon)
    fc = forecast_by_step(parts.where("role = 'train'"), key, date, value, horizon, **settings)
    both = fc.join(parts.where("role = 'test'").select(key, F.col(date).alias("forecast_week"), F.col(value).cast("double").alias("_v")), [key, "forecast_week"])
    both = both.where(F.col("_v").isNotNull())
    return both.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_v").between(F.col("p10"), F.col("p90")).cast("double")).alias("covered"),
        F.avg(F.col("p90") - F.col("p10")).alias("width"), F.avg(F.abs(F.col("p50") - F.col("_v"))).alias("mae"),
    )


def forecast_with(series: DataFrame, key: str, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A caller's own forecaster, given one series at a time; a series is as long as its history."""
    return series.groupBy(key).applyInPandas(model, schema)


def summarize_draws(draws: DataFrame, by: Sequence[str], value: str = "value", quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Quantiles of simulated values."""
    q = draws.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(x) for x in quantiles])).alias("_q"))
    return q.select(*by, *[F.col("_q")[i].alias(f"p{round(x * 100)}") for i, x in enumerate(quantiles)])


def backtest_mae(fc: DataFrame, actual: DataFrame, key: str, week: str = "forecast_week", value: str = "actual") -> DataFrame:
    """(mae, n) of the median forecast against what came."""
    both = fc.join(actual.select(key, week, value), [key, week])
    return both.agg(F.avg(F.abs(F.col("p50") - F.col(value))).alias("mae"), F.count(F.lit(1)).alias("n"))


def count_to_prob(fc: DataFrame, key: str) -> DataFrame:
    """(key, score): a series' mean median forecast over the largest of all, clipped."""
    means = fc.groupBy(key).agg(F.avg("p50").alias("_m"))
    top = means.agg(F.max("_m").alias("_top"))
    score = F.coalesce(F.col("_m") / F.nullif("_top", F.lit(0.0)), F.lit(0.0))
    return means.crossJoin(F.broadcast(top)).select(key, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))  # one row


def materialize_forecast(fc: DataFrame, as_of, version: str, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The forecast keyed for storage, and one row counting the wanted series and those without a forecast."""
    rows = fc.withColumns({"as_of": F.lit(as_of).cast("date"), "model_version": F.lit(version)})
    failed = wanted.select(key).distinct().join(fc.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("failed"))
    return rows, wanted.agg(F.count_distinct(key).alias("series")).crossJoin(failed)


def forecast_for(requests: DataFrame, fc: DataFrame, key: str = "nta_id", week: str = "week_start", n: int = 12) -> DataFrame:
    """(key, forecast_week, ci_low, score, ci_high, is_stub): each area's latest forecast, or the flat one for areas without.

    requests: (key, week, score), one row an area.
    """
    newest = fc.groupBy(key).agg(F.max("as_of").alias("as_of"))
    rows = fc.join(newest, [key, "as_of"]).join(requests.select(key), key, "left_semi")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("forecast_week"))
    found = rows.withColumn("_r", rank).where(F.col("_r") <= n).select(
        key, "forecast_week", F.round("p10", 6).alias("ci_low"), F.round("p50", 6).alias("score"), F.round("p90", 6).alias("ci_high"), F.lit(False).alias("is_stub")
    )
    stub = flat_forecast(requests.join(fc.select(key), key, "left_anti"), n, key=key, week=week)
    return found.unionByName(stub)
