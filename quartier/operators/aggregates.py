"""Weekly counts, profiles, percentiles, correlations and usage figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import week_start


def weekly_counts(df: DataFrame, key: str, date: str, conditions: Mapping[str, Column], until: Column | None = None, total: str = "total_count") -> DataFrame:
    """Rows by key and week, and how many of them meet each condition (none: 0); dates after ``until`` are left out."""
    rows = df.where(F.col(key).isNotNull() & F.col(date).isNotNull())
    if until is not None:
        rows = rows.where(F.col(date) <= until)
    return rows.groupBy(key, week_start(F.col(date)).alias("week_start")).agg(
        F.count(F.lit(1)).alias(total), *[F.count_if(c).alias(name) for name, c in conditions.items()]
    )


def weekly_weather(df: DataFrame, date: str = "date", means: Sequence[str] = ("tavg_c",), sums: Sequence[str] = ("prcp_mm", "hdd", "cdd"), prefix: str = "weather_") -> DataFrame:
    """Weekly means and sums, rounded to four places."""
    cols = [F.round(F.avg(c), 4).alias(prefix + c) for c in means] + [F.round(F.sum(c), 4).alias(prefix + c) for c in sums]
    return df.groupBy(week_start(F.col(date)).alias("week_start")).agg(*cols)


def static_profile(lots: DataFrame, key: str, sums: Sequence[str] = (), medians: Sequence[str] = (), shares: Mapping[str, tuple[str, Sequence[str]]] | None = None) -> DataFrame:
    """By key: sums, exact medians rounded half-even, and shares of rows whose column holds one of some codes."""
    cols = [F.sum(c).alias(f"{c}_total") for c in sums]
    cols += [F.rint(F.percentile(F.col(c).cast("double"), F.lit(0.5))).cast("int").alias(f"{c}_median") for c in medians]
    cols += [F.round(F.avg(F.coalesce(F.col(c).isin(*codes), F.lit(False)).cast("int")), 4).alias(name) for name, (c, codes) in (shares or {}).items()]
    return lots.where(F.col(key).isNotNull()).groupBy(key).agg(*cols)


def area_profile(panel: DataFrame, key: str, mean: str, total: str, min_total: int = 10) -> DataFrame:
    """Mean, sum and number of weeks by area, for areas with a large enough sum."""
    return panel.groupBy(key).agg(F.avg(mean).alias(f"{mean}_mean"), F.sum(total).alias(f"{total}_sum"), F.count(F.lit(1)).alias("weeks")).where(F.col(f"{total}_sum") >= min_total)


def min_support(df: DataFrame, count_col: str, n: int) -> DataFrame:
    return df.where(F.col(count_col) >= n)


def profile(df: DataFrame | None, name: str, date: str | None = None, required: Sequence[str] = (), key: Sequence[str] = (), spark: SparkSession | None = None) -> DataFrame:
    """One row: table, rows, distinct keys, first and last date, and percent of nulls by required column; rows = -1 without a table."""
    if df is None:
        return (spark or SparkSession.active()).createDataFrame(
            [(name, -1, None, None, None, {})], "table string, rows long, keys long, first_date date, last_date date, null_pct map<string,double>"
        )
    n = F.count(F.lit(1))
    nulls = [x for c in required for x in (F.lit(c), F.round(100.0 * F.count_if(F.col(c).isNull()) / F.greatest(n, F.lit(1)), 2))]
    return df.agg(
        F.lit(name).alias("table"), n.alias("rows"),
        (F.count_distinct(*[F.col(c) for c in key]) if key else F.lit(None).cast("long")).alias("keys"),
        (F.min(date).cast("date") if date else F.lit(None).cast("date")).alias("first_date"),
        (F.max(date).cast("date") if date else F.lit(None).cast("date")).alias("last_date"),
        (F.create_map(*nulls) if nulls else F.create_map().cast("map<string,double>")).alias("null_pct"),
    )


def unmatched_report(sources: Mapping[str, DataFrame], raw: str, normalised: str) -> DataFrame:
    """(source, total, unmatched, pct): rows whose raw key could not be normalised. Reports of several batches add up by source."""
    each = [df.select(F.lit(s).alias("source"), (F.col(raw).isNotNull() & F.col(normalised).isNull()).alias("bad")) for s, df in sources.items()]
    sums = reduce(DataFrame.unionByName, each).groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if("bad").alias("unmatched"))
    return merge_reports(sums)


def merge_reports(*reports: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [r.select("source", "total", "unmatched") for r in reports])
    sums = rows.groupBy("source").agg(F.sum("total").alias("total"), F.sum("unmatched").alias("unmatched"))
    return sums.withColumn("pct", F.when(F.col("total") > 0, F.round(100.0 * F.col("unmatched") / F.col("total"), 2)).otherwise(F.lit(0.0)))


def decile_thresholds(df: DataFrame, score: str, scope: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """(scope, thresholds): P10 to P100 with linear interpolation, 0.1 to 1.0 where there are no scores.

    ``exact`` counts distinct scores, over all rows by running counts; without it a sketch of fixed size answers.
    """
    tenths = [i / 10 for i in range(1, 11)]
    if exact and not scope:
        out = exact_quantiles(df, score, tenths, "thresholds")
    else:
        pick = F.percentile(score, F.array(*[F.lit(t) for t in tenths])) if exact else F.approx_percentile(score, tenths, F.lit(100_000))
        out = df.groupBy(*scope).agg(pick.alias("thresholds"))
    return out.withColumn("thresholds", F.coalesce("thresholds", F.array(*[F.lit(t) for t in tenths])))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], out: str = "quantiles") -> DataFrame:
    """One row with the column's exact quantiles, linearly interpolated; null without values.

    Running counts of distinct values say which of them hold the places that are asked for, so that no task takes all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    s = running_sum(counts, "_v", "_n", "_upto").crossJoin(F.broadcast(total))  # one row
    at = [F.lit(q) * (F.col("_all") - 1) for q in shares]
    places = F.array_distinct(F.array(*[f(h).cast("long") for h in at for f in (F.floor, F.ceil)]))
    held = s.withColumn("_i", F.explode(F.filter(places, lambda i: (i < F.col("_upto")) & (i >= F.col("_upto") - F.col("_n")))))
    one = held.agg(F.map_from_entries(F.collect_list(F.struct("_i", F.col("_v").cast("double")))).alias("_m"), F.first("_all").alias("_all"))  # two places a share at most
    value = lambda h, f: F.try_element_at("_m", f(h).cast("long"))
    picked = F.array(*[value(h, F.floor) + (value(h, F.ceil) - value(h, F.floor)) * (h - F.floor(h)) for h in at])
    return one.select(F.when(F.col("_all").isNotNull(), picked).alias(out))


def assign_decile(df: DataFrame, score: str, thresholds: DataFrame, rule: str = "ceil", scope: Sequence[str] = (), out: str = "decile") -> DataFrame:
    """Deciles 1 to 10: "floor" counts the thresholds that the score reaches, at least 1; "ceil" takes the first threshold that reaches the score."""
    joined = df.join(thresholds, list(scope)) if scope else df.crossJoin(F.broadcast(thresholds))  # one row
    if rule == "floor":
        decile = F.greatest(F.size(F.filter("thresholds", lambda t: t <= F.col(score))), F.lit(1))
    elif rule == "ceil":
        decile = F.least(F.size(F.filter("thresholds", lambda t: t < F.col(score))) + 1, F.lit(10))
    else:
        raise ValueError(f"rule is 'floor' or 'ceil', not {rule!r}")
    return joined.withColumn(out, F.when(F.col(score).isNotNull(), decile.cast("int"))).drop("thresholds")


def decile_histogram(df: DataFrame, decile: str = "decile", high: int = 8) -> DataFrame:
    """(decile, n, high_risk) for all of 1 to 10; high_risk counts the rows of the high deciles over all."""
    counts = df.groupBy(F.col(decile).cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("n"))
    all_ = df.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("decile"))
    out = all_.join(counts, "decile", "left").select("decile", F.coalesce("n", F.lit(0)).alias("n"))
    top = counts.where(F.col("decile") >= high).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("high_risk"))
    return out.crossJoin(F.broadcast(top))  # one row


def average_ranks(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, rank of the column's value among all rows, ties at their mean), by counts of distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, column, "_n", "_upto").withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2)
    return df.select(key, column).join(ranked.select(column, "_rank"), column).select(key, F.col("_rank").alias(column))


def running_sum(df: DataFrame, order: str, value: str | Sequence[str], out: str | Sequence[str], by: Sequence[str] = (), descending: bool = False, parts: int = 64) -> DataFrame:
    """Adds the sum of ``value`` up to each row in the order of a distinct numeric column; or those of several columns.

    The values' range is cut into ``parts``; rows add up inside a part, and the parts' totals, a table of at most ``parts`` rows a group,
    add up over parts, so that no task takes all rows.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    cuts = df.agg(F.approx_percentile(F.col(order).cast("double"), [i / parts for i in range(1, parts)], F.lit(1000)).alias("_cuts"))
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")  # one row
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_start_{v}") for v in values])
    inside = Window.partitionBy(*by, "_part").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({o: F.sum(v).over(inside) for v, o in zip(values, outs, strict=True)}).join(starts, [*by, "_part"])
    joined = joined.withColumns({o: F.col(o) + F.col(f"_start_{v}") for v, o in zip(values, outs, strict=True)})
    return joined.drop("_part", *[f"_start_{v}" for v in values])


def spearman_matrix(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """(x, y, rho) for all pairs of columns, over rows that have them all."""
    rows = df.dropna(subset=list(cols)).select(key, *cols)
    ranks = reduce(lambda a, b: a.join(b, key), [average_ranks(rows, c, key) for c in cols])
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i + 1 :]]
    one = ranks.agg(*[F.round(F.corr(x, y), 6).alias(f"{x}|{y}") for x, y in pairs])
    entries = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"`{x}|{y}`").alias("rho")) for x, y in pairs])
    return one.select(F.explode(entries).alias("e")).select("e.x", "e.y", "e.rho")


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    fit = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n")]
    return df.groupBy(*by).agg(*fit) if by else df.agg(*fit)


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles by group, and whiskers: the furthest values within 1.5 interquartile ranges of them."""
    q = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    q = q.select(by, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, by).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    ends = inside.groupBy(by).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return q.join(ends, by)


#: Scene classes of usable pixels.
VALID_CLASSES = (4, 5, 6, 11)


def median_composite(pixels: DataFrame, valid_classes: Sequence[int] = VALID_CLASSES, max_cloud: float = 20.0, done: DataFrame | None = None) -> DataFrame:
    """Median over time of usable pixels for each (area, quarter, band, y, x); finished (area, quarter) pairs are left out."""
    use = pixels.where(F.col("scl").isin(*valid_classes) & (F.col("cloud") < max_cloud) & ~F.isnan("value") & F.col("value").isNotNull())
    if done is not None:
        use = use.join(done.select("area", "quarter"), ["area", "quarter"], "left_anti")
    return use.groupBy("area", "quarter", "band", "y", "x").agg(F.percentile("value", F.lit(0.5)).alias("value"), F.count(F.lit(1)).alias("n_obs"))


def band_zscore(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """(value - mean) / (std + 1e-6) by band, NaN to 0. stats has a row a band."""
    z = (F.col("value") - F.col("mean")) / (F.col("std") + F.lit(1e-6))
    joined = pixels.join(F.broadcast(stats.select("band", "mean", "std")), "band")
    return joined.withColumn("value", F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0))).drop("mean", "std").select(*pixels.columns)


def centre_crop(pixels: DataFrame, size: int, image: Sequence[str] = ("area", "quarter")) -> DataFrame:
    """The middle size x size pixels of each image, with y and x counted from 0."""
    edge = pixels.groupBy(*image).agg(F.floor((F.max("y") + 1 - size) / 2).alias("_y"), F.floor((F.max("x") + 1 - size) / 2).alias("_x"))
    edge = edge.withColumns({"_y": F.greatest("_y", F.lit(0)), "_x": F.greatest("_x", F.lit(0))})
    moved = pixels.join(edge, list(image)).withColumns({"y": F.col("y") - F.col("_y"), "x": F.col("x") - F.col("_x")})
    return moved.where(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1)).select(*pixels.columns)


def score_distribution(hits: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    return hits.groupBy(by).agg(F.min(score).alias("score_min"), F.percentile(score, F.lit(0.5)).alias("score_median"), F.max(score).alias("score_max"), F.count(F.lit(1)).alias("n"))


def mean_abs_contribution(contributions: DataFrame, n: int = 20) -> DataFrame:
    """(feature, mean_abs): the n features with the greatest mean absolute contribution, of (feature, contribution) rows."""
    means = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return means.orderBy(F.desc("mean_abs"), "feature").limit(n)


def cv_summary(folds: DataFrame, by: str = "model", metrics: Sequence[str] = ("average_precision",)) -> DataFrame:
    """Mean and population deviation of fold metrics."""
    return folds.groupBy(by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))], F.count(F.lit(1)).alias("folds"))


def prevalence(df: DataFrame, label: str, date: str | None = None) -> DataFrame:
    span = [F.min(date).alias("first"), F.max(date).alias("last")] if date else []
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("prevalence"), *span)


def usage_cost(spans: DataFrame, prices: DataFrame, daily_limit: float) -> DataFrame:
    """(day, model, calls, tokens_in, tokens_out, cost, over_limit): spending by day and model; the flag looks at the day as a whole.

    prices: (model, usd_in, usd_out) for a million tokens. Costs have six decimals and 22 digits before them, so a day's sum has room for any number of calls.
    """
    cost = (F.col("tokens_in") * F.coalesce("usd_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("usd_out", F.lit(0.0))) / 1e6
    rows = spans.join(prices, "model", "left").withColumns({"day": F.col("ts").cast("date"), "cost": cost})
    by_model = rows.groupBy("day", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").cast("decimal(28,6)").alias("cost")
    )
    days = by_model.groupBy("day").agg((F.sum("cost") > daily_limit).alias("over_limit"))
    return by_model.join(days, "day")


def eval_summary(items: DataFrame, thresholds: Mapping[str, float], by: str = "failure_mode", skipped: float = -1.0) -> DataFrame:
    """(group, metric, mean, n, skipped, passed) of each metric column, by failure mode and over all; -1 marks skipped items."""
    long = items.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in thresholds])).alias("e")).select(by, "e.metric", "e.v")
    both = long.select(F.col(by).alias("group"), "metric", "v").unionByName(long.select(F.lit("all").alias("group"), "metric", "v"))
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("metric"))
    return both.groupBy("group", "metric").agg(
        F.round(F.avg(F.nullif("v", F.lit(skipped))), 6).alias("mean"), F.count(F.nullif("v", F.lit(skipped))).alias("n"), F.count_if(F.col("v") == skipped).alias("skipped")
    ).withColumn("passed", F.col("mean") >= limit)


def prediction_coverage(predictions: DataFrame, areas: int, weeks: int, key: str = "nta_id", week: str = "week_start") -> DataFrame:
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("areas"), F.min(week).alias("first_week"), F.max(week).alias("last_week")
    ).withColumns({"expected": F.lit(areas * weeks).cast("long"), "coverage": F.round(F.col("rows") / F.lit(max(1, areas * weeks)), 6)})
