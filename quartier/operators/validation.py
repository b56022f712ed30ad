"""Time splits without leaks, and metrics of binary scores."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import running_sum


def holdout_split(df: DataFrame, date: str = "week_start", weeks: int = 12, by: str = "date") -> DataFrame:
    """Adds role: "test" for the last weeks, counted back from the last date ("date") or in weeks that occur ("distinct_weeks")."""
    if by == "date":
        cut = df.agg(F.date_sub(F.max(date), 7 * weeks).alias("_cut"))
    elif by == "distinct_weeks":
        cut = df.select(date).distinct().orderBy(F.desc(date)).limit(weeks).agg(F.date_sub(F.min(date), 1).alias("_cut"))
    else:
        raise ValueError(f"by is 'date' or 'distinct_weeks', not {by!r}")
    out = df.crossJoin(F.broadcast(cut))  # one row
    return out.withColumn("role", F.when(F.col(date) > F.col("_cut"), "test").otherwise("train")).drop("_cut")


def fold_table(first: dt.date, last: dt.date, weeks: int, n: int = 5, gap_days: int = 28, val_weeks: int = 4) -> list[tuple[int, dt.date, dt.date, dt.date]]:
    """(fold, last training date, first and last validation date) of expanding windows that end at the last date."""
    if gap_days < 1:
        raise ValueError(f"gap_days must be at least 1, not {gap_days}")
    if weeks <= n * val_weeks + gap_days // 7 + 4:
        raise ValueError(f"Not enough weeks: {n} folds of {val_weeks} weeks, {gap_days} days apart, don't go into {weeks}")
    out = []
    for i in range(n):
        val_end = last - dt.timedelta(weeks=val_weeks * (n - 1 - i))
        val_start = val_end - dt.timedelta(weeks=val_weeks - 1)
        train_end = val_start - dt.timedelta(days=gap_days)
        if train_end > first:
            out.append((i, train_end, val_start, val_end))
    return out


def expanding_folds(df: DataFrame, date: str = "week_start", n: int = 5, gap_days: int = 28, val_weeks: int = 4) -> DataFrame:
    """Rows once for each fold that they train or validate, with fold and role. The extent of the dates is read first."""
    first, last, weeks = df.agg(F.min(date).cast("date"), F.max(date).cast("date"), F.count_distinct(date)).first()
    if first is None:
        raise ValueError("Not enough weeks (0)")
    folds = fold_table(first, last, weeks, n, gap_days, val_weeks)
    table = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, t, a, b in folds])
    day = F.col(date).cast("date")
    role = lambda f: F.when(day <= f["t"], "train").when(day.between(f["a"], f["b"]), "val")
    roles = F.filter(F.transform(table, lambda f: F.struct(f["fold"].alias("fold"), role(f).alias("role"))), lambda f: f["role"].isNotNull())
    return df.withColumn("_f", F.explode(roles)).select(*df.columns, "_f.fold", "_f.role")


def leak_report(folds: DataFrame, date: str = "week_start", gap_days: int = 28) -> DataFrame:
    """(fold, train_end, val_start, train_rows, ok): whether a fold trains before it validates, with the gap, and on more rows than the fold before."""
    day = F.col(date).cast("date")
    rows = folds.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", day)).alias("train_end"), F.min(F.when(F.col("role") == "val", day)).alias("val_start"),
        F.count_if(F.col("role") == "train").alias("train_rows"),
    )
    before = F.lag("train_rows").over(Window.orderBy("fold"))  # a row a fold
    grows = before.isNull() | (F.col("train_rows") > before)
    ok = F.coalesce(F.datediff("val_start", "train_end") >= gap_days, F.lit(False)) & grows
    return rows.withColumn("ok", ok)


def assert_no_leak(folds: DataFrame, date: str = "week_start", gap_days: int = 28) -> None:
    """ValueError unless every fold trains before it validates, with the gap, and training grows from fold to fold."""
    bad = leak_report(folds, date, gap_days).where("NOT ok").orderBy("fold").collect()  # a row a fold
    if bad:
        raise ValueError(f"fold {bad[0].fold} leaks or does not grow: it trains to {bad[0].train_end} on {bad[0].train_rows} rows and validates from {bad[0].val_start}")


def _by_score(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Distinct scores with their rows and positives, so that ties count as one and the data shrink before any order."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("long")).alias("_pos"))


def average_precision(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over falling scores of the gain in recall times the precision there; 0 without positives."""
    s = running_sum(_by_score(df, y, p, by), p, "_n", "_cum_n", by, descending=True)
    s = running_sum(s, p, "_pos", "_cum_pos", by, descending=True)
    total = F.sum("_pos")
    value = F.coalesce(F.sum(F.col("_pos") * F.col("_cum_pos") / F.col("_cum_n")) / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0))
    return s.groupBy(*by).agg(value.alias("average_precision"))


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive scores above a negative, ties counting half; null with one class only."""
    s = running_sum(_by_score(df, y, p, by), p, "_n", "_upto", by)
    pos, n = F.sum("_pos").cast("double"), F.sum("_n").cast("double")
    ranks = F.sum(F.col("_pos") * (F.col("_upto") - (F.col("_n") - 1) / 2))
    return s.groupBy(*by).agg(((ranks - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0.0))).alias("roc_auc"))


def brier(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y).cast("double"), 2)).alias("brier"))


def top_decile_lift(df: DataFrame, y: str, p: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of positives among the top tenth (one row at least) over their share among all; 0 without positives. Ties go by key."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    s = running_sum(_by_score(rows, y, p, by), p, "_n", "_upto", by, descending=True)
    totals = s.groupBy(*by).agg(F.sum("_n").alias("_all"), F.sum("_pos").alias("_all_pos"))
    s = s.join(totals, list(by)) if by else s.crossJoin(F.broadcast(totals))  # one row
    k = F.greatest(F.lit(1), F.floor(F.col("_all") / 10))
    s = s.withColumn("_k", k).withColumn("_take", F.least(F.col("_n"), F.greatest(F.col("_k") - (F.col("_upto") - F.col("_n")), F.lit(0))))
    whole = s.withColumn("_got", F.when(F.col("_take") == F.col("_n"), F.col("_pos")).otherwise(F.lit(0)))
    cut = s.where("_take > 0 AND _take < _n").select(*by, p, "_take")  # the one score at the edge of the tenth
    edge = rows.join(cut, [*by, p]).withColumn("_r", F.row_number().over(Window.partitionBy(*by, p).orderBy(key))).where("_r <= _take")
    got = whole.select(*by, "_got").unionByName(edge.select(*by, F.col(y).cast("long").alias("_got")))
    got = got.groupBy(*by).agg(F.sum("_got").alias("_top"))
    first = s.groupBy(*by).agg(F.first("_k").alias("_k"), F.first("_all").alias("_all"), F.first("_all_pos").alias("_all_pos"))
    both = got.join(first, list(by)) if by else got.crossJoin(F.broadcast(first))  # one row
    lift = (F.col("_top") / F.col("_k")) / F.nullif(F.col("_all_pos") / F.col("_all"), F.lit(0.0))
    return both.select(*by, F.coalesce(lift, F.lit(0.0)).alias("top_decile_lift"))


def calibration(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y, gap) of non-empty uniform bins; a score of 1 is in the last."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    out = df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def calibration_error(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean gap over non-empty bins."""
    return calibration(df, y, p, by, bins).groupBy(*by).agg(F.avg("gap").alias("calibration_error"))


def metric_bundle(df: DataFrame, y: str, p: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """All metrics, one row for each group, from one table of distinct scores with running counts.

    Rows are looked at again only where the edge of the top tenth falls inside a score that several rows share.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    s = running_sum(_by_score(rows, y, p, by), p, ["_n", "_pos"], ["_cn", "_cp"], by, descending=True)
    n, pos = F.sum("_n").cast("double"), F.sum("_pos").cast("double")
    score = F.col(p).cast("double")
    totals = s.groupBy(*by).agg(
        F.sum("_n").alias("_all"), F.sum("_pos").alias("_all_pos"),
        F.coalesce(F.sum(F.col("_pos") * F.col("_cp") / F.col("_cn")) / F.nullif(pos, F.lit(0.0)), F.lit(0.0)).alias("average_precision"),
        # ranks from below: what stands above a score is counted from the top
        ((pos * n - F.sum(F.col("_pos") * (F.col("_cn") - (F.col("_n") + 1) / 2)) - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0.0))).alias("roc_auc"),
        (F.sum(F.col("_pos") * (1 - score) * (1 - score) + (F.col("_n") - F.col("_pos")) * score * score) / n).alias("brier"),
    )
    bins = F.least(F.floor(score * 10), F.lit(9)).cast("int")
    binned = s.groupBy(*by, bins.alias("_bin")).agg((F.sum(F.col("_n") * score) / n).alias("_p"), (pos / n).alias("_y"))
    error = binned.groupBy(*by).agg(F.avg(F.abs(F.col("_p") - F.col("_y"))).alias("calibration_error"))
    put = lambda a, b: a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))  # noqa: E731  one row where there are no groups
    k = F.greatest(F.lit(1), F.floor(F.col("_all") / 10))
    near = put(s, totals.select(*by, "_all")).withColumn("_take", F.least(F.col("_n"), F.greatest(k - (F.col("_cn") - F.col("_n")), F.lit(0)))).where("_take > 0")
    edge = near.where("_take < _n AND _pos > 0 AND _pos < _n").select(*by, p, "_take")
    inside = rows.join(edge, [*by, p]).withColumn("_r", F.row_number().over(Window.partitionBy(*by, p).orderBy(key))).where("_r <= _take")
    got = near.where("_take = _n OR _pos = 0 OR _pos = _n").select(*by, F.when(F.col("_pos") == 0, F.lit(0)).when(F.col("_pos") == F.col("_n"), F.col("_take")).otherwise(F.col("_pos")).alias("_got"))
    got = got.unionByName(inside.select(*by, F.col(y).cast("long").alias("_got"))).groupBy(*by).agg(F.sum("_got").alias("_top"))
    lift = (F.coalesce("_top", F.lit(0)) / k) / F.nullif(F.col("_all_pos") / F.col("_all"), F.lit(0.0))
    out = put(put(totals, error), got)
    return out.select(*by, "average_precision", "roc_auc", "brier", F.coalesce(lift, F.lit(0.0)).alias("top_decile_lift"), "calibration_error")


def score_column(x: Column) -> Column:
    """A score in 0..1 from any non-negative number."""
    return x / (x + 1)
