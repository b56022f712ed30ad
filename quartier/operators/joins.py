"""Lookups, panel assembly and other joins of tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import indicator, safe_rate
from ..functions.text import word_count


def attach_area(facts: DataFrame, lots: DataFrame, key: str = "bbl", area: str = "nta_id") -> DataFrame:
    """Facts with the area of their lot; facts without a lot, and lots without an area, go."""
    return facts.join(lots.where(F.col(area).isNotNull()).select(key, area), key)


def build_panel(labels: DataFrame, parts: Mapping[str, DataFrame], counts: Sequence[str] = (), key: str = "nta_id", week: str = "week_start", positive: str = "positive_count", total: str = "total_count") -> DataFrame:
    """The spine of labelled area-weeks with every part joined on those of (area, week) that it has.

    ``counts`` are the columns in which a missing row means none. The rate and its indicator come from the labels.
    All parts are summed to the join's grain beforehand, so a join never multiplies rows.
    """
    panel = labels.withColumns({"positive_rate": safe_rate(F.col(positive), F.col(total)), "positive_ind": indicator(F.col(positive))})
    for part in parts.values():
        panel = panel.join(part, [c for c in (key, week) if c in part.columns], "left")
    return panel.fillna(0, subset=list(counts)) if counts else panel


def asof_latest(requests: DataFrame, panel: DataFrame, key: str = "nta_id", week: str = "week_start", allow_future: bool = True) -> DataFrame:
    """For each request the row of its area and week, or else the area's latest (with allow_future=False: the latest until then).

    The panel is reduced to one row an area where only the latest counts, so no request meets all weeks of its area.
    """
    values = [c for c in panel.columns if c not in (key, week)]
    packed = panel.select(key, F.col(week).alias("_week"), F.struct(week, *values).alias("_row"))
    exact = requests.join(packed.withColumnRenamed("_week", week).withColumnRenamed("_row", "_exact"), [key, week], "left")
    if allow_future:
        latest = packed.groupBy(key).agg(F.max_by("_row", "_week").alias("_latest"))
        out = exact.join(latest, key, "left")
    else:
        asked = requests.select(key, F.col(week).alias("_week"), F.lit(None).cast(packed.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_ask")).distinct()
        line = packed.withColumn("_ask", F.lit(False)).unionByName(asked)
        upto = Window.partitionBy(key).orderBy("_week", "_ask").rowsBetween(Window.unboundedPreceding, 0)
        latest = line.withColumn("_latest", F.last("_row", ignorenulls=True).over(upto)).where("_ask").select(key, F.col("_week").alias(week), "_latest")
        out = exact.join(latest, [key, week], "left")
    row = F.coalesce("_exact", "_latest")
    return out.where(row.isNotNull()).select(*requests.columns, row[week].alias("row_week"), *[row[c].alias(c) for c in values], F.col("_exact").isNotNull().alias("is_exact"))


def latest_valid(df: DataFrame, key: Sequence[str], order: str, valid: Column) -> DataFrame:
    """The newest valid row of each key."""
    rest = [c for c in df.columns if c not in key]
    best = df.where(valid).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def cached_or_compute(cache: DataFrame, wanted: DataFrame, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached rows for the wanted keys, and computed ones for the keys that the cache lacks."""
    keys = list(keys)
    held = cache.join(wanted.select(*keys).distinct(), keys, "left_semi")
    missing = wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")
    return held.unionByName(compute(missing).select(*held.columns))


def enrich(scores: DataFrame, areas: DataFrame, key: str = "nta_id") -> DataFrame:
    """Scores with their areas' columns, null where the area is unknown."""
    return scores.join(areas, key, "left")


def meta_features(panel: DataFrame, oofs: Mapping[str, DataFrame], primary: str, vectors: Sequence[str] = (), required: Sequence[str] = (), key: str = "nta_id", week: str = "week_start") -> DataFrame:
    """The panel with one score column for each out-of-fold table; other scores fall back to the primary one, with a flag.

    oofs: name -> (key, week, score). Vector columns default to 0; rows lacking a required column or the primary score go.
    """
    out = panel
    for name, oof in oofs.items():
        out = out.join(oof.select(key, week, F.col("score").alias(name)), [key, week], "left")
    for name in oofs:
        if name != primary:
            out = out.withColumn(f"{name}_fallback", F.col(name).isNull()).withColumn(name, F.coalesce(name, primary))
    if vectors:
        out = out.fillna(0.0, subset=list(vectors))
    return out.dropna(subset=[primary, *required])


def expand_parents(hits: DataFrame, chunks: DataFrame, budget: int = 4000) -> DataFrame:
    """Puts a hit's parent text before its own, in rank order, while the query's words stay within the budget.

    hits: (query_id, rank, chunk_id, parent_chunk_id, content, content_with_prefix). A parent that doesn't fit is skipped, and later
    ones may still fit, so acceptance is a fold over each query's few ranked hits.
    """
    parents = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("content_with_prefix").alias("_parent"))
    rows = hits.join(parents, "parent_chunk_id", "left").withColumns({"_own": word_count(F.col("content")), "_extra": word_count(F.col("_parent"))})
    entry = F.struct("rank", "_extra")
    per_query = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_h"), F.sum("_own").alias("_sum"))

    def take(acc: Column, h: Column) -> Column:
        fits = h["_extra"].isNotNull() & (acc["total"] + h["_extra"] <= budget)
        return F.struct(
            F.when(fits, acc["total"] + h["_extra"]).otherwise(acc["total"]).alias("total"),
            F.when(fits, F.array_append(acc["ranks"], h["rank"])).otherwise(acc["ranks"]).alias("ranks"),
        )

    zero = F.struct(F.col("_sum").alias("total"), F.array().cast("array<int>").alias("ranks"))
    chosen = per_query.select("query_id", F.aggregate("_h", zero, take, lambda a: a["ranks"]).alias("_ranks"))
    expanded = F.concat("_parent", F.lit("\n\n---\n\n"), "content_with_prefix")
    out = rows.join(chosen, "query_id").withColumn("expanded", F.array_contains("_ranks", F.col("rank")))
    out = out.withColumn("content_with_prefix", F.when(F.col("expanded"), expanded).otherwise(F.col("content_with_prefix")))
    return out.select(*hits.columns, "expanded")


def resolve_refs(chunks: DataFrame, refs: str = "cross_refs") -> DataFrame:
    """(chunk_id, ref, resolved): whether each reference hits a citation of the corpus."""
    known = chunks.select(F.col("citation").alias("ref")).distinct().withColumn("_known", F.lit(True))
    each = chunks.select("chunk_id", F.explode(refs).alias("_raw")).select("chunk_id", F.regexp_replace("_raw", r"§\s+", "§").alias("ref")).distinct()
    return each.join(known, "ref", "left").select("chunk_id", "ref", F.coalesce("_known", F.lit(False)).alias("resolved"))


def bias_frame(panel: DataFrame, population: DataFrame, key: str = "nta_id") -> DataFrame:
    """Panel rows of areas with population figures, with those."""
    return panel.join(population, key)
