"""Keyed upserts, incremental loads, and the tables and files that results are kept in."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import polygon_area


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row a key: the last by ``order``, or by all columns where none is given, so that the choice never depends on the plan.

    max_by pre-aggregates on the map side, so a key with very many rows is no heavier than others.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    rank = F.struct(*[F.col(c) for c in [*(order or []), *rest]])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update_cols: Sequence[str] | None = None, on_conflict: str = "update", order: Sequence[str] | None = None) -> DataFrame:
    """The target with the source's rows: new keys added, known ones updated (all or some columns) or left ("nothing")."""
    source = last_rows(source, keys, order)
    if on_conflict == "nothing":
        known = target.select(*[F.col(k).alias(f"_{k}") for k in keys])
        return target.unionByName(source.join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti"))
    if on_conflict != "update":
        raise ValueError(f"on_conflict is 'update' or 'nothing', not {on_conflict!r}")
    change = [c for c in target.columns if c not in keys] if update_cols is None else list(update_cols)
    old, new = target.withColumn("_old", F.lit(True)).alias("o"), source.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"o.{c}", f"n.{c}")
        take = F.col("_new").isNotNull() & (F.lit(c in change) | F.col("_old").isNull())
        return F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[pick(c).alias(c) for c in target.columns])


def upsert_add(target: DataFrame, source: DataFrame, keys: Sequence[str], sum_cols: Sequence[str]) -> DataFrame:
    """Sums of both by key: the second load adds to the first."""
    both = target.select(*keys, *sum_cols).unionByName(source.select(*keys, *sum_cols))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sum_cols])


def incremental(df: DataFrame, cursor: DataFrame, source: str, col: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows beyond the source's cursor, and the cursor table moved to the greatest value seen.

    cursor: (source, value, rows). It has one row a source, so it is broadcast.
    """
    mine = cursor.where(F.col("source") == source).agg(F.max("value").alias("_from"))
    beyond = F.col(col) > F.col("_from") if strict else F.col(col) >= F.col("_from")
    delta = df.crossJoin(F.broadcast(mine)).where(F.col("_from").isNull() | beyond).drop("_from")  # one row
    seen = delta.agg(F.lit(source).alias("source"), F.max(col).alias("value"), F.count(F.lit(1)).alias("rows"))
    moved = cursor.unionByName(seen).groupBy("source").agg(F.max("value").alias("value"), F.sum("rows").alias("rows"))
    return delta, moved


def read_polygons(spark: SparkSession, path: str, id_col: str = "nta2020", name_col: str = "ntaname", borough_col: str = "boroname") -> DataFrame:
    """(nta_id, name, borough, rings, area) of a GeoJSON collection; every ring of every part is one array entry."""
    schema = (
        "features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    )
    feature = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    single = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(multi)).otherwise(single)
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    prop = lambda c: F.try_element_at(F.col("f.properties"), F.lit(c))
    out = feature.select(prop(id_col).alias("nta_id"), prop(name_col).alias("name"), prop(borough_col).alias("borough"), points.alias("rings"), prop("shape_area").try_cast("double").alias("area"))
    return out.withColumn("area", F.coalesce("area", polygon_area(F.col("rings")))).where("nta_id IS NOT NULL")


def to_geojson(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON point feature a row, as text; rows without a place go."""
    properties = F.struct(*[F.col(c) for c in df.columns if c not in (lon, lat)])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return df.dropna(subset=[lon, lat]).select(F.to_json(feature).alias("feature"))


#: Columns of one flattened span.
SPAN_SCHEMA = (
    "trace_id string, span_id string, parent_span_id string, name string, start_time_ns long, end_time_ns long, status string, "
    "model string, tokens_in long, tokens_out long"
)


def read_spans(spark: SparkSession, path: str, schema: str = SPAN_SCHEMA) -> DataFrame:
    """Spans, one JSON object a line, with start time and duration; lines that are no spans go."""
    rows = spark.read.schema(schema).json(path).where("span_id IS NOT NULL")
    return rows.withColumns({"ts": F.timestamp_micros(F.expr("(start_time_ns - pmod(start_time_ns, 1000)) div 1000")), "duration_ms": (F.col("end_time_ns") - F.col("start_time_ns")) / 1e6})


#: Columns of one evaluation question.
GOLD_SCHEMA = (
    "id string, question string, expected_citations array<string>, must_cite_at_least_one_of array<array<string>>, "
    "must_not_say array<string>, reference_answer string, failure_mode string"
)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions, one JSON object a line."""
    return spark.read.schema(GOLD_SCHEMA).json(path).where("id IS NOT NULL")


def write_oof(df: DataFrame, path: str, key: str = "nta_id", week: str = "week_start", value: str = "score") -> None:
    """Out-of-fold predictions as (key, value) with the key and week joined by a pipe."""
    df.select(F.concat_ws("|", F.col(key), F.col(week).cast("string")).alias("key"), F.col(value).cast("double").alias("value")).write.mode("overwrite").parquet(path)


def read_oof(spark: SparkSession, path: str, value: str = "score") -> DataFrame:
    parts = F.split("key", r"\|")
    return spark.read.parquet(path).select(parts[0].alias("nta_id"), F.try_to_date(parts[1]).alias("week_start"), F.col("value").alias(value))


INDEX_SCHEMA = "name string, version string, metadata string, number long, saved_ns long"


def registry_save(model: PipelineModel, path: str, name: str, version: str, metadata: Mapping | None = None) -> None:
    """Adds a model version, and a row about it in the index, numbered in the order of saving."""
    spark = SparkSession.active()
    model.write().save(f"{path}/models/{name}/{version}")
    empty = spark.createDataFrame([], INDEX_SCHEMA)
    empty.write.mode("ignore").parquet(f"{path}/index")
    last = registry_list(spark, path).where(F.col("name") == name).agg(F.max("number")).first()[0]
    row = [(name, version, json.dumps(metadata or {}), (last or 0) + 1, time.time_ns())]
    spark.createDataFrame(row, INDEX_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/index")


def registry_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, metadata, number, saved_ns) of all versions."""
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def registry_load(spark: SparkSession, path: str, name: str, version: str | None = None) -> PipelineModel:
    """A model by name: the given version or the one saved last. KeyError if there is none."""
    rows = registry_list(spark, path).where(F.col("name") == name)
    found = version or rows.agg(F.max_by("version", F.struct("number", "saved_ns"))).first()[0]
    if found is None or rows.where(F.col("version") == found).isEmpty():
        raise KeyError(name if version is None else f"{name} {version}")
    return PipelineModel.load(f"{path}/models/{name}/{found}")
