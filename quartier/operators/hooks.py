"""Callers' own models as batch hooks: arrays kept beside the registry, read once by each worker, applied to batches of rows."""

from __future__ import annotations

import io
import json
import time
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.store import INDEX_SCHEMA, registry_list

#: A model's arrays by name.
Arrays = Mapping[str, np.ndarray]
#: Scores of a batch of texts against their queries.
Score = Callable[[Arrays, np.ndarray, np.ndarray], np.ndarray]


def save_arrays(spark: SparkSession, arrays: Arrays, path: str, name: str, version: str, metadata: Mapping | None = None) -> None:
    """Adds a version of a model of plain arrays to the registry below path, numbered like its other models. A version is saved once."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    at = f"{path}/arrays/{name}/{version}"
    spark.createDataFrame([(bytearray(held.getvalue()),)], "arrays binary").coalesce(1).write.mode("errorifexists").parquet(at)
    spark.createDataFrame([], INDEX_SCHEMA).write.mode("ignore").parquet(f"{path}/index")
    last = registry_list(spark, path).where(F.col("name") == name).agg(F.max("number")).first()[0]
    row = [(name, version, json.dumps(dict(metadata or {}) | {"kind": "arrays"}), (last or 0) + 1, time.time_ns())]
    spark.createDataFrame(row, INDEX_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/index")


def _version(spark: SparkSession, path: str, name: str, version: str | None) -> str:
    of_arrays = F.get_json_object("metadata", "$.kind") == "arrays"
    rows = registry_list(spark, path).where((F.col("name") == name) & of_arrays)
    found = version or rows.agg(F.max_by("version", F.struct("number", "saved_ns"))).first()[0]
    if found is None or rows.where(F.col("version") == found).isEmpty():
        raise KeyError(name if version is None else f"{name} {version}")
    return found


def load_arrays(at: str) -> dict[str, np.ndarray]:
    """A saved model's arrays, read from the shared folder without a session, as workers do."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at.removeprefix("file:"))
    (blob,) = pq.read_table(place, filesystem=store, columns=["arrays"]).column("arrays").to_pylist()
    with np.load(io.BytesIO(blob), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


def batch_scorer(path: str, name: str, score: Score, version: str | None = None, batch: int = 1024) -> Callable[[Column, Column], Column]:
    """A scorer of (query, text) for ``rerank`` and ``retrieve``, whose model is that version of the registry, or the one saved last.

    The version is settled here, on the driver, so that all tasks of a job use one model however long it runs. Only its place travels with the tasks; each Python worker reads the arrays
    once. ``score`` gets at most ``batch`` rows at a time, nulls as None, and returns a number for each; what is not finite is no score and comes last.
    """
    spark = SparkSession.active()
    at = f"{path}/arrays/{name}/{_version(spark, path, name, version)}"

    def make() -> Callable:
        arrays = load_arrays(at)

        def predict(query: np.ndarray, text: np.ndarray) -> np.ndarray:
            out = np.asarray(score(arrays, query, text), np.float64)
            if out.shape != (len(query),):
                raise ValueError(f"a scorer returns one number a row, not {out.shape} for {len(query)} rows")
            return out

        return predict

    scored = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch)

    def apply(query: Column, text: Column) -> Column:
        raw = scored(query, text)
        return F.when(F.isnan(raw) | (F.abs(raw) == float("inf")), F.lit(float("-inf"))).otherwise(raw)

    return apply
