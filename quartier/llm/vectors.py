"""Exact top-k inner products by vector-approximation files.

Vectors become whole numbers, floor(256 * x). They are written once, in parts of ``PART`` vectors: an approximation file with a cell of eight bits
for each component (an own origin and cell width for each vector), and a file of the exact vectors beside it. The cells alone bound
every inner product from below and above. A scan over a part's cells finds, for each query, the k-th best lower bound; vectors
whose upper bound is below that are out, and the others are read from the exact file in falling order of upper bound until the k-th score
is certain. The parts' answers, k for each query, are joined by score.

The queries are a stated set. They are stored in blocks as well, and a task reads one block after the other, so neither the driver nor a
task holds them all. Of equal vectors a part only keeps the k + 1 smallest ids: no other copy can be among k
neighbours, so large groups of copies cost nothing and nothing is lost.

Nulls and edge cases: vectors that are null, or hold a null or non-finite component (as it is, or times 256), take no part as query or
candidate; vectors of different length are not compared, and empty ones have score 0 with each other; of rows that repeat an id the one with the smallest
vector counts; a query's own id is never its neighbour; fewer than k candidates give fewer rows; scores beyond 64 bits raise an error; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, io

PART = 1 << 14
BLOCK = 1 << 10
#: Queries whose bounds are held at once.
AT_ONCE = 128
EXACT = 2.0**53


def quantised(df: DataFrame) -> DataFrame:
    """(vec_id, v): v holds floor(256 * x) of each component as a double, for the vectors that take part, one for each id."""
    x = F.transform("embedding", lambda c: c.cast("double") * 256)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", x.alias("x")).where(finite)
    # floor() of a double is a long in Spark, which ends at 2**63; beyond 2**52 doubles are whole anyway
    whole = F.transform("x", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))
    return rows.groupBy("vec_id").agg(F.min(whole).alias("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, by length."""
    ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
    lengths, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == n)
        yield ids[mine], flat[begin[mine][:, None] + np.arange(n)]


def _compact(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def cells(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """The approximation of some vectors: origin and cell width of each, and the cell of each component."""
    low = vectors.min(axis=1, initial=np.inf) if vectors.shape[1] else np.zeros(len(vectors))
    width = np.maximum((vectors.max(axis=1, initial=-np.inf) - low) / 255, 1) if vectors.shape[1] else np.ones(len(vectors))
    return {"low": low, "width": width, "cells": np.clip((vectors - low[:, None]) // width[:, None], 0, 255).astype(np.uint8)}


def bounds(part: dict[str, np.ndarray], queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products, queries by vectors, from the cells alone."""
    q = queries.astype(np.float64)
    product = q.astype(np.float32) @ part["cells"].astype(np.float32).T
    plus, minus = np.maximum(q, 0).sum(axis=1)[:, None], np.minimum(q, 0).sum(axis=1)[:, None]
    size = plus - minus
    low, width = part["low"], part["width"]
    base = (plus + minus) * low + product * width
    # single precision, and cells that are clipped or rounded by a little
    slack = size * (width * (255 * 1.2e-7 * (8 + q.shape[1]) + 1e-3) + np.abs(low) * 1e-9) + 1
    return base + minus * width - slack, base + plus * width + slack


def _stored(rows: DataFrame, folder: str, most: int, copies: int | None) -> DataFrame:
    """Writes the vectors in parts of one length and ``most`` vectors each; (part, length) of all."""
    io.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = []

        def put(n: int) -> None:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(n), strict=True))
            for at in range(0, len(ids), most):
                i, v = _distinct(ids[at : at + most], vectors[at : at + most], copies)
                name = f"{n}-{TaskContext.get().partitionId()}-{len(made)}"
                arrays.put(folder, name, ids=i, exact=_compact(v), **cells(v))
                made.append((name, n))

        for batch in batches:
            for ids, vectors in _matrices(batch):
                n = vectors.shape[1]
                held.setdefault(n, []).append((ids, vectors))
                if sum(len(i) for i, _ in held[n]) >= most:
                    put(n)
        for n in list(held):
            put(n)
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], names=["part", "length"])

    return io.written(rows.select("vec_id", "v").mapInArrow(run, "part string, length int"), "vector-parts")


def _distinct(ids: np.ndarray, vectors: np.ndarray, copies: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by id, and of equal vectors the first ``copies``."""
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    if copies is None:
        return ids, vectors
    _, group = np.unique(vectors, axis=0, return_inverse=True) if vectors.shape[1] else (None, np.zeros(len(ids), np.int64))
    order = np.argsort(group.ravel(), kind="stable")
    ranked = group.ravel()[order]
    keep = np.sort(order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < copies])
    return ids[keep], vectors[keep]


def _scores(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    if not vectors.shape[1]:
        return np.zeros(len(vectors), np.int64)
    vectors, q = vectors.astype(np.float64), q.astype(np.float64)
    if len(q) * np.abs(vectors).max(initial=0) * np.abs(q).max(initial=0) < EXACT:
        return (vectors @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(v, q, strict=True)) for v in vectors]
    if any(abs(s) >= 2**63 for s in exact):
        raise ValueError("an inner product is beyond 64 bits")
    return np.array(exact, np.int64)


def _certain(q: np.ndarray, exact: np.ndarray, order: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best and ties with them; vectors are read in the order given, by falling upper bound."""
    seen, step = 0, 4 * k
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while seen < len(order):
        more = order[seen : seen + step]
        best, scores = np.concatenate([best, more]), np.concatenate([scores, _scores(exact[more], q)])
        seen, step = seen + len(more), step * 2
        if len(best) > k:
            kth = np.partition(scores, -k)[-k]
            keep = scores >= kth
            best, scores = best[keep], scores[keep]
            if seen < len(order) and high[seen] < kth:
                break
    return best, scores


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, part: int = PART, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query, ties to the smaller vec_id.

    Both frames hold (vec_id, v), one row for each id. ``part`` and ``block`` bound how many vectors and queries a file holds.
    """
    spark = vectors.sparkSession
    folder, asked = io.shared_folder(spark, "vectors"), io.shared_folder(spark, "queries")
    parts = _stored(vectors, folder, part, k + 1)
    blocks = [tuple(r) for r in _stored(queries, asked, block, None).collect()]  # names of files, one for ``block`` queries

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, length in (row for pdf in batches for row in zip(pdf["part"], pdf["length"], strict=True)):
            held = {key: arrays.get(folder, name, key) for key in ("ids", "low", "width", "cells", "exact")}
            ids = held["ids"]
            for block_name, n in blocks:
                if n != length:
                    continue
                q_ids, q_vectors = arrays.get(asked, block_name, "ids"), arrays.get(asked, block_name, "exact")
                out = []
                for at in range(0, len(q_ids), AT_ONCE):
                    some = q_vectors[at : at + AT_ONCE]
                    low, high = bounds(held, some)
                    kth = min(k + 1, len(ids)) - 1  # one more, as the query itself may be there
                    sure = -np.partition(-low, kth, axis=1)[:, kth]
                    for i, q in enumerate(some):
                        left = np.flatnonzero(high[i] >= sure[i])
                        left = left[np.argsort(-high[i, left], kind="stable")]
                        best, score = _certain(q, held["exact"], left, high[i, left], k + 1)
                        other = ids[best] != q_ids[at + i]
                        best, score = best[other], score[other]
                        first = np.lexsort((ids[best], -score))[:k]
                        out.append((np.full(len(first), q_ids[at + i]), ids[best][first], score[first]))
                if out:
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
        io.trim()

    # one row for each part, so that each is a task's work
    spread = parts.repartition(max(io.tasks(spark), min(10_000, parts.count())), "part")
    found = spread.mapInPandas(scan, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(io.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
