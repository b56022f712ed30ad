"""A stored index for approximate dense search: coarse cells, read by the queries that probe them.

``build`` fits cell centres by k-means on a bounded sample of unit vectors and then writes every vector below the folder of its nearest centre. A cell
of very many vectors lies in several parts, so no task ever takes more than about ``most`` of them. ``extend`` adds vectors to the cells as they are, as one more
batch; a batch counts from the moment its list of parts is written, which happens last. ``search`` sends each query to its nearest cells by an equality
join on (batch, cell, part) and compares there; with as many probes as cells the answer is exact.

Vectors that are null, zero, or hold a null or non-finite component are left out, of the index and of the queries; so are those of another length than
most vectors had when it was built. An id that was added twice counts with its greater score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import work
from .ranking import top_n

#: Vectors of a part, and queries that meet a part at once.
MOST = 1 << 14
BLOCK = 1 << 10
#: Vectors that the centres are fitted on, and the most cells that are chosen without being asked for.
SAMPLE = 100_000
MOST_CELLS = 4096


@dataclass
class VectorIndex:
    path: str
    #: cells by length: one for each centre
    centres: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centres)


def unit_rows(df: DataFrame, key: str, vec: str, out: str = "id") -> DataFrame:
    """(id, raw, v): vectors as they are and scaled to length one, those that have one."""
    x = F.transform(vec, lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias(out), F.col(vec).alias("raw"), x.alias("v")).where(finite)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    return rows.withColumn("_n", norm).where("_n > 0 AND _n < double('infinity')").select(out, "raw", F.transform("v", lambda c: c / F.col("_n")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """The rows with the ``probes`` cells whose centres they are nearest to, a row for each."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(lengths == centres.shape[1]))
            near = _matrix(batch.column("v")) @ centres.T if batch.num_rows else np.zeros((0, len(centres)))
            best = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
            row = np.repeat(np.arange(len(near)), best.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(best.ravel().astype(np.int32))], names=names)

    return rows.mapInArrow(run, schema)


def _batches(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(batch, cell, parts) of what is complete; no more rows than cells times batches."""
    return [(r.batch, r.cell, r.parts) for r in spark.read.schema("batch int, cell int, parts int").parquet(f"{path}/parts").collect()]


def _add(vectors: DataFrame, index: VectorIndex, batch: int, key: str, vec: str, most: int) -> None:
    rows = work.stored(_nearest(unit_rows(vectors, key, vec), index.centres, 1), "assigned")
    spark = rows.sparkSession
    sizes = [(batch, r.cell, max(1, math.ceil(r.n / most))) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most one row a cell
    known = spark.createDataFrame(sizes, "batch int, cell int, parts int")
    dealt = rows.join(F.broadcast(known), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.drop("parts", "v")
    # one file for each cell and part
    dealt.repartition(max(1, len(sizes)), "cell", "part").write.mode("overwrite").partitionBy("cell", "part").parquet(f"{index.path}/vectors/batch={batch}")
    known.coalesce(1).write.mode("append").parquet(f"{index.path}/parts")


def build(vectors: DataFrame, path: str, cells: int | None = None, key: str = "chunk_id", vec: str = "embedding", sample: int = SAMPLE, most: int = MOST, seed: int = 7) -> VectorIndex:
    """Writes a new index of all vectors to a folder. Cells: about the square root of the number of vectors, unless given."""
    spark = vectors.sparkSession
    rows = unit_rows(vectors, key, vec)
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "size").first()
    if common is None:
        raise ValueError("an index needs a vector at least")
    n, rows = common.n, rows.where(F.size("v") == common.size)
    cells = max(1, min(n, cells or min(MOST_CELLS, round(math.sqrt(n)))))
    some = rows if n <= sample else rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)) < sample)
    fitted = KMeans(k=cells, seed=seed, distanceMeasure="cosine", featuresCol="f").fit(some.select(array_to_vector("v").alias("f")))
    centres = np.array(fitted.clusterCenters(), np.float64)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    index = VectorIndex(path, centres)
    _add(vectors, index, 0, key, vec, most)
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # one row a cell
    return VectorIndex(path, np.array([r.centre for r in rows], np.float64))


def extend(vectors: DataFrame, index: VectorIndex, key: str = "chunk_id", vec: str = "embedding", most: int = MOST) -> None:
    """Adds vectors to the cells that the index has."""
    held = [b for b, _, _ in _batches(vectors.sparkSession, index.path)]
    _add(vectors, index, max(held, default=-1) + 1, key, vec, most)


def _best(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and v, and scores, of the k best for each q and what ties with them."""
    scores = np.round(q @ v.T, 9)
    kth = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else -np.inf
    row, at = np.nonzero(scores >= kth)
    return row, at, scores[row, at]


def search(queries: DataFrame, index: VectorIndex, k: int = 10, probes: int = 8, block: int = BLOCK, query: str = "query_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, chunk_id, score): of the vectors in each query's nearest cells the k with the greatest cosine, ties to the smaller id."""
    spark = queries.sparkSession
    asked = work.stored(_nearest(unit_rows(queries, query, vec, "q").drop("raw"), index.centres, min(probes, index.cells)), "probes")
    asks = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a cell
    deals = [(b, c, p, blocks) for b, c, parts in _batches(spark, index.path) if c in asks for p in range(parts) for blocks in [math.ceil(asks[c] / block)]]
    known = spark.createDataFrame(deals, "batch int, cell int, part int, blocks int")
    stored = spark.read.option("basePath", f"{index.path}/vectors").parquet(f"{index.path}/vectors")
    # folders of other cells are not read
    stored = stored.where(F.col("cell").isin(sorted(asks)) & F.col("batch").isin(sorted({d[0] for d in deals})))
    by = ["batch", "cell", "part", "block"]
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = asked.join(known, "cell").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).select(*by, "q", "v")
    right = stored.join(known, by[:3]).withColumn("block", every).select(*by, "id", "raw")
    kinds = f"query_id {asked.schema['q'].dataType.simpleString()}, chunk_id {stored.schema['id'].dataType.simpleString()}, score double"

    def meet(some: pa.Table, held: pa.Table) -> pa.Table:
        q_ids, ids = some.column("q").combine_chunks(), held.column("id").combine_chunks()
        if not len(q_ids) or not len(ids):
            return pa.table({"query_id": q_ids[:0], "chunk_id": ids[:0], "score": pa.array([], pa.float64())})
        vectors = _matrix(held.column("raw")).astype(np.float64)
        row, at, score = _best(_matrix(some.column("v")), vectors / np.linalg.norm(vectors, axis=1, keepdims=True), k)
        return pa.table({"query_id": q_ids.take(pa.array(row)), "chunk_id": ids.take(pa.array(at)), "score": score})

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, kinds)
    found = found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_n(found, ["query_id"], ["-score", "chunk_id"], k).select("query_id", "rank", "chunk_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, chunk_id) pairs that were found."""
    total, hit = exact.select("query_id", "chunk_id"), found.select("query_id", "chunk_id")
    return total.join(hit, ["query_id", "chunk_id"]).count() / max(1, total.count())


def probes_for(queries: DataFrame, index: VectorIndex, k: int = 10, target: float = 0.95, sample: int = 64, query: str = "query_id", vec: str = "embedding") -> int:
    """The least of some numbers of probes that finds the target share of what all cells would give, for a bounded sample of the queries.

    Vectors without clusters take a large share of the cells, clustered ones a few.
    """
    some = work.stored(queries.select(query, vec).orderBy(F.xxhash64(query), query).limit(sample), "asked")
    exact = work.stored(search(some, index, k, index.cells, query=query, vec=vec), "exact")
    probes = 2
    while probes < index.cells and recall(search(some, index, k, probes, query=query, vec=vec), exact) < target:
        probes = math.ceil(probes * 1.6)
    return min(probes, index.cells)
