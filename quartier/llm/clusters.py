"""Exact k-means over whole-number vectors with a table of distances to fixed pivots.

Vectors become whole numbers. Pivots, far from each other, are chosen once among the ``SAMPLE`` rows of smallest hash (a bound that only
concerns speed); each vector's distances to them are computed once and written beside it. In a round the distances of every centroid to the pivots are
known too, and by the triangle inequality the greatest difference of the two rows of the table is a lower bound of the distance of vector and centroid. A
task visits centroids by rising bound, and only those whose bound is not above the least distance so far get an exact distance, in whole numbers.
A round returns exact sums by cluster and component, added up within tasks and then in Spark; the driver holds k centroids and no more.

Nulls and edge cases: vectors that are null, of another length, or hold a null or non-finite component (as it is, or scaled) are left out; each row
is a vector, repeated ids and repeated vectors included; a null id counts as empty text in the hash that picks the first centroids, whose ties go by
vector; of equally near centroids the smaller number wins; fewer vectors than k give as many centroids as vectors; an empty cluster keeps its centroid; a
distance beyond 64 bits, and inertia that holds one, is null while the cluster is still exact; columns called like those that are
added are replaced, others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import io

PIVOTS = 12
#: Rows among which pivots are chosen.
SAMPLE = 256
#: Components below this square and add up within 64 bits, for 1,024 components.
SMALL = 1 << 25
LONGEST = 1024
#: Bounds of vectors by centroids held at once.
AT_ONCE = 1 << 21
LIMB = 32


def lattice(df: DataFrame, size: int = 64, scale: int = 64, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with ``v``: floor(scale * x) of each component, as whole doubles."""
    x = F.transform(vector, lambda c: c.cast("double") * scale)
    finite = F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == size)).withColumn("_x", x).where(finite)
    # floor() of a double is a long in Spark, which ends at 2**63; beyond 2**52 doubles are whole anyway
    return rows.withColumn("v", F.transform("_x", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))).drop("_x", vector)


def first_rows(rows: DataFrame, n: int, seed: int, key: str = "vec_id") -> list[list[int]]:
    """The vectors of the n rows with the smallest sha256 of seed and id, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [[int(c) for c in r.v] for r in rows.select(h.alias("h"), "v").orderBy("h", "v").limit(n).collect()]


def far_apart(sample: list[list[int]], n: int) -> list[list[int]]:
    """n pivots: the first, and then always the row whose nearest pivot is farthest."""
    rows = np.array(sample, np.float64)
    chosen, nearest = [], np.full(len(rows), np.inf)
    for _ in range(min(n, len(rows))):
        at = int(np.argmax(nearest)) if chosen else 0
        if nearest[at] == 0:  # the rest equal pivots
            break
        chosen.append(sample[at])
        with np.errstate(over="ignore"):
            nearest = np.minimum(nearest, np.linalg.norm(rows - rows[at], axis=1))
    return chosen


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, of 64-bit or of Python integers."""
    d = a - b
    return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def whole(vectors: np.ndarray) -> np.ndarray:
    """64-bit integers if their squares add up within 64 bits, else Python's."""
    if vectors.shape[1] <= LONGEST and np.abs(vectors).max(initial=0) < SMALL:
        return vectors.astype(np.int64)
    return np.array([[int(c) for c in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def pivot_distances(vectors: np.ndarray, pivots: list[list[int]]) -> np.ndarray:
    """Distances to each pivot; 0, which bounds nothing, where they are beyond doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.stack([np.sqrt(((vectors - np.array(p, np.float64)) ** 2).sum(axis=1)) for p in pivots], axis=1) if pivots else np.zeros((len(vectors), 0))
        single = found.astype(np.float32)
    return np.where(np.isfinite(single), single, np.float32(np.nan))


def assign(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, centroid_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, the squared distance, and how many exact distances that took."""
    n, k = len(vectors), len(centroids)
    low = np.zeros((n, k))
    for p in range(table.shape[1]):
        mine, theirs = table[:, p].astype(np.float64)[:, None], centroid_table[:, p].astype(np.float64)[None, :]
        # single precision misses by a ten-millionth of a distance at most
        np.fmax(low, np.abs(mine - theirs) - 1e-6 * (mine + theirs), out=low)
    low *= low
    if vectors.dtype == object or centroids.dtype == object:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    order = np.argsort(low, axis=1, kind="stable")
    cluster, best = order[:, 0].copy(), squares(vectors, centroids[order[:, 0]])
    left, exact = np.arange(n), n
    for r in range(1, k):
        c = order[left, r]
        open_ = low[left, c] <= best[left].astype(np.float64) if best.dtype != object else np.ones(len(left), bool)
        left, c = left[open_], c[open_]
        if not len(left):
            break
        d = squares(vectors[left], centroids[c])
        exact += len(left)
        better = (d < best[left]) | ((d == best[left]) & (c < cluster[left]))
        at = left[better]
        best[at], cluster[at] = d[better], c[better]
    return cluster, best, exact


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as (place, part): parts of 64 bits that add up when each is shifted by its place."""
    place = 0
    while not -(1 << 62) < value < 1 << 62:
        yield place, value & ((1 << LIMB) - 1)
        value, place = value >> LIMB, place + 1
    yield place, value


def _batches(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], pivots: list[list[int]]) -> Iterator[tuple]:
    """Rows of the pivot table with the cluster and squared distance of each."""
    c = whole(np.array(centroids, object))
    table = pivot_distances(np.array(centroids, np.float64), pivots)
    step = max(1, AT_ONCE // len(centroids))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            vectors = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            held = part.column("pivot_distance").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            vectors = whole(vectors)
            yield (part, vectors, *assign(vectors, held, c, table)[:2])


def pivot_table(rows: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """The rows and their distances to the pivots, written to the shared folder."""
    io.small_batches(rows.sparkSession)
    rows = rows.drop("pivot_distance")
    schema = T.StructType([*rows.schema.fields, T.StructField("pivot_distance", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = pivot_distances(vectors, pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(pivots)), pa.array(found.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.fieldNames())

    return io.written(rows.mapInArrow(run, schema), "pivot-table")


def moved(table: DataFrame, centroids: list[list[int]], pivots: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of the exact means of the vectors nearest to each, empty ones as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, {}
        for _, vectors, cluster, _ in _batches(batches, centroids, pivots):
            for c in np.unique(cluster).tolist():
                mine = vectors[cluster == c]
                sums[c] = sums.get(c, 0) + mine.sum(axis=0).astype(object)
                counts[c] = counts.get(c, 0) + len(mine)
        out = [(c, -1, 0, n) for c, n in counts.items()]  # the count stands before the components
        out += [(c, i, *limb) for c, s in sums.items() for i, total in enumerate(s) for limb in _limbs(int(total))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "component", "place", "part"])

    parts = table.select("v", "pivot_distance").mapInArrow(run, "cluster int, component int, place int, part long")
    totals: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        totals[r.cluster, r.component] = totals.get((r.cluster, r.component), 0) + (int(r.total) << LIMB * r.place)
    return [[totals[c, i] // totals[c, -1] for i in range(len(old))] if (c, -1) in totals else old for c, old in enumerate(centroids)]


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, pivots: int = PIVOTS, key: str = "vec_id") -> tuple[DataFrame, list[list[int]]]:
    """The rows of (key, v, ...) with ``cluster`` and ``distance`` (squared), and the centroids by number.

    Begins with the k rows of smallest hash; each round assigns every vector and moves the centroids, and a last pass assigns once more.
    """
    rows = rows.drop("cluster", "distance", "pivot_distance")
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    sample = first_rows(rows, max(k, SAMPLE), seed, key)
    centroids = sample[:k]
    if not centroids:
        return rows.sparkSession.createDataFrame([], schema), []
    far = far_apart(sample, pivots)
    table = pivot_table(rows, far)
    for _ in range(rounds):
        centroids = moved(table, centroids, far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, found, distance in _batches(batches, centroids, far):
            held = pa.array([d if d < 1 << 63 else None for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found.astype(np.int32)), held], names=schema.fieldNames())

    return io.written(table.mapInArrow(run, schema), "clusters"), centroids


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(lattice(io.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "v"))
    whole_sum = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(whole_sum.alias("inertia")).collect()}  # k rows
    total = sum(per.values()) if all(x is not None for x in per.values()) else None
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    told = [(c, fits(per.get(c)), fits(total), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    known = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """The same in SQL: every round compares all vectors with all centroids."""
    square = "CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT v.rid, c.cluster, {square} AS d FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY d, c.cluster) = 1)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT a.cluster, v.v, generate_subscripts(v.v, 1) AS place FROM a{i} a JOIN v USING (rid))")
            steps.append(f"s{i} AS (SELECT cluster, place, sum(v[place]) AS s, count(*) AS n FROM u{i} GROUP BY cluster, place)")
            steps.append(f"m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM s{i} GROUP BY cluster)")
            steps.append(f"c{i + 1} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM v QUALIFY row_number() OVER (ORDER BY h, v) <= {k}
), {", ".join(steps)}
SELECT v.vec_id, a.cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c USING (cluster)
"""


OP11_SQL = _op11_sql()
