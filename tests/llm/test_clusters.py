import hashlib
import math
import random

import duckdb
import numpy as np

from quartier.llm import clusters


def brute(rows, k, rounds, size, seed=1, scale=64):
    """(vec_id, cluster, distance) of each row, and centroids, by comparing everything with exact integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x * scale) for x in v)]
    digest = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=digest)[:k]]

    def nearest(v):
        d, c = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
        return c, d

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    return [(i, *nearest(v)) for i, v in kept], centroids


def check(spark, rows, k, rounds, size, kind="array<double>"):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding {kind}, distance string").repartition(3)
    found, centroids = clusters.cluster(clusters.lattice(df, size), k, rounds)
    want, want_centroids = brute(rows, k, rounds, size)
    assert centroids == want_centroids
    fits = [(i, c, d if d < 2**63 else None) for i, c, d in want]
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance) for r in found.collect()))) == sorted(map(str, fits))


def test_equal_to_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(3 * (i % 5), 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a large group of copies
    rows += [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, [1.0]), (2005, []), (None, [1.0] * 8), (None, [2.0] * 8), (7, rows[7][1]), (7, rows[8][1]), (2006, [-0.0] * 8), (2007, [1.7e308] * 8)]
    for k, rounds in ((16, 3), (1, 2), (40, 1), (7, 0)):
        check(spark, rows, k, rounds, 8)
    check(spark, rows[:3], 16, 3, 8)
    check(spark, rows[300:340], 16, 2, 8)  # all equal: one cluster has all of them, the others stay empty
    check(spark, [(i, [float(i % 4), float(i % 3)]) for i in range(60)], 16, 3, 2)  # ties
    check(spark, [*rows[:40], (5000, [1e30] * 8), (5001, [-3e305] * 8), (5002, [4e7] * 8), (5003, [-4e7] * 8)], 16, 3, 8)  # beyond 64 bits
    check(spark, [(i, [float(np.float32(x)) for x in v]) for i, v in rows[:50]], 5, 3, 8, "array<float>")
    assert clusters.cluster(clusters.lattice(spark.createDataFrame([], "vec_id long, embedding array<double>")))[0].count() == 0


def test_pivots_save_exact_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (32, 16))
    vectors = centres[rng.integers(0, 32, 3000)] + rng.integers(-40, 40, (3000, 16))
    centroids = centres + rng.integers(-5, 5, centres.shape)
    pivots = clusters.far_apart(vectors[:256].tolist(), 12)
    table, theirs = (clusters.pivot_distances(x.astype(float), pivots) for x in (vectors, centroids))
    cluster, distance, exact = clusters.assign(vectors, table, centroids, theirs)
    full = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (distance == full.min(axis=1)).all() and (cluster == full.argmin(axis=1)).all()
    assert exact < 0.1 * full.size


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    got = clusters.op11_centroid_clusters(spark, path)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({clusters.OP11_SQL})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)
