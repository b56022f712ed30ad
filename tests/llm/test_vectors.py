import math
import random

from pyspark.sql import functions as F

from quartier.llm import vectors


def brute(rows, k, asks):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.setdefault(i, [math.floor(256 * x) for x in v])
    out = []
    for q in sorted(x for x in held if asks(x)):
        score = sorted((-sum(a * b for a, b in zip(held[q], v, strict=True)), i) for i, v in held.items() if i != q and len(v) == len(held[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:k])]
    return out


def test_equal_to_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a large group of copies
    rows += [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2050, [float("inf")] * 8), (2100, [0.5, 0.25]), (2150, [0.0] * 8), (2051, [0.1, 0.2]), (None, [1.0] * 8), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    v = vectors.quantised(df)
    for part, block in ((8192, 8192), (70, 3)):
        got = vectors.top_k(v.where("vec_id % 50 = 0"), v, 5, part, block).collect()
        assert sorted(map(tuple, got)) == brute(rows, 5, lambda x: x % 50 == 0)
    few = vectors.quantised(df.where("vec_id IN (50, 51, 100)"))
    assert few.count() >= 3 and vectors.top_k(few.where("vec_id = 50"), few).count() == 2
    none = v.limit(0)
    assert vectors.top_k(none, v).count() == 0 and vectors.top_k(v.where("vec_id = 50"), none).count() == 0


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(0)
    for scale in (1, 300, 1e9):
        a, q = np.floor(rng.normal(0, scale, (50, 16))), np.floor(rng.normal(0, scale, (7, 16)))
        a[3], a[4, 0] = 5, 1e12
        low, high = vectors.bounds(vectors.cells(a), q)
        exact = np.array([[sum(int(x) * int(y) for x, y in zip(v, w, strict=True)) for v in a] for w in q], float)
        assert (low <= exact).all() and (exact <= high).all()


def test_large_components_empty_vectors_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (1, [4e13, 1.0]), (2, [1.0, 1.0]), (50, []), (51, []), (100, [3.0]), (101, [2.0]), (101, [1.0]), (102, [1e308])]
    v = vectors.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, vectors.top_k(v.where("vec_id % 50 = 0"), v).collect()))
    big = math.floor(256 * 4e13)
    assert got == [(0, 1, 1, 256 * big + 512 * 256), (0, 2, 2, 256 * 256 + 512 * 256), (50, 1, 51, 0), (100, 1, 101, 768 * 256)]


def test_query_equals_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    want = con.execute(vectors.OP8_SQL).fetchall()
    assert sorted(map(tuple, vectors.op8_exact_top_k(spark, path).select("query_id", F.col("rank"), "vec_id", "score").collect())) == sorted(want)
