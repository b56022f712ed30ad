import math

import numpy as np
import pytest

from quartier.llm import embedding_dedup as dedup
from quartier.llm import graph


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) of each row by comparing all pairs."""
    sets, links = graph.UnionFind(len(rows)), [0] * len(rows)

    def takes_part(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [np.array(v, float) / max(map(abs, v)) if takes_part(v) else None for _, v in rows]
    units = [u if u is None else u / np.linalg.norm(u) for u in units]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                sets.join(i, j)
                links[i], links[j] = links[i] + 1, links[j] + 1
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[sets.find(i)] = min(v, least.get(sets.find(i), v))
    return [(v, links[i], least.get(sets.find(i)), v == least.get(sets.find(i))) for i, (v, _) in enumerate(rows)]


def same(spark, rows, kind="array<double>", **more):
    df = spark.createDataFrame([(*r, 3) for r in rows], f"vec_id long, embedding {kind}, n_links int").repartition(3)
    got = sorted(map(str, map(tuple, dedup.near_duplicates(df, **more).collect())))
    assert got == sorted(map(str, brute(rows)))


def table(rng, n=400, dim=16):
    rows = [rng.normal(size=dim) for _ in range(n)]
    for k in range(25):
        rows += [rows[k] + rng.normal(scale=s, size=dim) for s in (0.01, 0.1, 0.25)]
    rows += [rows[0]] * 30 + [rows[1] * 7.5]  # copies, and one that is only parallel
    return [(i, v.tolist()) for i, v in enumerate(rows)]


ODD = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [1.0] * 15 + [None]), (9004, [float("nan")] * 16), (9005, [float("inf")] * 16), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [-0.0, 1.0]), (9009, [0.0, 1.0]), (9010, [1e300, 1e300]), (9011, [1e-320, 1e-320]), (None, [5.0, -1.0]), (None, [5.0, -1.0]), (9012, [7.0]), (7, [3.0, -4.0]), (7, [3.0, -4.0]), (7, [4.0, 3.0]), (None, [3.0, -4.01])]


def test_equal_to_brute_force(spark):
    same(spark, table(np.random.default_rng(1)) + ODD)
    same(spark, ODD)
    same(spark, [(i, np.float32(v).tolist()) for i, v in table(np.random.default_rng(2), 60)], "array<float>")
    assert dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("scale", [0.05, 0.16, 0.3])
def test_large_components_are_counted_in_whole(spark, monkeypatch, scale):
    """Dense groups are one ball, wide ones many balls and tiles; every link is counted."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(dedup, "SMALL", 5)
    monkeypatch.setattr(dedup, "TILE", 40)
    monkeypatch.setattr(dedup, "LEADERS", 2)
    centre = rng.normal(size=12)
    rows = [(i, (centre + rng.normal(scale=scale, size=12)).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=12).tolist()) for i in range(40)]
    rows += [(2000 + i, rows[3][1]) for i in range(20)]
    same(spark, rows)


def test_windows_across_ranges(spark, monkeypatch):
    """Small windows, so that many ranges end within a group; seams lose nothing."""
    rng = np.random.default_rng(4)
    rows = table(rng, 100, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in dedup.near_duplicates(df, window=4, sure=0.9999).collect()}
    want = brute(rows)
    assert sum(got[v].n_links for v, *_ in want) >= 0.97 * sum(n for _, n, *_ in want)
    assert all(got[v].n_links <= n for v, n, *_ in want)


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.91, the hardest to find, among many more vectors than a window holds."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(1500, 32))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.91, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=16)
    found = sum(r.component_id == r.vec_id - 1500 for r in got.collect() if r.vec_id >= 1500)
    assert found >= 0.97 * 1500


def test_passes_follow_the_size():
    assert dedup.passes(100) == 1 and dedup.passes(257) == 1
    assert [dedup.passes(n) for n in (10_000, 50_000, 10**6)] == sorted(dedup.passes(n) for n in (10_000, 50_000, 10**6))


def test_query_equals_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    got = dedup.op12_embedding_dedup(spark, path)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({dedup.OP12_SQL})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


def test_sql_equals_brute_force():
    import duckdb
    import pandas as pd

    rows = table(np.random.default_rng(6), 80) + ODD
    embeddings = pd.DataFrame({"vec_id": pd.array([v for v, _ in rows], "Int64"), "embedding": [x for _, x in rows]})  # noqa: F841  read by name
    got = duckdb.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({dedup.OP12_SQL})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
