"""Covers of polygons against the fixed grid, which tests every candidate's sides."""

import math
import random

import pytest

from quartier.operators import cover, spatial

SCHEMA = "area string, rings array<array<struct<x: double, y: double>>>"


@pytest.fixture(scope="module")
def map_(spark):
    rnd, rows = random.Random(3), []
    for n in range(30):
        cx, cy, r = rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.choice([0.02, 0.3, 2.0])
        ring = [(cx + r * rnd.uniform(0.5, 1) * math.cos(a), cy + r * rnd.uniform(0.5, 1) * math.sin(a)) for a in (2 * math.pi * i / 60 for i in range(60))]
        hole = [(cx + 0.2 * r * math.cos(a), cy + 0.2 * r * math.sin(a)) for a in (2 * math.pi * i / 7 for i in range(7))]
        rows.append((f"p{n}", [ring, hole]))
    rows += [("square", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]), ("none", None), ("empty", [])]
    polys = spark.createDataFrame(rows, SCHEMA)
    places = [(i, rnd.uniform(-5, 5), rnd.uniform(-5, 5)) for i in range(1500)] + [(2000 + i, 0.25, 0.75) for i in range(700)]
    places += [(9000, 0.0, 0.5), (9001, 1.0, 1.0), (9002, None, 0.5), (9003, float("nan"), 0.5), (9004, 0.5, 0.5), (9004, 0.5, 0.5), (9005, float("inf"), 0.0)]
    return spark.createDataFrame(places, "id long, lon double, lat double"), polys


def rows_of(df):
    return sorted((r.id, r.area) for r in df.collect())


def test_cover_equals_grid(map_):
    points, polys = map_
    want = rows_of(spatial.within_join(points, polys.where("size(rings) > 0"), 0.5))
    laid = cover.cover(polys, fan=2, depth=7)
    assert rows_of(cover.within_cover(points, laid)) == want and len(want) > 700
    assert rows_of(cover.within_cover(points, laid, broadcast_sides=0, salt=4)) == want
    other = cover.cover(polys)
    assert rows_of(cover.within_cover(points, other)) == want
    assert (9000, "square") not in want and want.count((9004, "square")) == 2


def test_inner_cells_have_no_sides_and_busy_cells_are_no_single_key(map_):
    points, polys = map_
    laid = cover.cover(polys, fan=2, depth=7)
    inner = laid.cells.where("not cut")
    assert inner.count() > 0 and inner.where("size(sides) > 0").isEmpty()
    assert laid.cells.where("cut").selectExpr("avg(size(sides))").first()[0] < 40  # of 67 sides a polygon
    small = cover.within_cover(points, laid)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small and "Python" not in small
    plan = cover.within_cover(points, laid, broadcast_sides=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "Cartesian" not in plan


def test_a_map_without_polygons_holds_nothing(map_):
    points, polys = map_
    assert cover.within_cover(points, cover.cover(polys.where("size(rings) = 0"))).isEmpty()
