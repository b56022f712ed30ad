"""Polygons laid out as cells of a quadtree: inside cells need no test of their sides, cells on a side keep the few sides that matter.

A fixed grid of one cell size suits neither large nor small polygons. Here every polygon is split into ``fan`` parts a side where its sides
run, down to ``depth``; what lies wholly inside stays one large cell. A point asks one cell at each level in use.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import stored
from .spatial import edges_of, inside_edges

#: Sides in all cells of a cover up to which it is sent to every executor: 48 bytes each, so 10 MB.
BROADCAST_SIDES = 200_000


@dataclass(frozen=True)
class Cover:
    """Cells (level, cx, cy, sides, and the polygons' columns), the corner and size of the map, and how cells are split."""

    cells: DataFrame
    x0: float
    y0: float
    width: float
    height: float
    fan: int
    depth: int
    levels: Sequence[int]
    n_cells: int
    n_sides: int


def _meets(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a side meets a closed box: their extents overlap, and the box is not on one side of the line."""
    reach = (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0)
    hand = [(e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) for x in (x0, x1) for y in (y0, y1)]
    return reach & (F.least(*hand) <= 0) & (F.greatest(*hand) >= 0)


def cover(polys: DataFrame, fan: int = 4, depth: int = 5, few: int = 6) -> Cover:
    """Splits polygons (rings, and other columns, which go along) into cells, level by level, each written to the shared folder.

    A cell on a side is split on while it has more than ``few`` sides beside it or is wider than half its polygon, down to ``depth``. Its sides
    are those a ray to the right of a point in it could meet, so tests in a cell are exact and cost no look at the whole polygon.
    Polygons without rings have no cells.
    """
    others = [c for c in polys.columns if c != "rings"]
    sides = polys.select(*others, edges_of(F.col("rings")).alias("sides"))
    xs, ys = F.flatten(F.transform("sides", lambda e: F.array(e["x1"], e["x2"]))), F.flatten(F.transform("sides", lambda e: F.array(e["y1"], e["y2"])))
    sides = sides.withColumns({"_w": F.array_max(xs) - F.array_min(xs), "_h": F.array_max(ys) - F.array_min(ys), "_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})
    box = sides.agg(F.min("_x0"), F.min("_y0"), F.max("_x1"), F.max("_y1")).first()
    x0, y0, x1, y1 = (0.0, 0.0, 1.0, 1.0) if box[0] is None else box
    width, height = (x1 - x0) or 1.0, (y1 - y0) or 1.0
    spare = 1e-9 * max(width, height) + 1e-14 * max(map(abs, (x0, y0, x1, y1)))  # what rounding may move a cell's border by
    open_ = sides.where(F.size("sides") > 0).select(*others, "sides", "_w", "_h", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    done, levels, n_cells, n_sides = [], [], 0, 0
    for level in range(1, depth + 1):
        w, h = width / fan**level, height / fan**level
        parts = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + (fan - 1)))
        kids = open_.withColumn("cx", parts("cx")).withColumn("cy", parts("cy"))
        kids = kids.withColumns({"_x": x0 + F.col("cx") * w, "_y": y0 + F.col("cy") * h})
        left, low, right, high = F.col("_x") - spare, F.col("_y") - spare, F.col("_x") + (w + spare), F.col("_y") + (h + spare)
        beside = lambda e: (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["y1"], e["y2"]) >= low) & (F.greatest(e["x1"], e["x2"]) >= left)  # noqa: B023, E731
        kids = kids.withColumn("sides", F.filter("sides", beside)).where(F.size("sides") > 0)
        kids = kids.withColumn("_cut", F.exists("sides", lambda e: _meets(e, left, low, right, high)))  # noqa: B023
        kids = kids.where(F.col("_cut") | inside_edges(F.col("_x") + w / 2, F.col("_y") + h / 2, F.col("sides")))
        small = (F.size("sides") <= few) & (F.lit(w) <= F.col("_w") / 2) & (F.lit(h) <= F.col("_h") / 2)
        kids = stored(kids.withColumn("_open", F.col("_cut") & ~small & F.lit(level < depth)), f"cover-{level}")
        closed = kids.where(~F.col("_open"))
        sides_left = F.when(F.col("_cut"), F.col("sides")).otherwise(F.slice("sides", 1, 0))
        cells = closed.select(*others, F.lit(level).alias("level"), "cx", "cy", F.col("_cut").alias("cut"), sides_left.alias("sides"))
        n, m, still = kids.agg(F.count_if(~F.col("_open")), F.sum(F.when(F.col("_cut") & ~F.col("_open"), F.size("sides"))), F.count_if("_open")).first()
        if n:
            done.append(cells)
            levels.append(level)
        n_cells, n_sides = n_cells + n, n_sides + (m or 0)
        if not still:
            break
        open_ = kids.where("_open").select(*others, "sides", "_w", "_h", "cx", "cy")
    found = done[0] if done else cells
    for more in done[1:]:
        found = found.unionByName(more)
    return Cover(found, x0, y0, width, height, fan, depth, tuple(levels), n_cells, n_sides)


def within_cover(points: DataFrame, laid: Cover, lon: str = "lon", lat: str = "lat", salt: int = 32, broadcast_sides: int = BROADCAST_SIDES) -> DataFrame:
    """Points with the columns of each polygon that holds them strictly inside; points without a polygon, or without a place, go.

    A cover of few cells and sides is sent to all executors, and the points are not shuffled. A larger one is joined by cell and by one of ``salt`` shares, which the
    hash of a point's columns names, so a busy cell is no single key; the cover, which does not grow with the points, is repeated for each share.
    """
    finest = laid.fan**laid.depth
    there = points.where((F.col(lon) > laid.x0) & (F.col(lon) < laid.x0 + laid.width) & (F.col(lat) > laid.y0) & (F.col(lat) < laid.y0 + laid.height))
    place = lambda c, start, size: F.least(F.floor((F.col(c) - start) / size * finest), F.lit(finest - 1))
    there = there.withColumns({"_mx": place(lon, laid.x0, laid.width), "_my": place(lat, laid.y0, laid.height)})
    asked = there.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in laid.levels]).cast("array<int>")))
    step = F.pow(F.lit(float(laid.fan)), F.lit(laid.depth) - F.col("_level")).cast("long")
    asked = asked.withColumns({"_cx": F.floor(F.col("_mx") / step), "_cy": F.floor(F.col("_my") / step)}).drop("_mx", "_my")
    cells = laid.cells.withColumnsRenamed({"level": "_level", "cx": "_cx", "cy": "_cy", "cut": "_cut", "sides": "_sides"})
    on = ["_level", "_cx", "_cy"]
    if laid.n_cells + laid.n_sides <= broadcast_sides:
        near = asked.join(F.broadcast(cells), on)
    else:
        cells = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        near = asked.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salt)).cast("int")).join(cells, [*on, "_salt"]).drop("_salt")
    held = ~F.col("_cut") | inside_edges(F.col(lon), F.col(lat), F.col("_sides"))
    return near.where(held).drop(*on, "_cut", "_sides")
