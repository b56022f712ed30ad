"""Point-in-polygon joins, contiguity, spatial lags and weighted allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_of(rings: Column) -> Column:
    """All sides of all rings as (x1, y1, x2, y2)."""

    def sides(ring: Column) -> Column:
        following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    return F.flatten(F.transform(rings, sides))


def strictly_inside(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies in the polygon's interior: an odd number of sides cross its ray, and it is on none."""
    return inside_edges(x, y, edges_of(rings))


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """The same of a polygon's sides; sides that lie wholly to the left of the point, above or below it may be left out."""

    def on_side(e: Column) -> Column:
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        box = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return (cross == 0) & box

    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return straddles & (x < at)

    odd = F.aggregate(edges, F.lit(False), lambda inside, e: inside != F.coalesce(crosses(e), F.lit(False)))
    return odd & ~F.exists(edges, on_side)


def _cells(polys: DataFrame, cell: float) -> DataFrame:
    """One row for each grid cell that a polygon's bounding box touches."""
    corners = F.flatten("rings")
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    box = polys.withColumns({"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})
    steps = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return box.withColumn("_cx", F.explode(steps("_x0", "_x1"))).withColumn("_cy", F.explode(steps("_y0", "_y1")))


def within_join(points: DataFrame, polys: DataFrame, cell: float = 0.02, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with the columns of each polygon that holds them strictly inside; points without a polygon go.

    Polygons are laid on a grid, which turns the spatial predicate into an equality join on the cell; a point has one
    cell, so it meets only the polygons near it. Cells of about a polygon's size keep the grid small.
    """
    there = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    there = there.withColumns({"_cx": F.floor(F.col(lon) / cell), "_cy": F.floor(F.col(lat) / cell)})
    near = there.join(_cells(polys, cell), ["_cx", "_cy"])
    near = near.where(F.col(lon).between(F.col("_x0"), F.col("_x1")) & F.col(lat).between(F.col("_y0"), F.col("_y1")))
    found = near.where(strictly_inside(F.col(lon), F.col(lat), F.col("rings")))
    return found.drop("_cx", "_cy", "_x0", "_x1", "_y0", "_y1", "rings")


def fill_area(df: DataFrame, polys: DataFrame, area: str = "nta_id", cell: float = 0.02, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Fills missing area ids by place; rows that have one, or lie nowhere, stay as they are."""
    known, open_ = df.where(F.col(area).isNotNull()), df.where(F.col(area).isNull())
    ids = polys.select(F.col(area).alias("_area"), "rings")
    # a row is filled at most once: the least id of the polygons that hold its place
    places = open_.select(lon, lat).distinct()
    found = within_join(places, ids, cell, lon, lat).groupBy(lon, lat).agg(F.min("_area").alias("_area"))
    filled = open_.join(found, [lon, lat], "left").withColumn(area, F.col("_area")).select(*df.columns)
    return known.unionByName(filled)


def queen_adjacency(polys: DataFrame, key: str = "nta_id", digits: int = 9) -> DataFrame:
    """(key, neighbors): ids of the polygons that share a vertex; a polygon without neighbours has an empty list."""
    pairs = adjacency_edges(polys, key, digits)
    lists = pairs.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))  # a polygon has few neighbours
    empty = F.array().cast("array<string>")
    return polys.select(F.col(key).alias("src")).distinct().join(lists, "src", "left").select(F.col("src").alias(key), F.coalesce("neighbors", empty).alias("neighbors"))


def adjacency_edges(polys: DataFrame, key: str = "nta_id", digits: int = 9) -> DataFrame:
    """(src, dst), in both directions, of polygons that share a vertex."""
    vertex = F.explode(F.flatten("rings")).alias("p")
    v = polys.select(F.col(key).alias("id"), vertex).select("id", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    a, b = v.withColumnRenamed("id", "src"), v.withColumnRenamed("id", "dst")
    return a.join(b, ["x", "y"]).where("src <> dst").select("src", "dst").distinct()


def spatial_lag(panel: DataFrame, edges: DataFrame, measures: Sequence[tuple[str, int, str]], key: str = "nta_id", week: str = "week_start") -> DataFrame:
    """Adds, for each (column, weeks back, name), the mean over neighbours of the column that many weeks earlier.

    Neighbours without a row in that week are left out; areas without neighbours get null.
    """
    out = panel
    for column, back, name in measures:
        of = panel.select(F.col(key).alias("dst"), F.date_add(F.col(week), 7 * back).alias(week), F.col(column).alias("_v"))
        mean = edges.join(of, "dst").groupBy(F.col("src").alias(key), week).agg(F.avg("_v").alias(name))
        out = out.join(mean, [key, week], "left")
    return out


def normalize_crosswalk(df: DataFrame, src: str = "src", weight: str = "weight") -> DataFrame:
    """Weights divided by their sum over each source."""
    total = df.groupBy(src).agg(F.sum(weight).alias("_total"))
    return df.join(total, src).withColumn(weight, F.col(weight) / F.nullif(F.col("_total"), F.lit(0.0))).drop("_total").select(*df.columns)


def allocate(values: DataFrame, crosswalk: DataFrame, value: str = "value", src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """(dst, value): each source's value spread over its targets by weight and summed; unknown sources give no rows."""
    return values.join(crosswalk, src).groupBy(dst).agg(F.sum(F.col(value) * F.col(weight)).alias(value))


def crosswalk_gaps(crosswalk: DataFrame, ids: DataFrame, key: str, tolerance: float = 0.01, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """(kind, id, total): ids that no row of the crosswalk leads to, and sources whose weights don't sum to one."""
    missing = ids.select(F.col(key).alias(dst)).distinct().join(crosswalk.select(dst), dst, "left_anti")
    off = crosswalk.groupBy(src).agg(F.sum(weight).alias("total")).where(F.abs(F.col("total") - 1) > tolerance)
    return missing.select(F.lit("missing").alias("kind"), F.col(dst).alias("id"), F.lit(None).cast("double").alias("total")).unionByName(
        off.select(F.lit("weights").alias("kind"), F.col(src).alias("id"), "total")
    )


def padded_id(*parts: tuple[Column, int]) -> Column:
    """Parts joined, each padded with zeros to its width."""
    return F.concat(*[F.lpad(c.cast("string"), n, "0") for c, n in parts])


def rollup_weighted(values: DataFrame, crosswalk: DataFrame, measures: Sequence[str], src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """Weighted sums of several measures for each target; sources on one side only go."""
    return values.join(crosswalk, src).groupBy(dst).agg(*[F.sum(F.col(m) * F.col(weight)).alias(m) for m in measures])
