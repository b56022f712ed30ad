"""Rates, clipping, deciles and other arithmetic on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degree_days(average: Column, base: float = 18.0) -> tuple[Column, Column]:
    """Heating and cooling degree days of a day's mean temperature; null stays null."""
    heating = F.when(average.isNotNull(), F.round(F.greatest(base - average, F.lit(0.0)), 4))
    cooling = F.when(average.isNotNull(), F.round(F.greatest(average - base, F.lit(0.0)), 4))
    return heating, cooling


def safe_rate(part: Column, whole: Column, scale: int = 4) -> Column:
    """part / whole, rounded; null where whole is 0."""
    return F.round(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), scale)


def indicator(count: Column) -> Column:
    return count > 0


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def round6(x: Column) -> Column:
    return F.round(x, 6)


def risk_tier(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def decile_label(decile: Column) -> Column:
    """A verbal label for deciles 1 to 10."""
    labels = ["very low"] * 2 + ["low"] * 2 + ["moderate"] * 2 + ["high"] * 2 + ["very high"] * 2
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), decile.cast("int"))


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in (least lon, least lat, greatest lon, greatest lat)."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """Share of rows in which all of the columns are present."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(present.cast("int")), 6).alias("coverage"))


def ring_area2(ring: Column) -> Column:
    """Twice the signed area of a ring of (x, y) structs."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)


def polygon_area(rings: Column) -> Column:
    """Area of a polygon: its first ring less the others."""
    areas = F.transform(rings, lambda r: F.abs(ring_area2(r)) / 2)
    return F.when(F.size(rings) > 0, F.aggregate(areas, F.lit(0.0), lambda s, x: s - x) + 2 * F.get(areas, F.lit(0)))


def centroid(rings: Column) -> Column:
    """(lon, lat): the area-weighted centroid over all rings, null without area."""

    def moment(ring: Column, axis: str) -> Column:
        following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        parts = F.zip_with(ring, following, lambda a, b: (a[axis] + b[axis]) * (a["x"] * b["y"] - b["x"] * a["y"]))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    def outer_sign(ring: Column, i: Column) -> Column:
        # the first ring adds, holes take away, whatever way round they are written
        return F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(ring_area2(ring))

    def total(f) -> Column:
        return F.aggregate(F.transform(rings, f), F.lit(0.0), lambda s, x: s + x)

    area2 = total(lambda r, i: outer_sign(r, i) * ring_area2(r))
    x = total(lambda r, i: outer_sign(r, i) * moment(r, "x"))
    y = total(lambda r, i: outer_sign(r, i) * moment(r, "y"))
    return F.when(area2 != 0, F.struct((x / (3 * area2)).alias("lon"), (y / (3 * area2)).alias("lat")))
