"""Planar geometry as column expressions: points are x and y columns, lines and rings arrays of struct<x, y>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# NAD83 / Puerto Rico & Virgin Is. (EPSG 32161), a Lambert conformal conic projection on GRS80.
LCC = {"lat1": 18.0333333333333, "lat2": 18.4333333333333, "lat0": 17.8333333333333, "lon0": -66.4333333333333, "x0": 200000.0, "y0": 200000.0}
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def finite(x: Column, y: Column, limit: float = 1e10) -> Column:
    return F.coalesce(x.between(-limit, limit) & y.between(-limit, limit) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def _edges(points: Column) -> Column:
    """struct<a, b> of neighbouring points."""
    n = F.size(points)
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray cast to the right; points on the lower and left edge are inside, on the upper and right edge outside.

    The ring is closed: its last point is its first.
    """
    crossings = F.filter(
        _edges(ring),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < F.try_divide((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(crossings) % 2 == 1


def ring_repaired(ring: Column) -> Column:
    """The ring without points that are not finite or repeat the one before, closed; NULL where no area is left."""
    good = F.filter(ring, lambda p: finite(p["x"], p["y"]))
    apart = F.filter(good, lambda p, i: (i == 0) | (p != F.get(good, F.greatest(i - 1, F.lit(0)))))
    ends_apart = F.get(apart, F.lit(0)) != F.get(apart, F.size(apart) - 1)
    closed = F.when(ends_apart, F.concat(apart, F.slice(apart, F.lit(1), F.lit(1)))).otherwise(apart)
    return F.when((F.size(closed) >= 4) & (ring_area(closed) > 0), closed)


def ring_valid(ring: Column) -> Column:
    """Whether a ring is closed, has at least four points, all finite and none repeating the one before, and an area."""
    return F.coalesce(ring_repaired(ring).eqNullSafe(ring) & ring.isNotNull(), F.lit(False))


def line_length(points: Column) -> Column:
    return F.aggregate(_edges(points), F.lit(0.0), lambda s, e: s + distance(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def ring_area(ring: Column) -> Column:
    """Shoelace area, positive either way round."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


def ring_centroid(ring: Column) -> Column:
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    along = lambda axis: F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"][axis] + e["b"][axis]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.struct(F.try_divide(along("x"), 3 * twice).alias("x"), F.try_divide(along("y"), 3 * twice).alias("y"))


def segment_distance(x: Column, y: Column, points: Column) -> Column:
    """Distance of a point to a line."""

    def one(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return distance(x, y, e["a"]["x"] + t * dx, e["a"]["y"] + t * dy)

    return F.array_min(F.transform(_edges(points), one))


def box_overlap(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    wide, high = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def lambert(lon: Column, lat: Column, p: dict[str, float] = LCC) -> tuple[Column, Column]:
    """Metres of longitude and latitude in a two-parallel conformal conic projection."""
    e = math.sqrt(2 * GRS80_F - GRS80_F**2)
    m = lambda f: math.cos(f) / math.sqrt(1 - (e * math.sin(f)) ** 2)
    t = lambda f: math.tan(math.pi / 4 - f / 2) / ((1 - e * math.sin(f)) / (1 + e * math.sin(f))) ** (e / 2)
    f1, f2, f0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    n = math.log(m(f1) / m(f2)) / math.log(t(f1) / t(f2))
    scale = GRS80_A * m(f1) / (n * t(f1) ** n)
    f = F.radians(lat)
    s = F.sin(f) * e
    tf = F.tan(F.lit(math.pi / 4) - f / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho, theta = F.pow(tf, F.lit(n)) * scale, (F.radians(lon) - math.radians(p["lon0"])) * n
    return rho * F.sin(theta) + p["x0"], F.lit(scale * t(f0) ** n) - rho * F.cos(theta) + p["y0"]


def lambert_inverse(x: Column, y: Column, p: dict[str, float] = LCC) -> tuple[Column, Column]:
    """Longitude and latitude of metres of ``lambert``; the latitude is taken closer five times, which leaves below 1e-10 degrees."""
    e = math.sqrt(2 * GRS80_F - GRS80_F**2)
    m = lambda f: math.cos(f) / math.sqrt(1 - (e * math.sin(f)) ** 2)
    t = lambda f: math.tan(math.pi / 4 - f / 2) / ((1 - e * math.sin(f)) / (1 + e * math.sin(f))) ** (e / 2)
    f1, f2, f0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    n = math.log(m(f1) / m(f2)) / math.log(t(f1) / t(f2))
    scale = GRS80_A * m(f1) / (n * t(f1) ** n)
    east, south = x - p["x0"], F.lit(scale * t(f0) ** n) - (y - p["y0"])
    own = F.pow(F.hypot(east, south) / scale, F.lit(1 / n))
    lat = F.lit(math.pi / 2) - 2 * F.atan(own)
    for _ in range(5):
        s = F.sin(lat) * e
        lat = F.lit(math.pi / 2) - 2 * F.atan(own * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return F.degrees(F.atan2(east, south) / n) + p["lon0"], F.degrees(lat)


def terrain_rgb(height: Column) -> Column:
    """struct<r, g, b> of (height + 10000) / 0.1 in 24 bits."""
    code = F.greatest(F.round((height + 10000) * 10, 0), F.lit(0.0)).cast("int")
    return F.struct(F.shiftright(code, 16).bitwiseAND(F.lit(255)).alias("r"), F.shiftright(code, 8).bitwiseAND(F.lit(255)).alias("g"), code.bitwiseAND(F.lit(255)).alias("b"))
