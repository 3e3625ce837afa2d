"""Areas cut by areas: convex clipping and shares of nearest-site cells, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import ring_area
from ..storage import stored
from . import spatial

POINTS = "array<struct<x: double, y: double>>"


def half_plane(ring: np.ndarray, nx: float, ny: float, c: float) -> np.ndarray:
    """The part of an open ring (n x 2) where nx * x + ny * y <= c."""
    if not len(ring):
        return ring
    side = ring @ np.array([nx, ny]) - c
    out = []
    for i in range(len(ring)):
        j = (i + 1) % len(ring)
        if side[i] <= 0:
            out.append(ring[i])
        if (side[i] < 0) != (side[j] < 0) and side[i] != side[j] and side[i] != 0 and side[j] != 0:
            out.append(ring[i] + (ring[j] - ring[i]) * side[i] / (side[i] - side[j]))
    return np.array(out).reshape(-1, 2)


def shoelace(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def _open(points) -> np.ndarray:
    ring = np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def clipped(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex window."""
    x, y = window[:, 0], window[:, 1]
    if x @ np.roll(y, -1) - y @ np.roll(x, -1) < 0:
        window = window[::-1]
    for (ax, ay), (bx, by) in zip(window, np.roll(window, -1, axis=0), strict=True):
        nx, ny = by - ay, ax - bx  # outward
        ring = half_plane(ring, nx, ny, nx * ax + ny * ay)
    return ring


def overlap_area(ring: Column, window: Column) -> Column:
    """Area of a ring inside a convex ring; both are arrays of struct<x, y>."""

    @F.pandas_udf("double")
    def area(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else shoelace(clipped(_open(p), _open(q))) for p, q in zip(a, b, strict=True)], dtype="Float64")

    return area(ring, window)


def simplified(points: Column, tolerance: float) -> Column:
    """A line with the points left out that lie within ``tolerance`` of it without them; its ends stay."""

    @F.pandas_udf(POINTS)
    def thin(lines: pd.Series) -> pd.Series:
        out = []
        for line in lines:
            if line is None or len(line) < 3:
                out.append(line if line is None else [{"x": p["x"], "y": p["y"]} for p in line])
                continue
            at = np.array([(p["x"], p["y"]) for p in line], float)
            keep, stack = {0, len(at) - 1}, [(0, len(at) - 1)]
            while stack:
                a, b = stack.pop()
                if b - a < 2:
                    continue
                d, own = at[b] - at[a], at[a + 1 : b] - at[a]
                t = np.clip(own @ d / (d @ d), 0, 1) if d @ d else np.zeros(len(own))
                far = np.hypot(*(own - t[:, None] * d).T)
                i = int(far.argmax())
                if far[i] > tolerance:
                    keep.add(a + 1 + i)
                    stack += [(a, a + 1 + i), (a + 1 + i, b)]
            out.append([{"x": float(at[i][0]), "y": float(at[i][1])} for i in sorted(keep)])
        return pd.Series(out)

    return thin(points)


def overlap_fraction(a: DataFrame, b: DataFrame, a_id: str, cell: float) -> DataFrame:
    """a_id and fraction (at most 1) of each area of ``a`` that the convex areas of ``b`` cover; 0 where none do.

    Both have a column ``ring``; areas of ``b`` do not overlap one another.
    """
    def boxed(df: DataFrame, prefix: str) -> DataFrame:
        along = {"x": F.transform("ring", lambda q: q["x"]), "y": F.transform("ring", lambda q: q["y"])}
        ends = {f"{prefix}{k}{n}": f(v) for k, v in along.items() for n, f in ((1, F.array_min), (2, F.array_max))}
        return df.withColumns(ends).withColumnRenamed("ring", f"{prefix}ring")

    pairs = spatial.boxes_meeting(boxed(a.select(a_id, "ring"), "a"), boxed(b.select("ring"), "b"), cell)
    covered = pairs.groupBy(a_id).agg(F.sum(F.try_divide(overlap_area(F.col("aring"), F.col("bring")), ring_area(F.col("aring")))).alias("f"))
    return a.select(a_id).join(covered, a_id, "left").select(a_id, F.least(F.coalesce("f", F.lit(0.0)), F.lit(1.0)).alias("fraction"))


#: Sites aimed at in a piece of an area.
PIECE_SITES = 16


def _pieces(areas: DataFrame, area: str, size: float) -> DataFrame:
    """piece, area, ring and whole (the area's size): convex areas cut along a grid."""
    along = {"x": F.transform("ring", lambda q: q["x"]), "y": F.transform("ring", lambda q: q["y"])}
    cells = lambda v: F.explode(F.sequence(spatial.cell(F.array_min(v), size), spatial.cell(F.array_max(v), size)))
    dealt = areas.select(area, "ring", ring_area(F.col("ring")).alias("whole"), cells(along["x"]).alias("cx")).select(area, "ring", "whole", "cx", cells(along["y"]).alias("cy"))

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def cut(rings: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        out = []
        for points, x, y in zip(rings, cx, cy, strict=True):
            ring = _open(points)
            for u, v, most in ((-1.0, 0.0, -x * size), (1.0, 0.0, (x + 1) * size), (0.0, -1.0, -y * size), (0.0, 1.0, (y + 1) * size)):
                ring = half_plane(ring, u, v, most) if len(ring) else ring
            out.append([{"x": float(p[0]), "y": float(p[1])} for p in ring])
        return pd.Series(out)

    cut_up = dealt.select(area, "whole", cut("ring", "cx", "cy").alias("ring")).where((F.size("ring") > 2) & (F.col("whole") > 0))
    return stored(cut_up.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def cell_shares(areas: DataFrame, sites: DataFrame, area: str, site: str) -> DataFrame:
    """area, site and share of the convex area that is nearer to the site than to any other site.

    sites: points (bx, by).  Areas are cut into pieces of about PIECE_SITES sites.  No site can own a part of a piece that
    lies further from its middle than the nearest site and twice the piece's reach, so each piece asks for those alone,
    however far they are; pieces of like reach ask together.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    sites = stored(sites.select(site, "bx", "by").where("bx is not null and by is not null"), "sites")
    wide, high = sites.agg(F.max("bx") - F.min("bx"), F.max("by") - F.min("by")).first()
    n = sites.count()
    box = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    extent = max((wide or 0.0) * (high or 0.0), areas.agg(F.sum(box)).first()[0] or 0.0, 1e-9)
    size = math.sqrt(extent * PIECE_SITES / max(1, n))
    pieces = _pieces(areas.select(area, "ring"), area, size)
    middle = pieces.withColumn("ax", (F.array_min(xs) + F.array_max(xs)) / 2).withColumn("ay", (F.array_min(ys) + F.array_max(ys)) / 2)
    far = F.array_max(F.transform("ring", lambda p: F.hypot(p["x"] - F.col("ax"), p["y"] - F.col("ay"))))
    middle = middle.select("piece", "ax", "ay", far.alias("far"))
    first = spatial.nearest(middle.select("piece", "ax", "ay"), sites, "piece", site, size).select("piece", F.col("dist").alias("first"))
    asks = middle.join(first, "piece").withColumn("reach", (F.col("first") + 2 * F.col("far")) * (1 + 1e-9))
    asks = stored(asks.withColumn("step", F.greatest(F.ceil(F.log2(F.col("reach") / size)), F.lit(0)).cast("int")), "asks")
    near = None
    for (step,) in asks.select("step").distinct().collect():  # powers of two: a few
        one = spatial.within_distance(asks.where(F.col("step") == step).select("piece", "ax", "ay", "reach"), sites, size * 2.0**step).where("dist <= reach").select("piece", site, "bx", "by")
        near = one if near is None else near.union(one)
    if near is None:
        none = F.lit(None).cast(sites.schema[site].dataType).alias(site)
        return areas.select(area, none, F.lit(0.0).alias("share")).limit(0)
    held = near.groupBy("piece").agg(F.collect_list(F.struct(F.col(site).alias("site"), "bx", "by")).alias("sites")).join(pieces, "piece")

    @F.pandas_udf("array<double>")
    def owned(rings: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for points, own in zip(rings, lists, strict=True):
            ring, at, got = _open(points), np.array([(s["bx"], s["by"]) for s in own]), []
            for i, (x, y) in enumerate(at):
                part, apart = ring, np.hypot(at[:, 0] - x, at[:, 1] - y)
                for j in np.argsort(apart, kind="stable").tolist():
                    if not len(part) or apart[j] / 2 > np.hypot(part[:, 0] - x, part[:, 1] - y).max():
                        break  # no site so far away cuts what is left
                    if j != i:
                        u, v = at[j]
                        part = half_plane(part, u - x, v - y, (u * u + v * v - x * x - y * y) / 2)
                got.append(shoelace(part))
            out.append(got)
        return pd.Series(out)

    each = held.withColumn("owned", owned("ring", "sites")).select(area, "whole", F.explode(F.arrays_zip("sites", "owned")).alias("z"))
    each = each.where("z.owned > 0").groupBy(area, F.col("z.sites.site").alias(site)).agg((F.sum("z.owned") / F.max("whole")).alias("share"))
    return each.select(area, site, "share")
