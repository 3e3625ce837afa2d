"""Spatial joins on grid cells: an equi-join on cells bounds the candidates, an exact predicate decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance, ring_contains
from ..storage import stored
from . import held


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _cells(df: DataFrame, low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> DataFrame:
    """A row per cell that a box touches."""
    return df.withColumn("_cx", F.explode(F.sequence(cell(low_x, size), cell(high_x, size)))).withColumn("_cy", F.explode(F.sequence(cell(low_y, size), cell(high_y, size))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, x: str = "x", y: str = "y", how: str = "inner") -> DataFrame:
    """Points joined to the boxes (x1, y1, x2, y2; upper edges outside) that they lie in."""
    dealt = _cells(boxes, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size)
    own = points.withColumn("_cx", cell(F.col(x), size)).withColumn("_cy", cell(F.col(y), size))
    inside = (own["_cx"] == dealt["_cx"]) & (own["_cy"] == dealt["_cy"]) & (own[x] >= dealt["x1"]) & (own[x] < dealt["x2"]) & (own[y] >= dealt["y1"]) & (own[y] < dealt["y2"])
    return own.join(dealt, inside, how).drop("_cx", "_cy")


def points_in_rings(points: DataFrame, areas: DataFrame, size: float, ring: str = "ring", x: str = "x", y: str = "y") -> DataFrame:
    """Points joined to the areas whose closed ring contains them."""
    along = lambda axis: F.transform(ring, lambda p: p[axis])
    dealt = _cells(areas, F.array_min(along("x")), F.array_min(along("y")), F.array_max(along("x")), F.array_max(along("y")), size)
    own = points.withColumn("_cx", cell(F.col(x), size)).withColumn("_cy", cell(F.col(y), size))
    return own.join(dealt, ["_cx", "_cy"]).where(ring_contains(F.col(ring), F.col(x), F.col(y))).drop("_cx", "_cy")


def boxes_meeting(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes (ax1.. and bx1..) that overlap, each once: in the first cell that both touch."""
    left = _cells(a, F.col("ax1"), F.col("ay1"), F.col("ax2"), F.col("ay2"), size)
    right = _cells(b, F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2"), size)
    both = left.join(right, ["_cx", "_cy"])
    once = (F.col("_cx") == F.greatest(cell(F.col("ax1"), size), cell(F.col("bx1"), size))) & (F.col("_cy") == F.greatest(cell(F.col("ay1"), size), cell(F.col("by1"), size)))
    meets = (F.col("ax1") < F.col("bx2")) & (F.col("bx1") < F.col("ax2")) & (F.col("ay1") < F.col("by2")) & (F.col("by1") < F.col("ay2"))
    return both.where(once & meets).drop("_cx", "_cy")


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Lines (x1, y1, x2, y2) joined to the boxes (bx1..) they run through, with ``length``, the length inside."""
    left = _cells(lines, F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), size)
    right = _cells(boxes, F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2"), size)
    both = left.join(right, ["_cx", "_cy"])
    enter, leave = F.lit(0.0), F.lit(1.0)
    for axis in "xy":
        start, step, low, high = F.col(f"{axis}1"), F.col(f"{axis}2") - F.col(f"{axis}1"), F.col(f"b{axis}1"), F.col(f"b{axis}2")
        a, b = F.try_divide(low - start, step), F.try_divide(high - start, step)
        out = (step == 0) & ((start < low) | (start > high))
        enter = F.greatest(enter, F.least(a, b), F.when(out, F.lit(2.0)))
        leave = F.least(leave, F.greatest(a, b))
    # once: in the first cell that both touch
    once = (F.col("_cx") == F.greatest(cell(F.least("x1", "x2"), size), cell(F.col("bx1"), size))) & (F.col("_cy") == F.greatest(cell(F.least("y1", "y2"), size), cell(F.col("by1"), size)))
    whole = distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return both.where(once).withColumn("length", (leave - enter) * whole).where("length > 0").drop("_cx", "_cy")


def within_distance(a: DataFrame, b: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points (ax, ay) and (bx, by) with equal keys at most ``radius`` apart, with ``dist``; cells are as wide as the radius."""
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    left = a.withColumn("_cx", cell(F.col("ax"), radius)).withColumn("_cy", cell(F.col("ay"), radius))
    right = b.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumn("_cx", cell(F.col("bx"), radius) + F.col("_dx")).withColumn("_cy", cell(F.col("by"), radius) + F.col("_dy")).drop("_dx", "_dy")
    return left.join(right, ["_cx", "_cy", *keys]).withColumn("dist", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("dist") <= radius).drop("_cx", "_cy")


def nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, radius: float, bounded: bool = False, keys: tuple[str, ...] = (), most: int = 1, held_points: int = held.HELD_POINTS) -> DataFrame:
    """a_id, b_id and dist of the nearest b (with the same keys) of each a (a row an id), ties to the lesser b_id.

    Bounded: only within ``radius``; rows without one get NULLs.  Rows whose keys no b has drop out, and so do those
    without a place.  Few points b (``held_points``, counted first) are sent to the tasks (``held``).  Of more, those in
    reach are looked through by cells; the first reach is such that a cell has few, and it doubles for rows that found
    nothing; a row found within the reach can have no nearer one beyond it.
    most: so many of the nearest, only where bounded.
    """
    if most > 1 and not bounded:
        raise ValueError("several of the nearest only within a radius")
    known = lambda x, y: (F.col(x) - F.col(x) == 0) & (F.col(y) - F.col(y) == 0)
    b = b.where(known("bx", "by"))
    low, high = (lambda c: F.min(c).alias(f"{c}1")), (lambda c: F.max(c).alias(f"{c}2"))
    own = b.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*keys)).alias("kinds") if keys else F.lit(1).alias("kinds"), low("bx"), high("bx"), low("by"), high("by")).first()
    if own["n"] <= held_points:
        return held.nearest(a, b, a_id, b_id, radius if bounded else float("inf"), keys, most, bounded)
    wide, each = max(own["bx2"] - own["bx1"], own["by2"] - own["by1"]), own["n"] / own["kinds"] / most
    left, found, reach = a.where(known("ax", "ay")), None, min(radius, wide / each**0.5 or radius)
    if keys and not bounded:
        left = left.join(b.select(*keys).distinct(), [*keys], "left_semi")
    while True:
        last = bounded and reach >= radius
        pairs = within_distance(left, b, min(reach, radius) if bounded else reach, keys).groupBy(a_id)
        best = F.array(F.min(F.struct("dist", b_id))) if most == 1 else F.slice(F.array_sort(F.collect_list(F.struct("dist", b_id))), 1, most)
        got = pairs.agg(best.alias("_all")).where(F.lit(last) | (F.size("_all") >= most)).select(a_id, F.explode("_all").alias("_best"))
        got = stored(got.select(a_id, F.col(f"_best.{b_id}").alias(b_id), F.col("_best.dist").alias("dist")), "nearest")
        found = got if found is None else found.union(got)
        if last:
            return a.select(a_id).join(found, a_id, "left")
        left = stored(left.join(got, a_id, "left_anti"), "unplaced")
        if left.isEmpty():
            return a.select(a_id).join(found, a_id, "left") if bounded else found
        reach *= 2


def nearest_by_group(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str, radius: float = 1000.0) -> DataFrame:
    """The nearest b of each a among those with the same keys; a key's points are looked through by cells."""
    return nearest(a, b, a_id, b_id, radius, keys=tuple(keys))
