"""Overlay of areas of any shape: who meets whom, areas in common, shares covered, unions as rings.

An area is a list of rings by the even-odd rule, so holes, several parts and any direction of points are the same to it.
Coordinates are snapped to a grid of ``unit``; edges are dealt to square cells whose borders lie half a unit beside the grid,
so no point lies on a border.  A cell's task cuts its edges where they cross or touch (signs are exact, crossings are
rounded to a fine grid) and says of both sides of every piece which areas are there: from the cell's lower left corner,
by counting crossings.  Which areas hold the corner comes from the crossings of each area with the cell's lower border line,
as ranges of columns that only cells with edges are looked up in, through dyadic nodes.

Areas in common are then sums over pieces (a cell adds its part, borders of cells add nothing), so a large area costs what
its outline costs, and no cell inside it is listed.  The union's outline is the pieces with one side covered; at each
node they are joined so that the covered side stays on the left, and the cycles are the rings.

Cells with over MOST_EDGES edges are split by SPLIT in both directions until none is left or a cell is a unit wide.

Of two tables, edges are cut only where what is asked of them can change (``cuts``): areas of one table that are not asked
about each other cross freely, so pieces do not grow with the square of how densely they lie.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from . import graph

MOST_EDGES, SPLIT = 600, 4
#: Crossings are rounded to this part of a unit.
FINE = 65536.0


def edges(areas: DataFrame, area: str, unit: float, rings: str = "rings") -> DataFrame:
    """area, x1, y1, x2, y2: edges between points in order, in whole units; those an area has twice are none."""
    ring = areas.select(F.col(area).alias("area"), F.explode(rings).alias("ring")).where(F.size("ring") > 2)
    point = lambda p: F.struct(F.round(p["x"] / unit).cast("long").alias("x"), F.round(p["y"] / unit).cast("long").alias("y"))
    ring = ring.select("area", F.transform("ring", point).alias("a"))
    after = F.concat(F.slice("a", 2, F.size("a")), F.slice("a", 1, 1))
    both = ring.select("area", F.explode(F.arrays_zip("a", after.alias("b"))).alias("e")).select("area", F.least("e.a", "e.b").alias("p"), F.greatest("e.a", "e.b").alias("q")).where("p <> q")
    odd = both.groupBy("area", "p", "q").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return odd.select("area", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def _cell(value: str, size: int) -> str:
    return f"cast(floor(({value}) / {size}) as long)"


def _dealt(of: DataFrame, size: int) -> DataFrame:
    """Edges with the row and column of each cell that they are in."""
    rows = of.withColumn("row", F.expr(f"explode(sequence({_cell('least(y1, y2)', size)}, {_cell('greatest(y1, y2)', size)}))"))
    at = lambda y: f"case when y1 = y2 then {{}} else x1 + ({y} - y1) * (x2 - x1) / cast(y2 - y1 as double) end"
    low, high = f"greatest(least(y1, y2), row * {size} - 0.5D)", f"least(greatest(y1, y2), (row + 1) * {size} - 0.5D)"
    rows = rows.withColumns({"_a": F.expr(at(low).format("x1")), "_b": F.expr(at(high).format("x2"))})
    columns = F.expr(f"explode(sequence({_cell('least(_a, _b) + 0.5D', size)}, {_cell('greatest(_a, _b) + 0.5D', size)}))")
    return rows.withColumn("column", columns).drop("_a", "_b")


def _corners(of: DataFrame, wanted: list[DataFrame], size: int, key: list[str]) -> DataFrame:
    """key, row, column of the cells whose lower left corner lies in an area; only of the wanted cells (some of the key, row, column)."""
    lines = of.withColumn("row", F.expr(f"explode(case when {_cell('least(y1, y2)', size)} < {_cell('greatest(y1, y2)', size)} then sequence({_cell('least(y1, y2)', size)} + 1, {_cell('greatest(y1, y2)', size)}) end)"))
    x = F.expr(f"round((x1 + (row * {size} - 0.5D - y1) * (x2 - x1) / cast(y2 - y1 as double)) * {FINE}D) / {FINE}D")
    order = Window.partitionBy(*key, "row").orderBy("x")
    lines = lines.select(*key, "row", x.alias("x")).withColumns({"k": F.row_number().over(order), "to": F.lead("x").over(order)}).where("k % 2 = 1")
    spans = lines.select(*key, "row", F.expr(f"{_cell('x + 0.5D', size)} + 1").alias("a"), F.expr(_cell("to + 0.5D", size)).alias("z")).where("a <= z")
    spans = stored(spans, "spans")
    depth = max(1, int(spans.agg(F.max(F.col("z") - F.col("a") + 1)).first()[0] or 1).bit_length())
    start = F.struct(F.col("a").alias("a"), F.col("z").alias("z"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))

    def step(s, level):
        node = lambda when, n: F.when(when, F.array(F.struct(level.cast("int").alias("level"), n.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
        open_, first, last = s["a"] <= s["z"], F.pmod(s["a"], F.lit(2)) == 1, F.pmod(s["z"], F.lit(2)) == 0
        nodes = F.concat(s["nodes"], node(open_ & first, s["a"]), node(open_ & last & ((s["z"] > s["a"]) | ~first), s["z"]))
        return F.struct(F.shiftright(s["a"] + F.when(first, 1).otherwise(0), 1).alias("a"), F.shiftright(s["z"] - F.when(last, 1).otherwise(0), 1).alias("z"), nodes.alias("nodes"))

    spans = spans.select(*key, "row", F.inline(F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step)["nodes"]))
    levels, out = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), None
    for cells in wanted:
        group = [c for c in cells.columns if c not in ("row", "column")]
        nodes = cells.select(*group, "row", "column", levels).withColumn("node", F.expr("shiftright(column, level)"))
        found = spans.join(nodes, [*group, "row", "level", "node"]).select(*key, "row", "column")
        out = found if out is None else out.union(found)
    return out if len(wanted) == 1 else out.distinct()


def _of_interest(dealt: DataFrame) -> list[DataFrame]:
    """Cells in which it counts whether an area of two sides holds the corner: those with edges of its own or of the other side."""
    own = dealt.select("side", "area", "row", "column").distinct()
    return [own, dealt.select((1 - F.col("side")).alias("side"), "row", "column").distinct()]


class Cell:
    """The pieces that the edges of one cell are cut into, and the areas on both sides of each.

    pieces: x1, y1, x2, y2, from left to right or upwards; above and below: (pieces, areas), of upright pieces the west
    and the east.
    """

    def __init__(self, xy: np.ndarray, area: np.ndarray, n_areas: int, corner: np.ndarray, row: int, column: int, size: int, cuts: np.ndarray | None = None) -> None:
        self.x0, self.y0 = column * size - 0.5, row * size - 0.5
        self.x1, self.y1, self.cuts = self.x0 + size, self.y0 + size, cuts
        which = ~np.eye(len(xy), dtype=bool) if cuts is None else cuts[np.ix_(area, area)] & ~np.eye(len(xy), dtype=bool)
        e, at = _cut(xy, *np.nonzero(which), (self.x0, self.y0, self.x1, self.y1))
        pieces, self.of = np.unique(e, axis=0, return_inverse=True) if len(e) else (np.zeros((0, 4)), np.zeros(0, int))
        self.of = self.of.reshape(-1)
        self.pieces = pieces
        owns = np.zeros((len(pieces), n_areas), np.int64)
        np.add.at(owns, (self.of, area[at]), 1)
        self.owns = owns % 2 == 1
        on = np.zeros((len(pieces), len(xy)), bool)
        on[self.of, at] = True
        middle = (pieces[:, :2] + pieces[:, 2:]) / 2
        x1, y1, x2, y2 = (xy[:, i].astype(float) for i in range(4))
        with np.errstate(divide="ignore", invalid="ignore"):
            y = y1 + (middle[:, :1] - x1) * ((y2 - y1) / (x2 - x1))
            bottom = np.rint((x1 + (self.y0 - y1) * (x2 - x1) / (y2 - y1)) * FINE) / FINE
        # from the corner along the border to just right of the middle, then up to just below it
        through = (np.minimum(y1, y2) < self.y0) & (self.y0 < np.maximum(y1, y2))
        before = bottom <= middle[:, :1]
        lower = np.where(through, np.where(y2 > y1, before, ~before), np.minimum(y1, y2) > self.y0)
        under = (x1 <= middle[:, :1]) & (middle[:, :1] < x2) & ~on & lower & (y < middle[:, 1:])
        crossed = under.astype(np.int64) + (through & (bottom >= self.x0) & before)
        counts = np.zeros((len(pieces), n_areas), np.int64)
        if len(area):
            order = np.argsort(area, kind="stable")
            known, starts = np.unique(area[order], return_index=True)
            counts[:, known] = np.add.reduceat(crossed[:, order], starts, axis=1)
        self.below = (counts + corner) % 2 == 1
        self.above = self.below ^ self.owns
        #: Twice the area below a piece and above y = 0, as it is added where the area is below.
        self.weight = (pieces[:, 1] + pieces[:, 3]) / 2 * (pieces[:, 2] - pieces[:, 0])

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Area in common, of each of some areas and each of some others, as far as this cell adds to it."""
        return (self.below[:, left] * self.weight[:, None]).T @ self.below[:, right].astype(float) - (self.above[:, left] * self.weight[:, None]).T @ self.above[:, right].astype(float)

    def touch(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(left, right): some piece or its ends belong to both."""
        on = (self.above | self.below | self.owns).astype(float)
        if self.cuts is not None:  # of areas that do not cut a piece nothing is known at its ends
            on *= self.owns.astype(float) @ self.cuts > 0
        ends, at = np.unique(np.concatenate([self.pieces[:, :2], self.pieces[:, 2:]]), axis=0, return_inverse=True)
        nodes = np.zeros((len(ends), on.shape[1]))
        np.maximum.at(nodes, at.reshape(-1), np.concatenate([on, on]))
        return nodes[:, left].T @ nodes[:, right] > 0


def _cut(xy: np.ndarray, i: np.ndarray, j: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces within a box, and the edge of each; edge i is cut by edge j, and j by i (both stand in the pairs)."""
    a, b = xy[:, :2], xy[:, 2:]
    d, (x0, y0, x1, y1) = b - a, box
    points, whose = [a, b], [np.arange(len(xy))] * 2
    with np.errstate(divide="ignore", invalid="ignore"):
        for line in (x0, x1):
            hit = np.flatnonzero((a[:, 0] < line) & (line < b[:, 0]))
            y = a[hit, 1] + (line - a[hit, 0]) * d[hit, 1] / d[hit, 0]
            points.append(np.stack([np.full(len(hit), line), np.rint(y * FINE) / FINE], axis=1))
            whose.append(hit)
        for line in (y0, y1):
            hit = np.flatnonzero((np.minimum(a[:, 1], b[:, 1]) < line) & (line < np.maximum(a[:, 1], b[:, 1])))
            x = a[hit, 0] + (line - a[hit, 1]) * d[hit, 0] / d[hit, 1]
            points.append(np.stack([np.rint(x * FINE) / FINE, np.full(len(hit), line)], axis=1))
            whose.append(hit)
    side = lambda i, p: d[i, 0] * (p[:, 1] - a[i, 1]) - d[i, 1] * (p[:, 0] - a[i, 0])
    to_a, to_b = side(i, a[j]), side(i, b[j])  # of edge i: ends of edge j
    met = np.flatnonzero((i < j) & (np.sign(to_a) * np.sign(to_b) < 0))
    from_a, from_b = side(j[met], a[i[met]]), side(j[met], b[i[met]])
    both = np.sign(from_a) * np.sign(from_b) < 0
    k, t = met[both], from_a[both] / (from_a[both] - from_b[both])
    p = np.rint((a[i[k]] + d[i[k]] * t[:, None]) * FINE) / FINE
    points += [p, p]
    whose += [i[k], j[k]]
    low, high = np.minimum(a, b), np.maximum(a, b)
    for ends, off in ((a, to_a), (b, to_b)):
        k = np.flatnonzero(off == 0)
        k = k[((ends[j[k]] >= low[i[k]]) & (ends[j[k]] <= high[i[k]])).all(axis=1)]
        points.append(ends[j[k]])
        whose.append(i[k])
    p, k = np.concatenate(points).astype(float), np.concatenate(whose)
    along = np.flatnonzero((to_a == 0) & (to_b == 0))
    if len(along):  # edges along each other are cut at the same points, so that their pieces are the same
        i, j = i[along], j[along]
        order, starts = np.argsort(k, kind="stable"), np.searchsorted(np.sort(k), np.arange(len(xy) + 1))
        many = starts[i + 1] - starts[i]
        of = np.repeat(np.arange(len(i)), many)
        at = order[starts[i][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)]
        on = ((p[at] >= low[j[of]]) & (p[at] <= high[j[of]])).all(axis=1)
        p, k = np.concatenate([p, p[at[on]]]), np.concatenate([k, j[of[on]]])
    inside = (p[:, 0] >= x0) & (p[:, 0] <= x1) & (p[:, 1] >= y0) & (p[:, 1] <= y1)
    p, k = p[inside], k[inside]
    order = np.lexsort((((p - a[k]) * d[k]).sum(axis=1), k))
    p, k = p[order], k[order]
    joined = (k[1:] == k[:-1]) & (p[1:] != p[:-1]).any(axis=1)
    e = np.concatenate([p[:-1], p[1:]], axis=1)[joined]
    turned = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e[turned] = e[turned][:, [2, 3, 0, 1]]
    return e, k[:-1][joined]


def _each_with(of: np.ndarray, starts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every i with each number of the range that ``of[i]`` has."""
    i = np.repeat(np.arange(len(of)), many[of])
    return i, starts[of][i] + np.arange(len(i)) - np.repeat(np.cumsum(many[of]) - many[of], many[of])


def _signed(xy: np.ndarray, area: np.ndarray, n_areas: int, corner: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (not upright), the area of each, 1 where it lies below the piece and -1 where above, and whether it is of the cell's lower border.

    Each area is looked at alone.  With the stretches of the lower border that lie in an area, at any place in the cell the area is
    there if minus the sum over the pieces below the place is 1.
    """
    order = np.argsort(area, kind="stable")
    xy, area = xy[order], area[order]
    many = np.bincount(area, minlength=n_areas)
    starts, (x0, y0, x1, _) = np.cumsum(many) - many, box
    i, j = _each_with(area, starts, many)
    e, k = _cut(xy, i[i != j], j[i != j], box)
    of = area[k]
    by = np.lexsort((*e.T, of))
    e, k, of = e[by], k[by], of[by]
    first = np.r_[True, (e[1:] != e[:-1]).any(axis=1) | (of[1:] != of[:-1])][: len(e)]
    piece = np.cumsum(first) - 1  # an area's edges along each other have the same pieces
    odd = np.bincount(piece, minlength=0) % 2 == 1
    p, whose = e[first], of[first]
    ours, flat = np.unique(piece * len(xy) + k), np.flatnonzero(odd & (p[:, 0] < p[:, 2])) if len(p) else np.zeros(0, int)
    m, j = _each_with(whose[flat], starts, many)
    middle = (p[flat, :2] + p[flat, 2:])[m] / 2
    ax, ay, bx, by = (xy[j, c].astype(float) for c in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        y = ay + (middle[:, 0] - ax) * ((by - ay) / (bx - ax))
        bottom = np.rint((ax + (y0 - ay) * (bx - ax) / (by - ay)) * FINE) / FINE
    through = (np.minimum(ay, by) < y0) & (y0 < np.maximum(ay, by))
    before = bottom <= middle[:, 0]
    lower = np.where(through, np.where(by > ay, before, ~before), np.minimum(ay, by) > y0)
    code = flat[m] * len(xy) + j
    on = ours[np.minimum(np.searchsorted(ours, code), max(len(ours) - 1, 0))] == code if len(code) else np.zeros(0, bool)
    under = (ax <= middle[:, 0]) & (middle[:, 0] < bx) & ~on & lower & (y < middle[:, 1])
    crossed = under.astype(np.int64) + (through & (bottom >= x0) & before)
    inside = (np.bincount(m, crossed, len(flat)).astype(np.int64) + corner[whose[flat]]) % 2 == 1
    ax, ay, bx, by = (xy[:, c].astype(float) for c in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        bottom = np.rint((ax + (y0 - ay) * (bx - ax) / (by - ay)) * FINE) / FINE
    hit = np.flatnonzero((np.minimum(ay, by) < y0) & (y0 < np.maximum(ay, by)) & (bottom >= x0) & (bottom <= x1))
    held = np.flatnonzero(corner % 2)
    where, at = np.r_[area[hit], held], np.r_[bottom[hit], np.full(len(held), x0)]
    rest = np.flatnonzero(np.bincount(where, minlength=n_areas) % 2)
    where, at = np.r_[where, rest], np.r_[at, np.full(len(rest), x1)]
    order = np.lexsort((at, where))
    where, at = where[order], at[order]
    base = np.stack([at[0::2], np.full(len(at) // 2, y0), at[1::2], np.full(len(at) // 2, y0)], axis=1)
    wide = base[:, 0] < base[:, 2]
    pieces = np.concatenate([p[flat], base[wide]])
    return pieces, np.r_[whose[flat], where[0::2][wide]], np.r_[np.where(inside, 1.0, -1.0), np.full(wide.sum(), -1.0)], np.r_[np.zeros(len(flat), bool), np.ones(wide.sum(), bool)]


class Held:
    """How many areas of level pieces are at each place of a cell (or whether any is), summed from there to the upper border and from the left."""

    def __init__(self, pieces: np.ndarray, sign: np.ndarray, box: tuple[float, float, float, float], once: bool) -> None:
        x0, y0, x1, y1 = box
        self.xs, self.ys = np.unique(np.r_[x0, pieces[:, 0], pieces[:, 2]]), np.unique(np.r_[y0, pieces[:, 1]])
        v = np.zeros((len(self.xs), len(self.ys)))
        row = np.searchsorted(self.ys, pieces[:, 1])
        np.add.at(v, (np.searchsorted(self.xs, pieces[:, 0]), row), -sign)
        np.add.at(v, (np.searchsorted(self.xs, pieces[:, 2]), row), sign)
        v = np.rint(v.cumsum(axis=0).cumsum(axis=1))
        self.v = np.minimum(v, 1.0) if once else v
        high = (self.v * np.diff(np.r_[self.ys, y1]))[:, ::-1].cumsum(axis=1)[:, ::-1]
        wide = np.diff(np.r_[self.xs, max(x1, self.xs[-1])])[:, None]
        before = lambda w: np.concatenate([np.zeros((1, w.shape[1])), (w * wide).cumsum(axis=0)[:-1]])
        self.high, self.all_high, self.all_v = high, before(high), before(self.v)

    def upto(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Left of x and above y."""
        i, j = np.searchsorted(self.xs, x, "right") - 1, np.searchsorted(self.ys, y, "right") - 1
        right, up = x - self.xs[i], y - self.ys[j]
        return self.all_high[i, j] + right * self.high[i, j] - up * (self.all_v[i, j] + right * self.v[i, j])

    def along(self, x: np.ndarray, top: bool) -> np.ndarray:
        """Left of x along the upper or lower border."""
        i, j = np.searchsorted(self.xs, x, "right") - 1, len(self.ys) - 1 if top else 0
        return self.all_v[i, j] + (x - self.xs[i]) * self.v[i, j]


def _above_both(e: np.ndarray, f: np.ndarray, top: float) -> np.ndarray:
    """(e, f): area above both pieces and below ``top``, as far as they lie over each other."""
    low, high = np.maximum(e[:, None, 0], f[None, :, 0]), np.minimum(e[:, None, 2], f[None, :, 2])
    wide = np.maximum(high - low, 0.0)
    at = lambda p, x: p[..., 1] + (x - p[..., 0]) * ((p[..., 3] - p[..., 1]) / (p[..., 2] - p[..., 0]))
    e1, e2, f1, f2 = at(e[:, None], low), at(e[:, None], high), at(f[None], low), at(f[None], high)
    d1, d2 = e1 - f1, e2 - f2
    both = np.abs(d1) + np.abs(d2)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(d1 * d2 >= 0, both / 2, (d1 * d1 + d2 * d2) / (2 * both))
    return wide * (top - (e1 + e2 + f1 + f2) / 4 - apart / 2)


def _sums(left, right, n: int, box: tuple[float, float, float, float], once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of each left area: what it has in common with the right ones (summed, or with any of them) in a cell, and as the cell adds to the whole.

    left, right: as ``_signed`` gives them.  The second is the first without what the cell's borders would add, so cells without edges need not be
    looked at.  Any of them (``once``): of level pieces only.
    """
    (e, area, s, base), (f, _, g, floor), (_, y0, _, y1) = left, right, box
    flat, level = f[:, 1] == f[:, 3], e[:, 1] == e[:, 3]
    held = Held(f[flat], g[flat], box, once)
    value = np.zeros(n) + np.bincount(area[level], -s[level] * (held.upto(e[level, 2], e[level, 1]) - held.upto(e[level, 0], e[level, 1])), n)
    top = np.zeros(n) + np.bincount(area, -s * (held.along(e[:, 2], True) - held.along(e[:, 0], True)), n)
    bottom = np.bincount(area[base], held.along(e[base, 2], False) - held.along(e[base, 0], False), n)
    for mine, theirs in ((level, ~flat), (~level, flat), (~level, ~flat)):
        mine, theirs = np.flatnonzero(mine), np.flatnonzero(theirs)
        if len(mine) and len(theirs):
            step = max(1, (1 << 20) // len(theirs))
            for k in range(0, len(mine), step):
                some = mine[k : k + step]
                value += np.bincount(area[some], s[some] * (_above_both(e[some], f[theirs], y1) @ g[theirs]), n)
    sloped = np.flatnonzero(~flat)
    if len(sloped):
        at = np.r_[f[sloped, 0], f[sloped, 2]]
        order = np.argsort(at, kind="stable")
        many = np.cumsum(np.r_[-g[sloped], g[sloped]][order])
        total = np.r_[0.0, np.cumsum(many[:-1] * np.diff(at[order]))]
        top += np.bincount(area, -s * (np.interp(e[:, 2], at[order], total) - np.interp(e[:, 0], at[order], total)), n)
    return value, value - y1 * top + y0 * bottom


def _cells(of: DataFrame, size: int, group: list[str], area: list[str], kernel, schema: str, wanted=None, cost: Callable[[int], Column] | None = None) -> DataFrame:
    """What ``kernel`` makes of every cell: its rows are edges and, with x1 NULL, areas that hold the corner.

    wanted: of the edges by cell, where corners are looked up; else in every cell.  cost: of a cell of some size, what is held
    against MOST_EDGES, if not its edges.
    """
    out, rest, parents = None, of, None
    while True:
        dealt = _dealt(of, size)
        if parents is not None:
            inside = [F.floor(F.col(c) / SPLIT).cast("long").alias(f"_{c}") for c in ("row", "column")]
            dealt = dealt.select("*", *inside).join(parents.select(*group, F.col("row").alias("_row"), F.col("column").alias("_column")), [*group, "_row", "_column"], "left_semi").drop("_row", "_column")
        dealt = stored(dealt, "dealt")
        counts = stored(dealt.groupBy(*group, "row", "column").agg((F.count("*") if cost is None else cost(size)).alias("n")), "cells")
        full = counts.where((F.col("n") > MOST_EDGES) & F.lit(size >= SPLIT and size % SPLIT == 0))
        some = not full.isEmpty()
        cells = (counts.join(full, [*group, "row", "column"], "left_anti") if some else counts).drop("n")
        mine = dealt.join(cells, [*group, "row", "column"], "left_semi") if some else dealt
        corners = _corners(of, wanted(mine) if wanted else [cells], size, [*group, *(a for a in area if a not in group)])
        names = [*group, "row", "column", *(a for a in area if a not in group), "x1", "y1", "x2", "y2"]
        rows = mine.select(*names).unionByName(corners, allowMissingColumns=True).select(*names, F.lit(size).alias("size"))
        made = rows.groupBy(*group, "row", "column").applyInArrow(kernel, schema)
        out = made if out is None else out.union(made)
        if not some:
            return out
        parents, size = full, size // SPLIT


def _cell_of(table: pa.Table, names: np.ndarray, cuts: np.ndarray | None = None) -> Cell:
    """names: which area each row is of, as numbers from 0 on; cuts: the edges of which areas cut which."""
    known = np.asarray(table.column("x1").is_valid())
    xy = np.stack([np.asarray(table.column(c).filter(pa.array(known))) for c in ("x1", "y1", "x2", "y2")], axis=1).astype(np.int64)
    n = int(names.max(initial=-1)) + 1
    corner = np.zeros(n, np.int64)
    np.add.at(corner, names[~known], 1)
    row, column, size = (table.column(c)[0].as_py() for c in ("row", "column", "size"))
    return Cell(xy, names[known], n, corner, row, column, size, cuts)


def _codes(table: pa.Table, *columns: str) -> tuple[np.ndarray, list[tuple]]:
    keys = list(zip(*(table.column(c).to_pylist() for c in columns), strict=True))
    at: dict[tuple, int] = {}
    return np.array([at.setdefault(k, len(at)) for k in keys], np.int64), list(at)


def _two(left: DataFrame, right: DataFrame, a: str, b: str, unit: float, kind: Column | None = None) -> DataFrame:
    """Edges with their side; kind: of a right area."""
    if kind is not None:
        named = lambda df, c, k: df.select(F.struct(F.col(c).alias("area"), k.alias("kind")).alias("named"), "rings")
        none = F.lit(None).cast(right.select(kind).schema[0].dataType)
        flat = lambda of, side: of.select("area.*", "x1", "y1", "x2", "y2", F.lit(side).alias("side"))
        return flat(edges(named(left, a, none), "named", unit), 0).unionByName(flat(edges(named(right, b, kind), "named", unit), 1))
    one, two = edges(left, a, unit), edges(right, b, unit)
    return one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)))


def _cost(sloped: str, size: int) -> Column:
    """Of a cell that is summed: how wide its table may be, a fiftieth of its edges, those of the same area with each other, and what sloped edges cost."""
    many = lambda c: F.count_if(F.expr(c)).cast("double")
    one, two = (many(f"side = {k} and x1 <> x2 and y1 <> y2") for k in (0, 1))
    level = F.greatest(F.least(many("side = 1"), F.lit(float(size))) * 0.4, F.count("*") / 50.0, F.count("*") / F.sqrt(F.approx_count_distinct(F.struct("side", "area")).cast("double")) * 0.3)
    if sloped == "pairs":
        return F.greatest(level, F.sqrt(one * many("side = 1") + many("side = 0") * two) * 0.3)
    return F.when(one + two > 0, F.count("*").cast("double")).otherwise(level)


class Side:
    """The rows of one side of a cell: ids of its areas, xy and area (a number) of edges, how often each area holds the corner."""

    def __init__(self, table: pa.Table, side: int) -> None:
        mine = table.filter(pa.array(np.asarray(table.column("side")) == side))
        known = np.asarray(mine.column("x1").is_valid())
        self.ids, of = np.unique(np.asarray(mine.column("area")), return_inverse=True)
        self.first = np.unique(of, return_index=True)[1]
        edges = mine.filter(pa.array(known))
        self.xy = np.stack([np.asarray(edges.column(c)) for c in ("x1", "y1", "x2", "y2")], axis=1).astype(np.int64).reshape(-1, 4)
        self.area, self.corner, self.rows = of[known], np.bincount(of[~known], minlength=len(self.ids)), mine

    def signed(self, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return _signed(self.xy, self.area, len(self.ids), self.corner, box)


def _box_of(table: pa.Table) -> tuple[float, float, float, float]:
    row, column, size = (table.column(c)[0].as_py() for c in ("row", "column", "size"))
    return column * size - 0.5, row * size - 0.5, (column + 1) * size - 0.5, (row + 1) * size - 0.5


def _meet(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of some edges have a point in common with any of some others."""
    out, step = np.zeros(len(one), bool), max(1, (1 << 20) // max(1, len(two)))
    low, high = np.minimum(two[:, :2], two[:, 2:]), np.maximum(two[:, :2], two[:, 2:])
    side = lambda e, p: (e[:, 2] - e[:, 0]) * (p[:, 1] - e[:, 1]) - (e[:, 3] - e[:, 1]) * (p[:, 0] - e[:, 0])
    for k in range(0, len(one), step):
        e = one[k : k + step]
        near = (np.minimum(e[:, :2], e[:, 2:])[:, None] <= high).all(axis=2) & (np.maximum(e[:, :2], e[:, 2:])[:, None] >= low).all(axis=2)
        i, j = np.nonzero(near)
        p, q = e[i], two[j]
        met = (np.sign(side(p, q[:, :2])) * np.sign(side(p, q[:, 2:])) <= 0) & (np.sign(side(q, p[:, :2])) * np.sign(side(q, p[:, 2:])) <= 0)
        out[k + i[met]] = True
    return out


def shared(left: DataFrame, right: DataFrame, a: str, b: str, unit: float = 0.01, size: int = 1 << 16, kind: str | None = None) -> DataFrame:
    """a, kind and common: what each left area has in common with the right areas of each kind (a column of theirs), each area counted.

    There is no row for a pair.  Kinds that an area only touches have 0; of these, only the greatest is sure to be listed.
    Without kinds all right areas are of one, and what is only touched has no row.  ids: whole numbers.
    """
    area = unit * unit
    both = stored(_two(left, right, a, b, unit, F.col(kind) if kind else F.lit(0)), "edges")
    of_kind = both.schema["kind"].dataType.simpleString()

    def kernel(table: pa.Table) -> pa.Table:
        one, two, box = Side(table, 0), Side(table, 1), _box_of(table)
        kinds = two.rows.column("kind").combine_chunks()
        found, least = [(np.zeros(0, np.int64), [], np.zeros(0), np.zeros(0, bool))], max(1e-6, 1e-12 * (box[2] - box[0]) ** 2 * len(two.ids))  # what rounding may leave
        if len(one.ids) and len(two.ids):
            mine, (f, of, g, floor) = one.signed(box), two.signed(box)
            names = kinds.take(pa.array(two.first)).to_pylist()
            open_ = np.ones(len(one.ids), bool)
            for name in sorted(set(names), key=lambda k: (k is not None, k), reverse=True):
                own = np.array([k == name for k in names])
                some = own[of]
                value, adds = _sums(mine, (f[some], of[some], g[some], floor[some]), len(one.ids), box)
                there = value > least
                if kind:
                    asked = np.flatnonzero((open_ & ~there)[one.area])
                    there[one.area[asked[_meet(one.xy[asked], two.xy[own[two.area]])]]] = True
                    open_ &= ~there
                at = np.flatnonzero(there | (adds != 0))
                found.append((one.ids[at], [name] * len(at), adds[at] * area, there[at]))
        ids, names, values, there = zip(*found, strict=True)
        return pa.table([pa.array(np.concatenate(ids)), pa.array([n for x in names for n in x], kinds.type), pa.array(np.concatenate(values)), pa.array(np.concatenate(there))], ["a", "kind", "common", "there"])

    found = _cells(both, size, [], ["side", "area", "kind"], kernel, f"a long, kind {of_kind}, common double, there boolean", _of_interest, partial(_cost, "pairs"))
    sums = found.groupBy(F.col("a").alias(a), *([F.col("kind").alias(kind)] if kind else [])).agg(F.greatest(F.sum("common"), F.lit(0.0)).alias("common"), F.bool_or("there").alias("_there"))
    return sums.where("_there").drop("_there")


def meeting(left: DataFrame, right: DataFrame, a: str, b: str, unit: float = 0.01, size: int = 1 << 16) -> DataFrame:
    """a, b and common (area; 0 where they only touch) of areas of two tables that meet.  ids: whole numbers."""
    area = unit * unit

    def kernel(table: pa.Table) -> pa.Table:
        codes, names = _codes(table, "side", "area")
        sides = np.array([n[0] for n in names])
        l, r = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if len(l) and len(r):
            cell = _cell_of(table, codes, (sides[:, None] != sides) | np.eye(len(sides), dtype=bool))
            i, j = np.nonzero(cell.touch(l, r))
            value = cell.common(l, r)[i, j] * area
        else:
            i = j = value = np.zeros(0, np.int64)
        return pa.table([pa.array([names[k][1] for k in l[i]], pa.int64()), pa.array([names[k][1] for k in r[j]], pa.int64()), pa.array(value, pa.float64())], ["a", "b", "common"])

    both = stored(_two(left, right, a, b, unit), "edges")
    found = _cells(both, size, [], ["side", "area"], kernel, "a long, b long, common double", _of_interest)
    return found.groupBy(F.col("a").alias(a), F.col("b").alias(b)).agg(F.greatest(F.sum("common"), F.lit(0.0)).alias("common"))


def covered(left: DataFrame, right: DataFrame, a: str, b: str, unit: float = 0.01, size: int = 1 << 16) -> DataFrame:
    """a, area and covered: how much of each left area lies in any right one, however these overlap."""
    scale = unit * unit

    def kernel(table: pa.Table) -> pa.Table:
        one, two, box = Side(table, 0), Side(table, 1), _box_of(table)
        n, m = len(one.ids), len(two.ids)
        xy = np.concatenate([one.xy, two.xy])
        if ((xy[:, 0] != xy[:, 2]) & (xy[:, 1] != xy[:, 3])).any():
            row, column, size = (table.column(c)[0].as_py() for c in ("row", "column", "size"))
            cell = Cell(xy, np.r_[one.area, n + two.area], n + m, np.r_[one.corner, two.corner], row, column, size)
            below, above = cell.below[:, n:].any(axis=1), cell.above[:, n:].any(axis=1)
            own = cell.weight @ cell.below[:, :n] - cell.weight @ cell.above[:, :n]
            both = cell.weight @ (cell.below[:, :n] & below[:, None]) - cell.weight @ (cell.above[:, :n] & above[:, None])
        else:
            mine = e, of, s, base = one.signed(box)
            own = np.zeros(n) + np.bincount(of[~base], (s * (e[:, 1] + e[:, 3]) / 2 * (e[:, 2] - e[:, 0]))[~base], n)
            both = _sums(mine, two.signed(box), n, box, once=True)[1] if m else np.zeros(n)
        return pa.table([pa.array(one.ids), pa.array(own * scale), pa.array(both * scale)], ["a", "area", "covered"])

    both = stored(_two(left, right, a, b, unit), "edges")
    found = _cells(both, size, [], ["side", "area"], kernel, "a long, area double, covered double", None, partial(_cost, "cells"))
    return found.groupBy(F.col("a").alias(a)).agg(F.sum("area").alias("area"), F.sum("covered").alias("covered"))


def outlines(areas: DataFrame, area: str, group: str, unit: float = 0.01, size: int = 1 << 16) -> DataFrame:
    """group and x1, y1, x2, y2 (units): the outline of the union of each group's areas, the union on the left of each piece."""
    named = areas.select(F.col(group).alias("set"), F.struct(F.col(group).alias("set"), F.col(area).alias("area")).alias("named"), "rings")
    of = edges(named, "named", unit).select("area.set", "area.area", "x1", "y1", "x2", "y2")

    def kernel(table: pa.Table) -> pa.Table:
        codes, _ = _codes(table, "area")
        cell = _cell_of(table, codes)
        below, above = cell.below.any(axis=1), cell.above.any(axis=1)
        e = np.concatenate([cell.pieces[above & ~below], cell.pieces[below & ~above][:, [2, 3, 0, 1]]])
        return pa.table([pa.array([table.column("set")[0].as_py()] * len(e), pa.int64())] + [pa.array(e[:, i], pa.float64()) for i in range(4)], ["set", "x1", "y1", "x2", "y2"])

    return _cells(stored(of, "edges"), size, ["set"], ["set", "area"], kernel, "set long, x1 double, y1 double, x2 double, y2 double")


def union(areas: DataFrame, area: str, group: str, unit: float = 0.01, size: int = 1 << 16) -> DataFrame:
    """group, ring, area and points of the rings of the union of each group's areas; holes run the other way and count negative.

    area and group: whole numbers.
    """
    e = stored(outlines(areas, area, group, unit, size).withColumn("id", F.monotonically_increasing_id()), "outline")
    angle = lambda dx, dy: F.atan2(F.col(dy[0]) - F.col(dy[1]), F.col(dx[0]) - F.col(dx[1]))
    arrive = e.select("set", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("id").alias("edge"), angle(("x1", "x2"), ("y1", "y2")).alias("back"))
    leave = e.select("set", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("id").alias("next"), angle(("x2", "x1"), ("y2", "y1")).alias("way"))
    turn = F.pmod(F.col("back") - F.col("way"), F.lit(2 * np.pi))
    turn = F.when(turn < 1e-12, 2 * np.pi).otherwise(turn)  # the first to be met clockwise from where one came
    after = arrive.join(leave, ["set", "x", "y"]).groupBy("edge").agg(F.min_by("next", turn).alias("next"))
    rings = graph.components(after.select(F.col("edge").alias("src"), F.col("next").alias("dst")))
    rows = e.join(rings, e["id"] == rings["node"]).join(after, e["id"] == after["edge"]).select("set", "component", "id", "next", "x1", "y1")

    def ordered(table: pa.Table) -> pa.Table:
        ids, nexts, x, y = (table.column(c).to_pylist() for c in ("id", "next", "x1", "y1"))
        at, order, k = {i: k for k, i in enumerate(ids)}, [], 0
        for _ in ids:
            order.append(k)
            k = at[nexts[k]]
        p = np.array([(x[k], y[k]) for k in order])
        before, behind = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
        bent = np.abs(before[:, 0] * behind[:, 1] - before[:, 1] * behind[:, 0]) > 2e-5 * np.hypot(*before.T) * np.maximum(np.hypot(*behind.T), 1e-9)
        p = p[bent] * unit  # without points that cells were cut at
        value = ((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum() / 2) if len(p) else 0.0
        points = pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["x", "y"])
        return pa.table([pa.array([table.column("set")[0].as_py()], pa.int64()), pa.array([table.column("component")[0].as_py()], pa.int64()), pa.array([float(value)]), pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), points)], ["set", "ring", "area", "points"])

    made = rows.groupBy("set", "component").applyInArrow(ordered, "set long, ring long, area double, points array<struct<x: double, y: double>>")
    return made.withColumnRenamed("set", group)
