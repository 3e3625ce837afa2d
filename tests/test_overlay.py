import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import overlay

SCHEMA = "area long, team long, rings array<array<struct<x: double, y: double>>>"


def parity(rings, x, y):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                inside = not inside
    return inside


def swept(shapes, wanted):
    """Area of what ``wanted`` says of the shapes, by vertical strips between all ends and crossings."""
    lines = [(s, p, q) for s, rings in enumerate(shapes) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p[0] != q[0]]
    xs = {p[0] for _, *e in lines for p in e}
    for (_, a, b), (_, c, d) in itertools.combinations(lines, 2):
        den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
        if den:
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
            xs.add(a[0] + t * (b[0] - a[0]))
    total, xs = 0.0, sorted(xs)
    for x1, x2 in itertools.pairwise(xs):
        x = (x1 + x2) / 2
        ys = sorted((p[1] + (x - p[0]) * (q[1] - p[1]) / (q[0] - p[0]), s) for s, p, q in lines if min(p[0], q[0]) < x < max(p[0], q[0]))
        inside, before = [False] * len(shapes), None
        for y, s in ys:
            if before is not None and wanted(inside):
                total += (y - before) * (x2 - x1)
            inside[s] = not inside[s]
            before = y
    return total


def shapes(seed, n, reach, span=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = r.randint(-span, span), r.randint(-span, span)
        k = r.randint(3, 8)
        turns = sorted(r.random() * 6.28 for _ in range(k))
        star = [(float(round(x + r.randint(reach // 3, reach) * math.cos(t))), float(round(y + r.randint(reach // 3, reach) * math.sin(t)))) for t in turns]
        rings = [star]
        kind = r.random()
        if kind < 0.3:  # with a hole, and a part elsewhere
            rings = [[(x - reach, y - reach), (x + reach, y - reach), (x + reach, y + reach), (x - reach, y + reach)], [(x - 2, y - 3), (x + 2, y - 2), (x, y + 4)], [(x + 80, y), (x + 90, y), (x + 85, y + 7)]]
            rings = [[(float(a), float(b)) for a, b in ring] for ring in rings]
        elif kind < 0.4 and out:  # shares borders
            rings = [[(a + 7.0, b) for a, b in ring] for ring in out[-1]]
        elif kind < 0.5 and out:
            rings = out[-1]
        out.append(rings)
    return out


def frame(spark, many, teams=1):
    return spark.createDataFrame([(k, k % teams, rings) for k, rings in enumerate(many)], SCHEMA)


@pytest.mark.parametrize(("seed", "reach", "size"), [(1, 20, 16), (2, 45, 8), (3, 12, 256)])
def test_common_and_covered(spark, monkeypatch, seed, reach, size):
    monkeypatch.setattr(overlay, "MOST_EDGES", 12)
    a, b = shapes(seed, 12, reach), shapes(seed + 50, 12, reach)
    left, right = frame(spark, a), frame(spark, b).withColumnRenamed("area", "other")
    got = {(r.area, r.other): r.common for r in overlay.meeting(left, right, "area", "other", 1.0, size).collect()}
    for i, j in itertools.product(range(12), range(12)):
        assert got.get((i, j), 0.0) == pytest.approx(swept([a[i], b[j]], all), abs=1e-2)
    got = {r["area"]: (r[1], r.covered) for r in overlay.covered(left, right, "area", "other", 1.0, size).toDF("area", "own", "covered").collect()}
    for i in range(12):
        assert got[i] == pytest.approx((swept([a[i]], all), swept([a[i], *b], lambda inside: inside[0] and any(inside[1:]))), abs=1e-2)


@pytest.mark.parametrize(("seed", "reach", "size"), [(4, 20, 16), (5, 40, 64)])
def test_union_comes_out_as_rings(spark, seed, reach, size):
    many = shapes(seed, 14, reach)
    rings = overlay.union(frame(spark, many, 2), "area", "team", 1.0, size).collect()
    for team in (0, 1):
        own = [s for k, s in enumerate(many) if k % 2 == team]
        mine = [r for r in rings if r.team == team]
        assert sum(r["area"] for r in mine) == pytest.approx(swept(own, any), abs=5e-2)
        points, r = [[(p.x, p.y) for p in ring.points] for ring in mine], random.Random(seed)
        for _ in range(300):
            x, y = r.uniform(-150, 150), r.uniform(-150, 150)
            assert parity(points, x, y) == any(parity(s, x, y) for s in own)


def box(x1, y1, x2, y2):
    return [(float(x1), float(y1)), (float(x2), float(y1)), (float(x2), float(y2)), (float(x1), float(y2))]


def test_touching_holes_and_neighbours(spark):
    left = frame(spark, [[box(0, 0, 10, 10), box(2, 2, 8, 8)], [box(20, 0, 30, 10)], [box(40, 40, 41, 41)]])
    right = frame(spark, [[box(10, 3, 15, 5)], [box(30, 10, 31, 11)], [box(3, 3, 7, 7)], [box(-5, -5, 50, 50)], [box(2, 2, 8, 8)]]).withColumnRenamed("area", "other")
    got = {(r.area, r.other): r.common for r in overlay.meeting(left, right, "area", "other", 1.0, 4).collect()}
    assert got == {(0, 0): 0.0, (1, 1): 0.0, (0, 3): 64.0, (1, 3): 100.0, (2, 3): 1.0, (0, 4): 0.0}
    rings = overlay.union(frame(spark, [[box(0, 0, 10, 10)], [box(10, 0, 20, 10)], [box(20, 10, 30, 20)], [box(5, 2, 15, 3)]]), "area", "team", 1.0, 4).collect()
    assert sorted((r["area"], len(r.points)) for r in rings) == [(100.0, 4), (200.0, 4)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = frame(spark, [[box(0, 0, 1, 1)], [[(0.0, 0.0), (1.0, 1.0)]], None])
    assert overlay.meeting(none, some.withColumnRenamed("area", "other"), "area", "other", 1.0).count() == 0
    assert overlay.union(none, "area", "team", 1.0).count() == 0
    assert overlay.covered(some, none.withColumnRenamed("area", "other"), "area", "other", 1.0).collect()[0].covered == 0.0


def test_areas_of_one_table_do_not_cut_each_other():
    """A hundred boxes that all cross each other, and one box of the other table across them."""
    many = [(i, i, i + 200, i) for i in range(100)] + [(i, i, i, i + 200) for i in range(100)]
    xy, area = np.array([*many, (150, 250, 160, 250)]), np.array([*range(100), *range(100), 100])
    side = np.array([0] * 100 + [1])
    cell = overlay.Cell(xy, area, 101, np.zeros(101, int), 0, 0, 512, (side[:, None] != side) | np.eye(101, dtype=bool))
    assert len(cell.pieces) == len(xy)


@pytest.mark.parametrize("seed", range(40))
def test_cut_only_across(seed):
    """Shapes on a small grid, many with borders along each other: as when all edges are cut, and as swept."""
    r, many = random.Random(seed), []
    for _ in range(6):
        x, y, w, h, kind = r.randint(0, 12), r.randint(0, 12), r.randint(1, 8), r.randint(1, 8), r.random()
        many.append([box(x, y, x + w, y + h)] if kind < 0.6 else [box(x, y, x + 6, y + 6), box(x + 2, y + 2, x + 4, y + 4)] if kind < 0.8 else [[(x, y), (x + w, y), (x, y + h)]])
    edges = [(*min(p, q), *max(p, q), k) for k, rings in enumerate(many) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    xy, area, side = np.array([e[:4] for e in edges]).astype(int), np.array([e[4] for e in edges]), np.arange(6) % 2
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    cell = overlay.Cell(xy, area, 6, np.zeros(6, int), 0, 0, 64, (side[:, None] != side) | np.eye(6, dtype=bool))
    assert (cell.touch(left, right) == overlay.Cell(xy, area, 6, np.zeros(6, int), 0, 0, 64).touch(left, right)).all()
    want = [[swept([many[i], many[j]], all) for j in right] for i in left]
    assert cell.common(left, right) == pytest.approx(np.array(want), abs=1e-2)


def counted(boxes, places):
    """How many boxes are over each unit square of a 400 x 400 grid, as sums over each place."""
    grid = np.zeros((400, 400), int)
    for x1, y1, x2, y2 in boxes:
        grid[x1:x2, y1:y2] += 1
    return [(grid[x1:x2, y1:y2].sum(), (grid[x1:x2, y1:y2] > 0).sum()) for x1, y1, x2, y2 in places]


def dense(spark, seed, many, sides):
    r = random.Random(seed)
    boxes = [(x, y, x + r.randint(*sides), y + r.randint(*sides)) for x, y in ((r.randint(0, 280), r.randint(0, 280)) for _ in range(many))]
    return boxes, frame(spark, [[box(*b)] for b in boxes], 3)


def test_covered_where_areas_lie_densely(spark):
    """Six hundred plots and five hundred areas, each over many others: without cutting any by any."""
    (plots, left), (areas, right) = dense(spark, 1, 600, (10, 40)), dense(spark, 2, 500, (20, 110))
    got = {r["area"]: r[2] for r in overlay.covered(left, right.withColumnRenamed("area", "other"), "area", "other", 1.0, 128).toDF("area", "own", "covered").collect()}
    assert got == pytest.approx({k: float(v[1]) for k, v in enumerate(counted(areas, plots))})


def test_shared_where_areas_lie_densely(spark):
    """What plots share with the areas of each kind, summed over those that overlap each other, also by large plots that hold whole cells."""
    (plots, left), (areas, right) = dense(spark, 3, 300, (10, 40)), dense(spark, 4, 400, (20, 110))
    wide = [(0, 0, 400, 400), (100, 100, 300, 301)]
    left = left.unionByName(frame(spark, [[box(*b)] for b in wide]).withColumn("area", F.col("area") + 300))
    kinds = overlay.shared(left, right.withColumnRenamed("area", "other"), "area", "other", 1.0, 64, kind="team").collect()
    want = {(k, t): float(v[0]) for t in range(3) for k, v in enumerate(counted(areas[t::3], plots + wide)) if v[0]}
    assert {(r.area, r.team): r.common for r in kinds if r.common} == pytest.approx(want)
    assert len(kinds) < 3 * 302 + 1


@pytest.mark.parametrize(("seed", "reach", "size"), [(6, 20, 16), (7, 12, 256)])
def test_shared_of_any_shape(spark, monkeypatch, seed, reach, size):
    monkeypatch.setattr(overlay, "MOST_EDGES", 12)
    a, b = shapes(seed, 10, reach), shapes(seed + 50, 10, reach)
    got = {r.area: r.common for r in overlay.shared(frame(spark, a), frame(spark, b).withColumnRenamed("area", "other"), "area", "other", 1.0, size).collect()}
    for i in range(10):
        assert got.get(i, 0.0) == pytest.approx(sum(swept([a[i], b[j]], all) for j in range(10)), abs=1e-2)
