"""The nearest points, sent to tasks or by cells, against a plain search; the points lie in clusters, at equal places and on a grid."""

import math
import random

import pytest

from gridloom.operators import build, network, spatial

SCHEMA = "{0}_id long, {0}x double, {0}y double, k int"


def tables(spark, seed):
    r = random.Random(seed)
    place = lambda: (float(r.randint(0, 30)), float(r.randint(0, 30))) if r.random() < 0.6 else (r.gauss(1000, 3), r.gauss(-500, 3)) if r.random() < 0.5 else (7.0, 7.0)
    a = [(i, *place(), r.randint(0, 3)) for i in range(120)] + [(900, None, 1.0, 1), (901, float("inf"), 1.0, 1), (902, 5000.0, 5000.0, 9), (903, 5.0, 5.0, None)]
    b = [(i, *place(), r.randint(0, 2)) for i in r.sample(range(1000), 150)] + [(2000, 3.0, None, 1), (2001, 4.0, 4.0, None)]
    return a, b, spark.createDataFrame(a, SCHEMA.format("a")), spark.createDataFrame(b, SCHEMA.format("b"))


def plain(a, b, keyed, radius, most):
    known = lambda v: v is not None and math.isfinite(v)
    out = set()
    for i, x, y, k in a:
        if known(x) and known(y):
            near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v, m in b if known(u) and known(v) and (not keyed or k is not None and k == m))
            out |= {(i, j, d) for d, j in near[:most] if d <= radius}
    return out


@pytest.mark.parametrize("held", [1000, 0])
@pytest.mark.parametrize(("keyed", "radius", "most"), [(False, None, 1), (True, None, 1), (False, 4.0, 1), (True, 2.0, 1), (False, 4.0, 5), (True, 1500.0, 3)])
def test_nearest(spark, held, keyed, radius, most):
    a, b, left, right = tables(spark, most + 10 * keyed)
    keys = ("k",) if keyed else ()
    rows = spatial.nearest(left, right if keyed else right.drop("k"), "a_id", "b_id", radius or 3.0, bounded=radius is not None, keys=keys, most=most, held_points=held).collect()
    assert {tuple(r) for r in rows if r.b_id is not None} == plain(a, b, keyed, radius or math.inf, most)
    assert len(rows) == len(set(rows)) and (radius is None or {r.a_id for r in rows} == {x[0] for x in a})


def test_nearest_of_none(spark):
    _, _, left, right = tables(spark, 1)
    assert spatial.nearest(left, right.limit(0), "a_id", "b_id", 3.0).count() == 0
    assert spatial.nearest(left, right.limit(0), "a_id", "b_id", 3.0, bounded=True).where("b_id is null").count() == left.count()


def test_intermodal_takes_the_first_of_many_facilities(spark):
    """Thousands of facilities around each city, many equally far: five each, ties by name."""
    cities = spark.createDataFrame([("s1", 0.0, 0.0), ("s2", 900.0, 900.0), ("s3", 90000.0, 0.0)], "city string, ax double, ay double")
    places = [(i, float(i % 31), float(i // 31)) for i in range(1000)]
    areas = spark.createDataFrame(places, "id long, bx double, by double").selectExpr("id", "bx", "by", "'f' || id as facility")
    got = {(r.src, r.dst) for r in build.intermodal(cities, areas, areas, "city", "id", "facility").where("confidence = 0.7D").collect()}
    far = lambda x, y, p: math.sqrt((x - p[1]) * (x - p[1]) + (y - p[2]) * (y - p[2]))
    assert got == {(s, f) for s, x, y in (("s1", 0.0, 0.0), ("s2", 900.0, 900.0)) for _, f in sorted((far(x, y, p), f"f{p[0]}") for p in places)[:5]}


def test_connected_points_dealt_out(spark, monkeypatch):
    """All points lie in one cell of the reach, so the pairs are dealt out by parts; each stands once."""
    monkeypatch.setattr(network, "BESIDE", 7)
    places = [(i, float(i * 37 % 100), float(i * 53 % 90)) for i in range(60)]
    points = spark.createDataFrame(places, "id long, ax double, ay double")
    lines = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 90.0)], "line long, x1 double, y1 double, x2 double, y2 double")
    got = [(r.src, r.dst) for r in network.connects_to(points, lines, "id", reach=60.0).collect()]
    want = {(a[0], b[0]) for a in places for b in places if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 60}
    assert len(got) == len(set(got)) and set(got) == want
    assert network.connects_to(points.limit(0), lines, "id").count() == 0
