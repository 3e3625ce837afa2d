"""Cards and sites of tables that are empty or know little; the full ones are held against SQL in test_queries."""

from gridloom.operators import cards, optimize, sites

POINTS = "array<array<struct<x: double, y: double>>>"
BOX = [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]]
RING = [(-10.0, -10.0), (500.0, -10.0), (500.0, 500.0), (-10.0, 500.0), (-10.0, -10.0)]


def tables(spark, full):
    make = lambda rows, schema: spark.createDataFrame(rows if full else [], schema)
    return {
        "targets": make([("substation", 1, 50.0, 90.0, None), ("port", 2, 50.0, 1050.0, None)], "kind string, target long, bx double, by double, risk double"),
        "areas": make([(7, RING, 0.5, 0.25)], "area long, ring array<struct<x: double, y: double>>, resilience double, svi double"),
        "travel": make([(7, 12.5)], "area long, minutes double"),
        "zones": make([(3, "AE", [[(50.0, 0.0), (900.0, 0.0), (900.0, 900.0), (50.0, 900.0)]])], f"zone long, label string, rings {POINTS}"),
        "parcels": make([(1, None, "A", 5.0)], "parcel long, land double, owner string, total double"),
    }


def test_sites_that_know_little(spark):
    own = spark.createDataFrame([(1, 50.0, 50.0, BOX, 10000.0, 1), (2, None, 50.0, BOX, 0.0, None)], f"site long, x double, y double, rings {POINTS}, area_m2 double, parcel long")
    full = tables(spark, True)
    one, two = sites.scored(sites.measured(own, full["targets"], full["areas"], full["travel"], full["zones"].drop("label"), full["parcels"], 100.0)).orderBy("site").collect()
    assert (one.dist_substation, one.substation, one.dist_port, one.dist_water, one.minutes, one.svi, one.flood) == (40.0, 1, 1000.0, None, 12.5, 0.25, 0.5)
    assert (one.s_power_access, one.s_flood_safety, one.s_water_access, one.s_land_value) == (1.0, 0.5, None, None) and one.composite is not None
    assert (two.dist_substation, two.area, two.flood, two.s_power_access, two.composite) == (None, None, 0.0, None, 1.0)
    none = tables(spark, False)
    got = sites.scored(sites.measured(own, none["targets"], none["areas"], none["travel"], none["zones"].drop("label"), none["parcels"], 100.0)).collect()
    assert {(r.site, r.flood, r.composite) for r in got} == {(1, 0.0, 1.0), (2, 0.0, 1.0)}
    assert sites.scored(sites.measured(own.limit(0), full["targets"], full["areas"], full["travel"], full["zones"].drop("label"), full["parcels"], 100.0)).count() == 0


def test_stored_runs(spark, tmp_path):
    path, schema = str(tmp_path), "entity long, kind string, cost double, uplift double, place int"
    optimize.store_run(spark.createDataFrame([(1, "a", 5.0, 0.5, 1)], schema), path, "one", "2026-01-01T00:00:00")
    optimize.store_run(spark.createDataFrame([(2, "b", 7.0, 0.25, 1), (3, "b", 1.0, 0.25, 2)], schema), path, "two", "2026-01-02T00:00:00")
    optimize.store_run(spark.createDataFrame([(4, "c", 9.0, 0.5, 1)], schema), path, "one", "2026-01-01T12:00:00")
    assert {tuple(r)[0::2] for r in optimize.stored_runs(spark, path).collect()} == {("one", 1, 0.5), ("two", 2, 0.5)}
    assert {r.entity for r in optimize.last_run(spark, path).collect()} == {2, 3}


def test_flood_of_shapes(spark):
    zones = tables(spark, True)["zones"]
    shapes = spark.createDataFrame([(1, BOX), (2, [[(2000.0, 0.0), (2010.0, 0.0), (2010.0, 10.0)]]), (3, None)], f"area long, rings {POINTS}")
    assert {tuple(r) for r in cards.flood(shapes, zones, "area").collect()} == {(1, 0.5, "high", "AE"), (2, 0.0, "minimal", None), (3, 0.0, "minimal", None)}
    halves = spark.createDataFrame([(1, [[(0.0, 0.0), (50.0, 0.0), (50.0, 100.0), (0.0, 100.0)]]), (1, [[(50.0, 0.0), (100.0, 0.0), (100.0, 100.0), (50.0, 100.0)]])], f"area long, rings {POINTS}")
    assert [tuple(r) for r in cards.flood(cards.one_shape(halves, "area"), zones, "area").collect()] == [(1, 0.5, "high", "AE")]


def test_flood_of_many_shapes_in_many_zones(spark):
    """Three hundred shapes under three hundred zones that all overlap; the last label is of a zone that one shape only touches."""
    square = lambda x, y, n: [[(float(x), float(y)), (float(x + n), float(y)), (float(x + n), float(y + n)), (float(x), float(y + n))]]
    zones = [(i, "A" if i % 2 else "B", square(i % 20, i // 20, 100)) for i in range(300)] + [(999, "Z", square(140, 50, 10)), (1000, None, square(300, 300, 10))]
    shapes = [(i, square(30 + i % 17, 30 + i % 13, 20)) for i in range(300)] + [(500, square(130, 50, 10)), (501, square(400, 0, 5)), (502, square(295, 295, 10))]
    got = {r.area: (r.fraction, r.worst_zone) for r in cards.flood(spark.createDataFrame(shapes, f"area long, rings {POINTS}"), spark.createDataFrame(zones, f"zone long, label string, rings {POINTS}"), "area", 1.0, 64).collect()}
    assert {got[i] for i in range(300)} == {(1.0, "B")}
    assert (got[500], got[501], got[502]) == ((0.0, "Z"), (0.0, None), (0.25, None))


def test_scores_with_ranks_sent_and_joined(spark):
    rows = [(i, *(float(i * k % 17) if i % k else None for k in (2, 3, 5, 7, 11, 13, 4, 6, 9)), i % 5 / 4) for i in range(60)]
    columns = [c for c, _ in sites.RANKED.values()]
    df = spark.createDataFrame(rows, f"site long, {', '.join(f'{c} double' for c in columns)}, flood double")
    sent, joined = ({tuple(r) for r in sites.scored(df, held_values=h).collect()} for h in (sites.HELD_VALUES, 0))
    assert sent == joined and len(sent) == 60
