import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.operators import clip, parcels, scoring, tables, upkeep

SCHEMA = "parcel string, value double, contact string, town string, sold timestamp"
OLD, NEW = dt.datetime(2019, 1, 1), dt.datetime(2026, 5, 1)
FIRST = [("T-001", 100000.0, "OWNER A", "X", None), ("T-002", 200000.0, "OWNER B", "X", None), ("T-003", 300000.0, "OWNER C", "Y", OLD)]
SECOND = [("T-001", 125000.0, "OWNER A", "X", None), ("T-002", 200000.0, "NEW OWNER B", "X", None), ("T-003", 300000.0, "OWNER C", "Y", NEW), ("T-004", 50000.0, "OWNER D", "Y", None)]


def test_months(spark, tmp_path):
    path = f"{tmp_path}/snapshots"
    assert parcels.list_snapshots(spark, path) == []
    for month, rows in (("2026-05", FIRST), ("2026-06", SECOND), ("2026-06", SECOND)):  # the last again
        parcels.take_snapshot(spark.createDataFrame(rows, SCHEMA), path, month, "parcel", "sold")
    assert parcels.list_snapshots(spark, path) == ["2026-05", "2026-06"]
    delta = lambda m: parcels.monthly_deltas(spark, path, m, "parcel", "contact", "value", "sold")
    assert delta("2026-05") is None
    assert sorted((r["key"], r["change_type"]) for r in delta("2026-06").collect()) == [("T-001", "value_change"), ("T-002", "owner_change"), ("T-003", "sale"), ("T-004", "new_parcel")]


def test_owners(spark):
    rows = [("1", 1.0, "Acme, Inc.", "X", None), ("2", 2.0, "ACME LLC", "X", None), ("3", 4.0, "ACME LLC", "Y", None), ("4", 8.0, " ", "Y", None), ("5", 1.0, "John Doe", "Y", None)]
    owned, entities = parcels.build_owners(spark.createDataFrame(rows, SCHEMA), "parcel", "contact", "town", "value")
    assert {r["owner"]: (r["name"], r["parcels"], r["spellings"], r["value"]) for r in entities.collect()} == {"ACME": ("ACME LLC", 3, 2, 7.0), "JOHN DOE": ("John Doe", 1, 1, 1.0)}
    assert [r["owner"] for r in parcels.largest_owners(entities).collect()] == ["ACME"]
    assert [(r["town"], r["place"]) for r in parcels.owner_towns(owned).where("owner = 'ACME'").orderBy("place").collect()] == [("X", 1), ("Y", 2)]


def test_flood_levels(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.05,), (0.1,), (0.4,), (1.0,)], "f double")
    assert [r[0] for r in df.select(parcels.flood_level(F.col("f"))).collect()] == ["minimal", "minimal", "low", "moderate", "high", "high"]


def test_rank_movement(spark):
    history = [("s", 1, e, i) for i, e in enumerate((9001, 9002, 9003, 9004, 9005), 1)] + [("s", 2, e, i) for i, e in enumerate((9005, 9001, 9002, 9006, 9003, 9004), 1)]
    got = scoring.rank_movement(spark.createDataFrame(history, "scenario string, run int, entity long, rank long")).collect()
    assert [(r["entity"], r["previous"], r["rank"]) for r in got] == [(9005, 5, 1), (9006, None, 4)]


def test_sinks_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    up = tables.upsert(old, new, ["k"])
    assert rows(up) == [(1, "a"), (2, "c"), (3, "d")] == rows(tables.upsert(up, new, ["k"]))
    put = tables.insert_ignore(old, new, ["k"])
    assert rows(put) == [(1, "a"), (2, "b"), (3, "d")] == rows(tables.insert_ignore(put, new, ["k"]))


def test_tiers(spark):
    df = spark.createDataFrame([("authoritative", "proxy"), ("unheard of", "modeled"), ("estimated", "proxy")], "a string, b string")
    assert [r[0] for r in df.select(upkeep.weakest(F.col("a"), F.col("b"))).collect()] == ["proxy", "modeled", "estimated"]
    inputs = spark.createDataFrame([("t", "x"), ("t", "y"), ("u", "z")], "table string, layer string")
    known = spark.createDataFrame([("x", "authoritative"), ("y", "estimated")], "layer string, tier string")
    assert {tuple(r) for r in upkeep.table_tiers(inputs, known).collect()} == {("t", "estimated"), ("u", "authoritative")}


def test_layers(spark):
    probe = spark.createDataFrame([("a", 5), ("b", 6), ("c", None)], "layer string, n long")
    known = upkeep.layer_changes(spark.createDataFrame([], "layer string, checksum string"), probe)
    assert {r["layer"]: r["status"] for r in known.collect()} == {"a": "updated", "b": "updated", "c": "error"}
    again = upkeep.layer_changes(known, spark.createDataFrame([("a", 5), ("b", 7)], "layer string, n long"))
    assert {r["layer"]: r["status"] for r in again.collect()} == {"a": "skipped", "b": "updated"}
    assert upkeep.rescore_needed(again, ["b"]).first()[0] and not upkeep.rescore_needed(again, ["a"]).first()[0]


def test_lookups(spark):
    entities = spark.createDataFrame([(1, "substation", "Aguirre TC", 7, "g1", True), (2, "substation", "Aguirre", 8, "g1", False), (3, "hospital", "San Juan", 9, "g2", False)], "entity long, kind string, name string, src_gid long, src_table string, is_generator boolean")
    assert [r["entity"] for r in upkeep.find_entity(entities, name="aguirre").collect()] == [2, 1]
    with pytest.raises(ValueError):
        upkeep.find_entity(entities)
    names = spark.createDataFrame([("Aguirre",), ("Nowhere",)], "plant string")
    assert [tuple(r) for r in upkeep.match_names(names, entities).collect()] == [("Aguirre", 1)]
    runs = spark.createDataFrame([(1, "s", 10.0, OLD), (2, "s", 30.0, OLD), (3, "s", 30.0, NEW), (4, "t", 25.0, NEW)], "run_id long, scenario string, budget double, computed_at timestamp")
    assert upkeep.nearest_budget(runs, "s", 28.0).first()["run_id"] == 3
    scores = spark.createDataFrame([(1, 10.0, 0.5), (2, 4.0, None)], "entity long, cascade double, betweenness double")
    units = spark.createDataFrame([(1, "B", False), (1, "A", False), (2, "C", True)], "entity long, plant string, running boolean")
    assert sorted(map(tuple, upkeep.current_state(scores, units).collect())) == [(1, 15.0, True, "A, B"), (2, 4.0, False, "C")]


def test_cell_shares_against_counted_places(spark):
    """Shares of a square and a triangle by the nearest of five sites, against 40,000 places counted one by one."""
    import numpy as np

    sites = [(1, 10.0, 10.0), (2, 90.0, 20.0), (3, 50.0, 80.0), (4, 52.0, 40.0), (5, 300.0, 300.0)]
    p = lambda *at: [{"x": float(x), "y": float(y)} for x, y in at]
    rings = [("square", p((0, 0), (100, 0), (100, 100), (0, 100), (0, 0))), ("triangle", p((0, 0), (100, 0), (0, 100), (0, 0)))]
    areas = spark.createDataFrame(rings, "area string, ring array<struct<x:double,y:double>>")
    got = {(r.area, r.site): r.share for r in clip.cell_shares(areas, spark.createDataFrame(sites, "site long, bx double, by double"), "area", "site").collect()}
    x, y = (v.reshape(-1) + 0.25 for v in np.meshgrid(np.arange(0, 100, 0.5), np.arange(0, 100, 0.5)))
    owner = np.argmin([(x - u) ** 2 + (y - v) ** 2 for _, u, v in sites], axis=0) + 1
    for area, inside in (("square", x >= 0), ("triangle", x + y < 100)):
        for site in range(1, 6):
            assert abs(got.get((area, site), 0.0) - (owner[inside] == site).mean()) < 0.01


def test_unknown_owners_and_small_changes_are_told_from_new_rows(spark):
    schema = "k long, owner string, value double, sold timestamp"
    old = [(1, None, 10.0, None), (2, "A", 10.0, OLD), (3, None, 1.0, None), (4, "A", None, OLD), (5, "A", 1.0, NEW), (9, "gone", 1.0, None)]
    new = [(1, None, 99.0, None), (2, None, 10.9, None), (3, "B", 1.0, OLD), (4, "A", 7.0, OLD), (5, "A", 2.0, OLD), (6, None, None, None)]
    made = tables.snapshot_deltas(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "k")
    assert sorted(tuple(r) for r in made.select("key", "change_type", "old_value", "new_value").collect()) == [
        (1, "value_change", "10.00", "99.00"), (3, "owner_change", None, "B"), (3, "sale", None, "2019-01-01 00:00:00"), (5, "value_change", "1.00", "2.00"), (6, "new_parcel", None, "6")
    ]
    strict = tables.snapshot_deltas(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "k", least_change=0.5)
    assert strict.where("change_type = 'value_change'").count() == 3


def test_a_far_site_owns_all(spark):
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))]
    areas = spark.createDataFrame([(1, ring)], "area long, ring array<struct<x: double, y: double>>")
    got = clip.cell_shares(areas, spark.createDataFrame([(7, 50_000.0, 0.0)], "site long, bx double, by double"), "area", "site").collect()
    assert [(r.area, r.site) for r in got] == [(1, 7)] and got[0].share == pytest.approx(1)
    two = clip.cell_shares(areas, spark.createDataFrame([(7, 50_000.0, 5.0), (8, -49_995.0, 5.0)], "site long, bx double, by double"), "area", "site").collect()
    assert {r.site: round(r.share, 6) for r in two} == {7: 0.75, 8: 0.25}
