import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.sources import collections, feeds, files, scripts, sinks

OUTAGE = {"name": "Northhill", "totalClients": 4000, "totalClientsWithoutService": 30, "totalClientsWithService": 3970, "totalClientsAffectedByPlannedOutage": 7, "totalClientsAffectedByLoadShed": 2, "percentageClientsWithoutService": 0.75}


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_outages(spark):
    got = feeds.outage_regions(payloads(spark, json.dumps({"regions": [OUTAGE, {"totalClients": 3}]}), "{bad", "")).collect()
    assert [(r["region"], r["clients"], r["without"], r["planned"], r["percent_without"]) for r in got] == [("Northhill", 4000, 30, 7, 0.75)]


def test_quakes(spark):
    feature = lambda i, m: {"id": i, "properties": {"mag": m, "place": "x", "time": 1700000000000}, "geometry": {"type": "Point", "coordinates": [-66.0, 18.0, 10.0]}}
    got = feeds.quakes(payloads(spark, json.dumps({"features": [feature("a", 4.7), feature("b", 2.5)]}), "rubbish")).collect()
    assert [(r["event_id"], r["mag"], r["significant"], r["depth"]) for r in got] == [("a", 4.7, True, 10.0), ("b", 2.5, False, 10.0)]


def test_script_values(spark):
    script = "var other = 1;\nvar dataByFuel = [{fuel: 'LNG', value: 52,}, {fuel: 'Hydro', value: 15}];\n"
    raw = spark.createDataFrame([(script,)], "s string").select(scripts.script_value(F.col("s"), "dataByFuel")).first()[0]
    assert json.loads(raw) == [{"fuel": "LNG", "value": 52}, {"fuel": "Hydro", "value": 15}]


def test_capacity_history(spark):
    df = spark.createDataFrame([(json.dumps({"daily": {"labels": ["a", "b"], "capacity": [1.0, 2.0]}, "weekly": {"labels": ["c"], "capacity": [3.0]}}),)], "value string")
    assert sorted(map(tuple, feeds.capacity_history(df).collect())) == [("daily", "a", 1.0), ("daily", "b", 2.0), ("weekly", "c", 3.0)]


def test_geojson_files(spark, tmp_path):
    point = {"type": "Feature", "id": "1", "properties": {"name": "x"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"features": [point]}))
    (tmp_path / "b.geojson").write_text(json.dumps({"features": []}))
    (tmp_path / "c.geojson").write_text("{broken")
    assert [(r["x"], r["y"]) for r in feeds.geojson_points(spark, f"{tmp_path}/a.geojson").collect()] == [(1.0, 2.0)]
    assert sorted((r["file"][-9:], r["status"]) for r in feeds.geojson_status(spark, str(tmp_path)).collect()) == [("a.geojson", "ok"), ("b.geojson", "empty"), ("c.geojson", "error")]


def test_bridges(spark, tmp_path):
    head = "STRUCTURE_NUMBER_008,LAT_016,LONG_017,YEAR_BUILT_027,MAX_SPAN_LEN_MT_048"
    (tmp_path / "b.txt").write_bytes("\n".join([head, "'001',18210505,066052950,1970,12.5", "'002',40000000,066000000,1970,1", "'003',00000000,000000000,0,0"]).encode("latin-1"))
    got = feeds.bridges(spark, str(tmp_path / "b.txt")).collect()
    assert [(r["structure"], round(r["lat"], 4), round(r["lon"], 4), r["year_built"], r["span"]) for r in got] == [("001", 18.3514, -66.0915, 1970, 12.5)]


def shp(kind, bodies):
    records = b"".join(struct.pack(">2i", i + 1, (len(b) + 4) // 2) + struct.pack("<i", kind) + b for i, b in enumerate(bodies))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2i", 1000, kind) + bytes(64) + records


def dbf(name, values):
    head = struct.pack("<B3BIHH20x", 3, 1, 1, 1, len(values), 65, 9) + name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([8, 0]) + bytes(14) + b"\r"
    return head + b"".join(b" " + v.encode().ljust(8) for v in values)


def test_zipped_shapefiles(spark, tmp_path):
    ring = struct.pack("<4d", 0, 0, 1, 1) + struct.pack("<3i", 1, 4, 0) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("al01_pgn.shp", shp(5, [ring]))
        z.writestr("al01_pgn.dbf", dbf("STATEFP", ["72"]))
        z.writestr("al01_pts.shp", shp(1, [struct.pack("<2d", 3, 4), struct.pack("<2d", 5, 6)]))
        z.writestr("al01_pts.dbf", dbf("STATEFP", ["72", "36"]))
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    shapes = files.shapefiles(spark, f"{tmp_path}/*.zip", F.col("properties")["STATEFP"] == "72")
    got = sorted((r["part"], r["kind"], [[tuple(p) for p in part] for part in r["parts"]]) for r in files.storm_parts(shapes).collect())
    assert got == [("cone", "polygon", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]), ("points", "point", [[(3.0, 4.0)]])]


@pytest.mark.parametrize("deflated", [False, True])
def test_rasters(spark, tmp_path, deflated):
    values = struct.pack("<6f", 0, 1, 2, 3, 4, 5)
    body = zlib.compress(values) if deflated else values
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 32), (259, 3, 1, 8 if deflated else 1), (273, 4, 1, 400), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, len(body)), (339, 3, 1, 3), (33550, 12, 3, 300), (33922, 12, 6, 330)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", *t[:3]) + struct.pack("<I" if t[1] != 3 else "<H2x", t[3]) for t in tags)
    data = bytearray(500)
    data[:8], data[8 : 8 + len(ifd)] = struct.pack("<2sHI", b"II", 42, 8), ifd
    data[300:324], data[330:378], data[400 : 400 + len(body)] = struct.pack("<3d", 30, 30, 0), struct.pack("<6d", 0, 0, 0, 1000, 2000, 0), body
    (tmp_path / "dem.tif").write_bytes(bytes(data))
    got = [tuple(r)[1:] for r in files.elevations(spark, str(tmp_path / "dem.tif"), 1).orderBy("row", "col").collect()]
    assert got == [(i // 3, i % 3, 1015.0 + 30 * (i % 3), 1985.0 - 30 * (i // 3), float(i)) for i in range(6)]
    assert files.elevations(spark, str(tmp_path / "dem.tif"), 2).count() == 2


def test_map_services(spark):
    rings = [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]], [[5.0, 5.0], [6.0, 5.0], [5.0, 5.0]]]
    page = json.dumps({"features": [{"attributes": {"id": "1"}, "geometry": {"rings": rings}}, {"attributes": {"id": "2"}, "geometry": {"x": 1.0, "y": 2.0}}]})
    assert [(r["attributes"]["id"], r["kind"], len(r["polygons"] or [])) for r in files.esri_features(payloads(spark, page)).collect()] == [("1", "MultiPolygon", 2), ("2", "Point", 0)]
    census = json.dumps([["part", "whole", "state", "county", "tract"], ["3", "4", "72", "001", "000100"], ["x", "4", "72", "001", "000200"], ["9", "4", "72", "001", "000300"]])
    assert [tuple(r) for r in files.census_rates(payloads(spark, census, "[]"), "part", "whole", 0.4).collect()] == [("72001000100", 0.75), ("72001000200", 0.4), ("72001000300", 1.0)]
    found = json.dumps({"elements": [{"id": 1, "center": {"lat": 18.0, "lon": -66.0}, "tags": {"ref": "PR-1", "length": "n/a", "maxlength": "12"}}]})
    assert tuple(files.mapped_bridges(payloads(spark, found)).first()) == (1, "PR-1", 18.0, -66.0, 12.0)


def test_parcel_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"properties": {"num": n, "salesdttm": t}}) for n, t in (("a", 0), ("b", 10**18), ("c", None))))
    assert [(r["num"], r["salesdttm"] and r["salesdttm"].year) for r in files.parcel_lines(spark, str(tmp_path), "num string").orderBy("num").collect()] == [("a", 1970), ("b", None), ("c", None)]


def test_names_and_tags(spark):
    df = spark.createDataFrame([("/x/y/g01_Flood Zones.geojson", 200000.0)], "f string, x double")
    assert df.select(files.table_name(F.col("f"), "g01_")).first()[0] == "flood_zones"
    assert files.metric_despite_tag(df, "x")


def test_paged_source(spark):
    def fetch(offset, limit):
        return [(i,) for i in range(offset, min(offset + limit, 25))]

    spark.dataSource.register(feeds.paged_source(fetch, "n long", 10, "test_pages"))
    assert spark.read.format("test_pages").load().count() == 25


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", -66.1, 18.4), ("b", -66.2, 18.5)], "name string, x double, y double")
    sinks.write_features(df, f"{tmp_path}/out", "x", "y", ["name"])
    assert feeds.geojson_text(df, "x", "y", ["name"]).count() == spark.read.text(f"{tmp_path}/out").count()
    made = json.loads(sinks.feature_collection(df, "x", "y", ["name"]).first()[0])
    assert [f["properties"]["name"] for f in made["features"]] == ["a", "b"]
    for r in sinks.tiles(df, "x", "y", 10, "places", ["name"]).collect():
        west, south, east, north = sinks.tile_bounds(10, r["tile_x"], r["tile_y"])
        lon, lat = {"a": (-66.1, 18.4), "b": (-66.2, 18.5)}[r["name"]]
        assert west <= lon < east and south < lat <= north and 0 <= r["px"] < 4096 and 0 <= r["py"] < 4096


SCRIPT = r"""
// var ignored = [1];
/* const also = {a: 1}; */
const text = "data = [9]; it's";
const data = [{ Desc: 'ends with ];', n: -1.50, 'k': [1, 2, {x: null,},], 3: .5, ok: true }, 'it\\'s "so"', "l\u00e9on", undefined, 0x1F,];
let open_ = [1, (2)];
window.chart = { "a": `b\nc`, deep: {deeper: [[], {}]} };
const cut = [1, 2
"""


def test_literals_in_scripts(spark):
    import json

    got = {n: v and json.loads(v) for n, v in scripts.literals(SCRIPT.replace("\\\\", "\\"))}
    assert got["data"] == [{"Desc": "ends with ];", "n": -1.5, "k": [1, 2, {"x": None}], "3": 0.5, "ok": True}, 'it\'s "so"', "l\u00e9on", None, 31]
    assert got["chart"] == {"a": "b\nc", "deep": {"deeper": [[], {}]}}
    assert got["open_"] is None and got["cut"] is None and set(got) == {"data", "open_", "chart", "cut"}
    scripts.register(spark)
    spark.createDataFrame([(1, "var a = {b: 'x];y'}; c = [1]"), (2, None), (3, "nothing")], "id int, script string").createOrReplaceTempView("scripts")
    rows = spark.sql("select id, name, value from scripts, lateral script_literals(script)").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", '{"b":"x];y"}'), (1, "c", "[1]")]


def collection(n):
    """A collection in one line, with braces and quotes in strings, a reference system, bad features and one of 20,000 bytes."""
    made = []
    for i in range(n):
        note = f'say \\"{{{i}}}\\" or }}{{ or \\\\' if i % 3 else "é" * (10_000 if i == 7 else 2)
        place = f'{{"type":"Point","coordinates":[{i}.5,{i}]}}' if i % 5 else "null"
        made.append(f'{{"geometry":{place}, "type":"Feature","properties":{{"id":{i},"note":"{note}","more":{{"deep":[{{}},{{"a":"}}"}}]}}}}}}')
    return '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"x}"}},"features":[' + ",".join(made) + "]}"


@pytest.mark.parametrize("split", [256, 1500, 1 << 20])
def test_collections_in_splits(spark, tmp_path, split):
    texts = {"a.json": collection(200), "b.json": collection(1), "c.json": "", "d.json": json.dumps(json.loads(collection(30)), indent=1) + "\n" + collection(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "64", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        read = collections.features(spark, str(tmp_path), "id int, note string")
        rows = read.select(F.element_at(F.split("file", "/"), -1), "properties.id", "properties.note", "geometry.coordinates", "good").collect()
        counts = {r[0].rpartition("/")[2]: (r.features, r.bad) for r in collections.status(read).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = []
    for name, n in (("a.json", 200), ("b.json", 1), ("d.json", 30), ("d.json", 3)):
        for f in json.loads(collection(n))["features"]:
            spot = f["geometry"] and f["geometry"]["coordinates"]
            expected.append((name, f["properties"]["id"], f["properties"]["note"], spot, spot is not None))
    found = [(*r[:3], r[3] and json.loads(r[3]), r[4]) for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert counts == {"a.json": (200, 40), "b.json": (1, 1), "d.json": (33, 7)}


def test_collections_cut_off(spark, tmp_path):
    (tmp_path / "a.json").write_text(collection(10)[:-60])
    assert collections.status(collections.features(spark, str(tmp_path), "id int")).select("features", "bad").collect() == [(10, 3)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"a":{}} {"a":"{"}\n{"b":1}')
    assert sorted(r.text.strip() for r in collections.objects(spark, str(tmp_path / "b"), 1).collect()) == ['{"a":"{"}', '{"a":{}}', '{"b":1}']
