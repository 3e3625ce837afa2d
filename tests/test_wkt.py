from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions.wkt import from_wkt, to_wkt


def test_there_and_back(spark):
    texts = {
        "POINT (1.0 2.5)": ("point", [[(1.0, 2.5)]]),
        "MULTIPOINT (1.0 2.0,3.0 4.0)": ("point", [[(1.0, 2.0), (3.0, 4.0)]]),
        "LINESTRING (0.0 0.0,1.0 1.0)": ("line", [[(0.0, 0.0), (1.0, 1.0)]]),
        "MULTILINESTRING ((0.0 0.0,1.0 1.0),(2.0 2.0,3.0 3.0))": ("line", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]),
        "POLYGON ((0.0 0.0,9.0 0.0,9.0 9.0,0.0 0.0),(5.0 2.0,6.0 3.0,6.0 2.0,5.0 2.0))": ("area", [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)], [(5.0, 2.0), (6.0, 3.0), (6.0, 2.0), (5.0, 2.0)]]),
        "MULTIPOLYGON (((0.0 0.0,9.0 0.0,9.0 9.0,0.0 0.0),(5.0 2.0,6.0 3.0,6.0 2.0,5.0 2.0)),((20.0 0.0,21.0 0.0,21.0 1.0,20.0 0.0)))": None,
        "POLYGON EMPTY": ("area", []),
    }
    read = spark.createDataFrame([(t,) for t in texts], "t string").select("t", from_wkt(F.col("t")).alias("s"))
    for r in read.select("t", "s", to_wkt(F.col("s.kind"), F.col("s.parts")).alias("again")).collect():
        assert r.again == r.t
        if texts[r.t]:
            assert (r.s.kind, [[tuple(p) for p in part] for part in r.s.parts]) == texts[r.t]
    odd = [(" srid=4326;point( 1  2  9 )", [[(1.0, 2.0)]]), ("POINT (1 x)", None), ("CIRCLE (1 2)", None), ("", None), (None, None), ("multipoint((1 2) , (3 4))", [[(1.0, 2.0)], [(3.0, 4.0)]])]
    got = spark.createDataFrame([(t,) for t, _ in odd], "t string").select(from_wkt(F.col("t")).alias("s")).collect()
    assert [r.s and [[tuple(p) for p in part] for part in r.s.parts] for r in got] == [w for _, w in odd]


def test_projection_there_and_back(spark):
    x, y = geo.lambert(F.col("lon"), F.col("lat"))
    spots = spark.createDataFrame([(-66.1, 18.4), (-67.9, 17.8), (-65.2, 18.6), (-66.4333333333333, 17.8333333333333)], "lon double, lat double").select("*", x.alias("x"), y.alias("y"))
    lon, lat = geo.lambert_inverse(F.col("x"), F.col("y"))
    assert spots.select(F.greatest(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat"))))).first()[0] < 1e-10
