import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, ranking, text


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "name,key",
    [("Acme, Inc.", "ACME"), ("ACME LLC", "ACME"), ("acme  corp. inc", "ACME"), ("Peña Núñez", "PENA NUNEZ"), ("LLC", "LLC"), ("CORP HOLDINGS GROUP", "CORP HOLDINGS GROUP"), ("SUCESION RIVERA", "SUCESION RIVERA"), ("A.C.M.E. S.R.L.", "ACME")],
)
def test_owner_key(spark, name, key):
    assert values(spark, [(name,)], "n string", text.owner_key(F.col("n"))) == [key]


def test_address(spark):
    rows = [(" calle  1 ", "Peñuelas"), ("CALLE 1, PENUELAS", "Peñuelas"), ("", "Ponce"), (None, " "), ("Calle 2", None)]
    assert values(spark, rows, "a string, t string", text.address(F.col("a"), F.col("t"))) == ["CALLE 1, PEÑUELAS", "CALLE 1, PENUELAS", "PONCE", None, "CALLE 2"]


def test_headline(spark):
    rows = [(12345, 1, 0, 2), (0, 0, 0, 0), (0, 2, 0, 0), (1000, 1, 1, 1)]
    got = values(spark, rows, "p long, h int, w int, c int", text.outage_headline(F.col("p"), F.col("h"), F.col("w"), F.col("c")))
    assert got == ["Failure affects 12,345 people, 1 hospital and 2 health centers", "No downstream impact", "Failure affects 2 hospitals", "Failure affects 1,000 people, 1 hospital, 1 water plant and 1 health center"]


def test_degrees_and_numbers(spark):
    assert values(spark, [("18210505",), ("00000000",), ("x",)], "d string", F.round(text.degrees(F.col("d"), 2), 4)) == [18.3514, None, None]
    assert values(spark, [("14-16, 30",)], "d string", text.advisory_numbers(F.col("d"))) == [["014", "015", "016", "030"]]


def test_rings(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))))
    row = spark.range(1).select(geo.ring_area(ring), geo.ring_centroid(ring)["x"], geo.line_length(ring), geo.ring_contains(ring, F.lit(1.0), F.lit(1.0)), geo.ring_contains(ring, F.lit(5.0), F.lit(1.0)), geo.segment_distance(F.lit(6.0), F.lit(1.0), ring)).first()
    assert tuple(row) == (8.0, 2.0, 12.0, True, False, 2.0)


def test_projection_puts_its_origin_in_place(spark):
    x, y = geo.lambert(F.lit(-66.4333333333333), F.lit(17.8333333333333))
    row = spark.range(1).select(F.round(x, 3), F.round(y, 3)).first()
    assert tuple(row) == (200000.0, 200000.0)


def test_global_rank_counts_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 1.0)], "k int, v double")
    assert {r["k"]: r["p"] for r in ranking.global_rank(df, "v", "p", percent=True).collect()} == {4: 0.0, 1: pytest.approx(1 / 3), 2: pytest.approx(1 / 3), 3: 1.0}
    assert {r["k"]: r["p"] for r in ranking.global_rank(df, "v", "p", average=True).collect()} == {4: 1.0, 1: 2.5, 2: 2.5, 3: 4.0}


def test_spearman_of_two_rows_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    assert ranking.spearman(df, "a", "b").first()["rho"] is None
