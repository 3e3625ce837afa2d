"""The model's entities and edges out of source layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import finite
from ..functions.text import collapse
from . import spatial

# Confidence of an edge by how it was found, and the distance up to which a feeder is near.
NEAR_METRES, NEAR, FAR, BY_AREA, BY_OVERLAP = 5_000.0, 0.6, 0.4, 0.5, 0.2
# Links between ways of travel: to a city's nearest area, to the facilities around it, at most so many.
CITY_LINK, FACILITY_LINK, FACILITIES, FACILITY_METRES = 0.8, 0.7, 5, 5_000.0


def entities(layers: dict[str, tuple[str, DataFrame, dict[str, Column]]]) -> DataFrame:
    """entity, kind, name, src_table, src_gid, x, y and attrs of source layers {table: (kind, rows, attributes)}.

    Rows need gid, name, x and y.  Points without finite coordinates are left out, names have single spaces.  The id is
    a hash of table and gid, so a layer that is built again keeps its ids and no task numbers all rows.
    """

    def one(table: str, kind: str, rows: DataFrame, attributes: dict[str, Column]) -> DataFrame:
        pairs = [x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]
        attrs = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        gid = F.col("gid").cast("long")
        return rows.where(finite(F.col("x"), F.col("y"))).select(F.xxhash64(F.lit(table), gid).alias("entity"), F.lit(kind).alias("kind"), F.nullif(collapse(F.col("name")), F.lit("")).alias("name"), F.lit(table).alias("src_table"), gid.alias("src_gid"), "x", "y", attrs.alias("attrs"))

    return reduce(DataFrame.unionByName, [one(t, *spec) for t, spec in layers.items()])


def clean_names(tables: dict[str, DataFrame], column: str = "name") -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables with names of single spaces, and one row with how many rows changed; doing it again changes none."""
    changed = [df.select((~F.col(column).eqNullSafe(collapse(F.col(column)))).cast("long").alias("c")) for df in tables.values()]
    total = reduce(DataFrame.union, changed).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("changed"))
    return {n: df.withColumn(column, collapse(F.col(column))) for n, df in tables.items()}, total


def powers(customers: DataFrame, feeders: DataFrame, customer: str, feeder: str, reach: float = NEAR_METRES, by_area: bool = False) -> DataFrame:
    """src (the nearest feeder), dst, weight (metres) and confidence; the nearest feeder is the owner of the cell a point lies in."""
    near = spatial.nearest(customers, feeders, customer, feeder, reach)
    sure = F.lit(BY_AREA) if by_area else F.when(F.col("dist") <= NEAR_METRES, NEAR).otherwise(FAR)
    return near.select(F.col(feeder).alias("src"), F.col(customer).alias("dst"), F.col("dist").alias("weight"), sure.alias("confidence"))


def overlap_powers(shares: DataFrame, primary: DataFrame, area: str, feeder: str) -> DataFrame:
    """Further feeders of areas: those that own more than a fifth of one and are not its primary feeder (src, dst)."""
    more = shares.where(F.col("share") > BY_OVERLAP).select(F.col(feeder).alias("src"), F.col(area).alias("dst"), F.round(F.least("share", F.lit(1.0)) * 0.5, 3).alias("confidence"))
    return more.join(primary.select("src", "dst"), ["src", "dst"], "left_anti")


def water_serves(areas: DataFrame, plants: DataFrame, area: str, plant: str, key: str) -> DataFrame:
    """src (the nearest plant with the area's key), dst, weight and confidence 0.5."""
    near = spatial.nearest_by_group(areas, plants, [key], area, plant)
    return near.select(F.col(plant).alias("src"), F.col(area).alias("dst"), F.col("dist").alias("weight"), F.lit(BY_AREA).alias("confidence"))


def water_downstream(powers: DataFrame, serves: DataFrame) -> DataFrame:
    """root and areas: distinct areas whose water comes from a plant that the root powers."""
    both = powers.select(F.col("src").alias("root"), F.col("dst").alias("plant")).join(serves.select(F.col("src").alias("plant"), F.col("dst").alias("area")), "plant")
    return both.groupBy("root").agg(F.countDistinct("area").alias("areas"))


def intermodal(cities: DataFrame, areas: DataFrame, facilities: DataFrame, city: str, area: str, facility: str) -> DataFrame:
    """src, dst and confidence: each city and its nearest area both ways, and its nearest facilities within 5 km."""
    near = spatial.nearest(cities, areas, city, area, FACILITY_METRES)
    to = near.select(F.col(city).cast("string").alias("src"), F.col(area).cast("string").alias("dst"), F.lit(CITY_LINK).alias("confidence"))
    few = spatial.nearest(cities, facilities, city, facility, FACILITY_METRES, bounded=True, most=FACILITIES).where("dist is not null")
    return to.union(to.select("dst", "src", "confidence")).union(few.select(F.col(city).cast("string"), F.col(facility).cast("string"), F.lit(FACILITY_LINK)))


def affects(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float] = (-68.5, 16.8, -64.0, 19.5)) -> Column:
    """Whether a box in degrees meets that of the island."""
    return (x1 <= box[2]) & (x2 >= box[0]) & (y1 <= box[3]) & (y2 >= box[1])
