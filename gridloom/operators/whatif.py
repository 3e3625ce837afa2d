"""What-if: an overlay over the base tables, failures, asset cost models, objectives and transport interventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits, spatial

# Present value of 1 a year for 30 years at 5 percent.
YEARS_5 = 15.3725
# USD a metre and yearly upkeep a metre of rail by terrain, riders a day, share of people who ride.
RAIL = {"standard": 15_000.0, "elevated": 40_000.0, "tunnel": 120_000.0}
RAIL_UPKEEP, RAIL_CAPACITY, RAIL_SHARE = 500.0, 20_000.0, 0.05
# The same of roads by kind of work, vehicles a lane and hour, trips a year, USD a kilometre and person.
ROAD = {"hardening": 2_000.0, "new_corridor": 3_500.0}
ROAD_UPKEEP, ROAD_CAPACITY, TRIPS, TRIP_COST = 50.0, 1_800.0, 12, 0.03
# Bridges: USD below 20 m of span, a metre up to 60 m and beyond, yearly upkeep, tons (posted, standard).
BRIDGE_SHORT, BRIDGE_MID, BRIDGE_LONG, BRIDGE_UPKEEP, BRIDGE_TONS = 3_000_000.0, 250_000.0, 350_000.0, 100_000.0, (23.0, 36.0)
# Minutes of access above which work pays, USD and minutes saved by kind, value of a minute, events a year.
ACCESS_WORK = (("road_hardening", 15.0, 5_000_000.0, 15.0), ("new_access_road", 25.0, 15_000_000.0, 30.0))
MINUTE_VALUE, EVENTS, TIME_NORM = 10.0, 2, 120.0
# USD of benefit for each vulnerable person near a route, share of construction at risk where it floods.
PERSON_VALUE, FLOOD_RISK = 1_000.0, 0.5


# Asset types that a scenario may hold, their geometry, and the model that works out their costs.
PALETTE = [("rail", "line", "rail"), ("road", "line", "road"), ("bridge", "line", "bridge"), ("substation", "point", "transmission")]


def resolved(assets: DataFrame, column: str = "type") -> DataFrame:
    """Adds geometry and model of each asset's type; NULLs for types that no scenario may hold."""
    known = assets.sparkSession.createDataFrame(PALETTE, f"{column} string, geometry string, model string")
    return assets.join(F.broadcast(known), column, "left")


def overlay(base: DataFrame, added: DataFrame | None, removed: DataFrame | None, key: list[str]) -> DataFrame:
    """The base without what a scenario removed and with what it added or changed; the base itself stays as it is."""
    out = base
    if removed is not None:
        out = out.join(removed.select(*key), key, "left_anti")
    if added is not None:
        out = out.join(added.select(*key), key, "left_anti").unionByName(added, allowMissingColumns=True)
    return out


def failure(edges: DataFrame, powers: DataFrame, failed: DataFrame, people: DataFrame, max_depth: int = 20) -> DataFrame:
    """root, kind, entities and population that each failed root takes down; an entity served twice counts once."""
    return bits.served(bits.levels(edges, failed, max_depth), powers, people)


def asset_costs(assets: DataFrame) -> DataFrame:
    """Adds construction, maintenance (30 years), capacity and affected to assets of type rail, road or bridge.

    assets: type, length (m), terrain (rail), work (road), lanes, span (m), posted, population, detour_km.  Other types get NULLs.
    """
    rate = lambda table, column, default: F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in table.items()), F.lit(table[default]))
    kind, length, span = F.col("type"), F.coalesce("length", F.lit(0.0)), F.coalesce("span", F.lit(20.0))
    bridge = F.when(span < 20, BRIDGE_SHORT).when(span <= 60, span * BRIDGE_MID).otherwise(span * BRIDGE_LONG)
    by = lambda rail, road, bridge_: F.when(kind == "rail", rail).when(kind == "road", road).when(kind == "bridge", bridge_)
    return assets.withColumns(
        {
            "construction": by(length * rate(RAIL, "terrain", "standard"), length * rate(ROAD, "work", "hardening"), bridge),
            "maintenance": by(length * (RAIL_UPKEEP * YEARS_5), length * (ROAD_UPKEEP * YEARS_5), F.lit(BRIDGE_UPKEEP * YEARS_5)),
            "capacity": by(F.lit(RAIL_CAPACITY), F.coalesce("lanes", F.lit(2)) * ROAD_CAPACITY, F.when(F.coalesce("posted", F.lit(False)), BRIDGE_TONS[0]).otherwise(BRIDGE_TONS[1])),
            "affected": by(F.floor(F.col("population") * RAIL_SHARE), F.col("population"), F.col("population")),
            "detour_cost": by(F.lit(None).cast("double"), F.col("population") * F.col("detour_km") * TRIP_COST * TRIPS * YEARS_5, F.col("population") * F.col("detour_km") * TRIP_COST * TRIPS * YEARS_5),
        }
    )


def objective(weights: dict[str, float] | None = None) -> Column:
    """Costs less benefits of columns construction ... economic_benefit; lower is better.  A missing weight is 1."""
    w = {c: F.col(c) * (weights or {}).get(c, 1.0) for c in ("construction", "maintenance", "property_impact", "environmental_impact", "disaster_vulnerability", "population_benefit", "economic_benefit")}
    *costs, people, economy = w.values()
    return sum(costs[1:], costs[0]) - (people + economy)


def route_objective(construction: Column, maintenance: Column, flooded: Column, vulnerable_people: Column) -> Column:
    return construction + maintenance + FLOOD_RISK * flooded * construction - PERSON_VALUE * vulnerable_people


def transport_catalog(places: DataFrame, equity: float = 1.0, most: int = 100) -> DataFrame:
    """Work on the access of the ``most`` worst places (entity, minutes, population, svi) beyond a quarter of an hour."""
    spark, limit = places.sparkSession, ACCESS_WORK[0][1]
    worst = places.where(F.col("minutes") > limit).orderBy(F.col("minutes").desc(), "entity").limit(most)
    kinds = spark.createDataFrame(list(ACCESS_WORK), "kind string, above double, cost double, saves double")
    every = worst.join(F.broadcast(kinds), F.col("minutes") > F.col("above"))
    saved = F.least("saves", "minutes")
    before = F.least(F.col("minutes") / TIME_NORM, F.lit(2.0))
    after = F.greatest((F.col("minutes") - saved) / TIME_NORM, F.lit(0.0))
    benefit = F.col("population") * saved * MINUTE_VALUE * EVENTS * YEARS_5
    fair = benefit * (1 + equity * F.coalesce("svi", F.lit(0.0)))
    millions = F.col("cost") / 1e6
    return every.select(
        "entity", "kind", "cost", F.round(before, 4).alias("before"), F.round(after, 4).alias("after"), F.round(before - after, 4).alias("uplift"), F.round((before - after) / millions, 6).alias("uplift_per_million"),
        F.round(benefit, 2).alias("benefit"), F.round(fair, 2).alias("fair_benefit"), F.round((fair - F.col("cost")) / millions, 4).alias("net_per_million"),
    )


def route_costs(cells: DataFrame, keys: list[str], order: str, cell_metres: float) -> DataFrame:
    """keys, island, terrain, metres, construction, maintenance and flooded share of each run of one terrain along a path.

    cells: keys, order, terrain and flood (0 or 1) of the cells of a path.
    """
    from .tables import islands

    rate = F.coalesce(*(F.when(F.col("terrain") == k, F.lit(v)) for k, v in RAIL.items()))
    runs = islands(cells, keys, order, "terrain").groupBy(*keys, "island").agg(F.first("terrain").alias("terrain"), (F.count("*") * cell_metres).alias("metres"), F.avg("flood").alias("flooded"))
    return runs.withColumn("construction", F.col("metres") * rate).withColumn("maintenance", F.col("metres") * (RAIL_UPKEEP * YEARS_5))


def people_along(samples: DataFrame, areas: DataFrame, line: str, area: str, reach: float = 5_000.0) -> DataFrame:
    """line, population and vulnerable (population times svi, 0.5 where unknown) of areas within reach of samples (x, y) of a line.

    areas: area, x, y, population, svi; each counts once a line.
    """
    near = spatial.within_distance(samples.select(line, F.col("x").alias("ax"), F.col("y").alias("ay")), areas.select(area, "population", "svi", F.col("x").alias("bx"), F.col("y").alias("by")), reach)
    once = near.select(line, area, "population", "svi").distinct()
    return once.groupBy(line).agg(F.sum("population").alias("population"), F.sum(F.col("population") * F.coalesce("svi", F.lit(0.5))).alias("vulnerable"))


def evaluate(assets: DataFrame, cells: DataFrame, people: DataFrame, asset: str) -> DataFrame:
    """Assets with their costs, the flooded share of the cells they cross, people along them and the objective of all that.

    cells: asset and flood (0 or 1) a cell; people: asset, population, vulnerable.
    """
    wet = cells.groupBy(asset).agg(F.avg("flood").alias("flooded"))
    known = assets.drop("population").join(people, asset, "left").join(wet, asset, "left").na.fill(0.0, ["flooded", "vulnerable"]).na.fill(0, ["population"])
    return asset_costs(known).withColumn("objective", route_objective(F.col("construction"), F.col("maintenance"), F.col("flooded"), F.col("vulnerable")))


def commit(entities: DataFrame, stations: DataFrame, edges: DataFrame, serves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model with a scenario's stations and its SERVES edges both ways; what is there already stays as it is."""
    from .tables import insert_ignore

    both = serves.select("src", "dst").union(serves.select("dst", "src")).distinct()
    return insert_ignore(entities, stations, ["entity"]), insert_ignore(edges, both, ["src", "dst"])
