"""Hazard, composite, community, vulnerability, exposure and site scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import global_rank, place, weighted_blend
from . import bits, spatial

# Base probability of failure by flood zone, and outside all zones.
FLOOD_ZONES = {"VE": 0.85, "AE": 0.70, "A": 0.60, "AO": 0.40, "X": 0.05}
NO_ZONE = 0.03
# What sea-level rise and surge add; (least degrees, addition) of slopes; (most metres, addition) of faults.
SEA_LEVEL, SURGE = 0.30, 0.25
SLOPES = [(20.0, 0.15), (10.0, 0.08)]
FAULTS = [(500.0, 0.30), (2000.0, 0.15), (5000.0, 0.05)]
MOST = 0.95
# Fixed values: (scenario, sea-level rise, surge, flood multiplier, seismic).
SCENARIOS = [("cat3", False, True, 1.5, False), ("slr2ft", True, False, 1.0, False), ("combined", True, True, 1.5, False), ("quake", False, False, 0.0, True)]
# Recovery by intervention, and without one.
RECOVERY = {"relocation": 0.9, "elevation": 0.8, "hardening": 0.7, "redundant_feed": 0.5}
NO_RECOVERY = 0.3
# Load in kW a person, value of lost load in USD a kWh, outage hours a year, present value of 30 years.
LOST_LOAD = (0.822, 5.0, 33.6, 17.29)
# Metres within which homes are displaced, and the share of their value.
RELOCATION = (500.0, 0.05)
# Weights of vulnerability where social shares are known, and shares where an area's own are not.
SOCIAL_WEIGHTS = {"poverty": 0.30, "elderly": 0.15, "disabled": 0.10, "flood": 0.30, "slope": 0.15}
USUAL_SHARES = {"elderly": 0.185, "disabled": 0.255}
# Weights of site criteria.
SITE_WEIGHTS = {
    "power_access": 0.18, "grid_reliability": 0.15, "flood_safety": 0.20, "water_access": 0.12, "road_access": 0.15, "port_access": 0.15,
    "land_value": 0.05, "bulk_port_access": 0.0, "air_access": 0.0, "dev_impact": 0.0,
}


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario string, sea_level boolean, surge boolean, multiplier double, seismic boolean")


def _step(value: Column, steps: list[tuple[float, float]], at_least: bool) -> Column:
    out = F.lit(0.0)
    for bound, extra in reversed(steps):
        out = F.when((value >= bound) if at_least else (value <= bound), F.lit(extra)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def hazard(assets: DataFrame) -> DataFrame:
    """Adds ``scenario`` and ``hazard``: all scenarios in one pass.

    assets: zone, in_sea_level, in_surge, slope (NULL beyond reach), fault_distance (NULL beyond reach).
    """
    base = F.lit(NO_ZONE)
    for zone, p in FLOOD_ZONES.items():
        base = F.when(F.col("zone") == zone, F.lit(p)).otherwise(base)
    every = assets.join(F.broadcast(scenarios(assets.sparkSession)), F.lit(True))
    total = (
        F.least(base * F.col("multiplier"), F.lit(MOST))
        + F.when(F.col("sea_level") & F.col("in_sea_level"), SEA_LEVEL).otherwise(0.0)
        + F.when(F.col("surge") & F.col("in_surge"), SURGE).otherwise(0.0)
        + _step(F.col("slope"), SLOPES, True)
        + F.when(F.col("seismic"), _step(F.col("fault_distance"), FAULTS, False)).otherwise(0.0)
    )
    return every.withColumn("hazard", F.round(F.least(total, F.lit(MOST)), 4)).drop("sea_level", "surge", "multiplier", "seismic")


def composite(scored: DataFrame) -> DataFrame:
    """Adds composite = hazard * cascade * (1 + betweenness) and its rank in each scenario; gaps take background values."""
    # products of short decimals: a last digit of 5 rounds up, whatever its binary rest
    value = F.coalesce("hazard", F.lit(NO_ZONE)) * F.col("cascade") * (1 + F.coalesce("betweenness", F.lit(0.0)))
    return place(scored.withColumn("composite", F.round(value + 1e-9, 4)), ["scenario"], [F.col("composite").desc(), F.col("entity")])


def community(areas: DataFrame) -> DataFrame:
    """Adds ``density`` and ``resilience`` from svi, facilities, population and intervention (NULL: none)."""
    # LEAST passes over a NULL density, so an area without people counts as fully served
    density = F.least(F.try_divide(F.col("facilities"), F.col("population") / 1000.0), F.lit(0.02)) / 0.02
    recovery = F.lit(NO_RECOVERY)
    for kind, factor in RECOVERY.items():
        recovery = F.when(F.col("intervention") == kind, F.lit(factor)).otherwise(recovery)
    return areas.withColumn("density", density).withColumn("resilience", F.round(0.5 * (1 - F.col("svi")) + 0.3 * F.col("density") + 0.2 * recovery, 4))


def vulnerability(areas: DataFrame, social: bool = False) -> DataFrame:
    """Adds ``svi``: percent rank of 0.7 flood + 0.3 slope score, where no slope counts as 38 degrees.

    social: a blend with the columns poverty, elderly and disabled, whose unknown shares of old and disabled people take
    the usual ones; an area of unknown poverty has no blend and comes last.
    """
    slope = 1 - F.least(F.coalesce("slope", F.lit(38.0)) / 76.0, F.lit(1.0))
    blend = 0.7 * F.col("flood") + 0.3 * slope
    if social:
        w = SOCIAL_WEIGHTS
        share = lambda name: F.coalesce(name, F.lit(USUAL_SHARES[name])) * w[name]
        blend = F.col("poverty") * w["poverty"] + share("elderly") + share("disabled") + F.col("flood") * w["flood"] + slope * w["slope"]
    return global_rank(areas.withColumn("blend", F.round(blend, 6)), "blend", "svi", percent=True)


def exposure(reached: bits.Levels, powers: DataFrame, people: DataFrame) -> DataFrame:
    """root, population, benefit and economic part of what each root powers; an entity served at two depths counts twice.

    reached: with every depth of a walk; people: entity, population, income.
    """
    per_person = 1.0
    for x in LOST_LOAD:
        per_person *= x
    amounts = people.select("entity", F.col("population").cast("long").alias("population"), (F.col("population") * F.col("income")).alias("earned"))
    out = bits.sums_over_walks(reached, powers, amounts, ["population", "earned"]).withColumn("income", F.try_divide("earned", "population"))
    return out.select("root", "population", F.round(F.col("population") * per_person, 2).alias("benefit"), F.round(F.col("population") * per_person * 0.4, 2).alias("economic"), F.round(F.col("population") * F.coalesce("income", F.lit(0.0)) / 365, 2).alias("daily"))


def relocation(reached: bits.Levels, powers: DataFrame, people: DataFrame, roots: DataFrame, homes: DataFrame) -> DataFrame:
    """root, housing (units within RELOCATION metres of it) and property_impact, for every root.

    people: entity, population, home_value; roots: root, ax, ay; homes: housing, bx, by.  The value of a home is that of
    the people whom the root powers, weighted by how many they are; without any the impact is 0.
    """
    metres, rate = RELOCATION
    amounts = people.select("entity", F.col("population").cast("long").alias("population"), (F.col("population") * F.col("home_value")).alias("worth"))
    worth = bits.sums_over_walks(reached, powers, amounts, ["population", "worth"]).select("root", F.try_divide("worth", "population").alias("home_value"))
    near = spatial.within_distance(roots, homes, metres).groupBy("root").agg(F.sum("housing").alias("housing"))
    out = roots.select("root").join(near, "root", "left").join(worth, "root", "left").na.fill(0, ["housing"]).na.fill(0.0, ["home_value"])
    return out.select("root", "housing", F.round(F.col("housing") * F.col("home_value") * rate, 2).alias("property_impact"))


def reached_vulnerability(reached: bits.Levels, powers: DataFrame, people: DataFrame) -> DataFrame:
    """root and svi: the mean of what each root powers by population, 0.5 where unknown or nobody is.

    people: entity, population, svi.
    """
    counted = F.coalesce("population", F.lit(0)).cast("long")
    amounts = people.select("entity", counted.alias("population"), (counted * F.coalesce("svi", F.lit(0.5))).alias("weighted"))
    sums = bits.sums_over_walks(reached, powers, amounts, ["population", "weighted"])
    return reached.roots.select("root").join(sums, "root", "left").select("root", F.coalesce(F.try_divide("weighted", "population"), F.lit(0.5)).alias("svi"))


def site_scores(sites: DataFrame, near: dict[str, str], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds a score s_<name> per distance column (the nearer the better, by percent rank) and their blend."""
    for name, column in near.items():
        sites = global_rank(sites, column, "_p", percent=True).withColumn(f"s_{name}", F.when(F.col(column).isNotNull(), 1 - F.col("_p"))).drop("_p")
    chosen = {f"s_{n}": (weights or SITE_WEIGHTS)[n] for n in near}
    return sites.withColumn("composite", F.round(weighted_blend(chosen), 6))


def rank_movement(history: DataFrame, top: int = 10, step: int = 3, most: int = 5) -> DataFrame:
    """Entities in the top now that are new there, came from outside the top or moved by ``step``; at most ``most`` a scenario.

    history: scenario, run, entity, rank.
    """
    runs = history.groupBy("scenario").agg(F.max("run").alias("run"))
    older = history.join(runs.withColumnRenamed("run", "_newest"), "scenario").where(F.col("run") < F.col("_newest")).groupBy("scenario").agg(F.max("run").alias("run"))
    now = history.join(runs, ["scenario", "run"]).select("scenario", "entity", "rank")
    before = history.join(older, ["scenario", "run"]).select("scenario", "entity", F.col("rank").alias("previous"))
    moved = now.where(F.col("rank") <= top).join(before, ["scenario", "entity"], "left")
    moved = moved.where(F.col("previous").isNull() | (F.col("previous") > top) | (F.abs(F.col("rank") - F.col("previous")) >= step))
    few = Window.partitionBy("scenario").orderBy("rank", "entity")  # at most ``top`` rows
    return moved.withColumn("_place", F.row_number().over(few)).where(F.col("_place") <= most).drop("_place")
