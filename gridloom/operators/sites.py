"""Suitability of sites: ten criteria measured from tables, turned into scores by percent rank, and blended by weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ordered_total, weighted_blend
from ..storage import stored
from . import overlay, spatial
from .scoring import SITE_WEIGHTS

#: What is looked for near a site.
NEAR = ("substation", "water", "port", "bulk_port", "airport")
#: The measure behind each score by percent rank, and whether a higher one is better; flood safety is 1 - flood.
RANKED = {
    "power_access": ("dist_substation", False), "grid_reliability": ("substation_risk", False), "water_access": ("dist_water", False), "road_access": ("minutes", False),
    "port_access": ("dist_port", False), "bulk_port_access": ("dist_bulk_port", False), "air_access": ("dist_airport", False), "dev_impact": ("svi", True), "land_value": ("land_per_m2", False),
}

#: Distinct values of all criteria whose ranks are sent to the tasks: some 10 MB.
HELD_VALUES = 200_000


def nearest_of_kinds(sites: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """site and for each kind of target dist_<kind> and <kind> (its id): one search for all kinds; NULL where there is none.

    sites: site, x, y; targets: kind, target, bx, by.  Ties go to the lesser id.
    """
    kinds = F.explode(F.array(*(F.lit(k) for k in NEAR)))
    asked = sites.select("site", F.col("x").alias("ax"), F.col("y").alias("ay"), kinds.alias("kind")).withColumn("ask", F.struct("site", "kind"))
    found = spatial.nearest(asked, targets.select("kind", "target", "bx", "by"), "ask", "target", radius, keys=("kind",))
    of = lambda kind, column: F.max(F.when(F.col("ask.kind") == kind, F.col(column)))
    pairs = ((of(k, "dist").alias(f"dist_{k}"), of(k, "target").alias(k)) for k in NEAR)
    return found.groupBy(F.col("ask.site").alias("site")).agg(*(c for pair in pairs for c in pair))


def flood_shares(sites: DataFrame, zones: DataFrame, unit: float, size: int) -> DataFrame:
    """site and flood: the areas it has in common with each zone, over its own, at most 1.

    sites: site, area_m2, rings; zones: zone (whole numbers), rings.  Sites without an area have 0.
    """
    common = overlay.shared(sites.select("site", "rings"), zones.select("zone", "rings"), "site", "zone", unit, size)
    share = F.least(F.coalesce(F.try_divide("common", "area_m2"), F.lit(0.0)), F.lit(1.0))
    return sites.select("site", "area_m2").join(common, "site", "left").select("site", share.alias("flood"))


def area_of(sites: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """site and the columns of the area (area, ring) that holds it; of several the one with the least id."""
    held = [c for c in areas.columns if c not in ("area", "ring")]
    inside = spatial.points_in_rings(sites.select("site", "x", "y"), areas, size)
    return inside.groupBy("site").agg(F.min(F.struct("area", *held)).alias("a")).select("site", "a.*")


def measured(sites: DataFrame, targets: DataFrame, areas: DataFrame, travel: DataFrame, zones: DataFrame, parcels: DataFrame, radius: float = 5000.0, unit: float = 0.01, size: int = 1 << 16) -> DataFrame:
    """A row for each site with its ten criteria; what is not known is NULL, and flood then 0.

    sites: site, x, y, rings, area_m2, parcel; targets: kind (keys of NEAR), target, bx, by, risk; areas: area, ring,
    resilience, svi; travel: area, minutes; zones: zone, rings; parcels: parcel, land, owner, total (a row a parcel).
    Ids of sites, targets and zones are whole numbers.
    """
    risk = targets.where("kind = 'substation'").select(F.col("target").alias("substation"), F.col("risk").alias("substation_risk"))
    near = nearest_of_kinds(sites, targets, radius).join(risk, "substation", "left")
    held = area_of(sites, areas, radius).join(travel.select("area", "minutes"), "area", "left")
    out = sites.drop("rings").join(near, "site", "left").join(held, "site", "left").join(flood_shares(sites, zones, unit, size), "site", "left")
    out = out.join(parcels.select("parcel", "land", "owner", "total"), "parcel", "left")
    return out.withColumn("land_per_m2", F.try_divide(F.col("land"), F.col("area_m2")))


def scored(measures: DataFrame, weights: dict[str, float] | None = None, held_values: int = HELD_VALUES) -> DataFrame:
    """Adds s_<criterion> (0 to 1, higher is better; NULL where not known) and their composite.

    A score is the percent rank among all sites, unknown ones last and counted.  All criteria are ranked by one sort of
    their distinct values.  At most HELD_VALUES of those (counted) are sent to where the sites are; more are joined.
    """
    measures = stored(measures, "measures")
    n = measures.count()
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("criterion"), F.col(c).cast("double").alias("value")) for k, (c, _) in RANKED.items())))
    counts = measures.select(each.alias("m")).where("m.value is not null").groupBy("m.criterion", "m.value").agg(F.count("*").alias("_n"))
    ranks = ordered_total(counts, ["criterion"], [F.col("value")], F.col("_n"), "_upto").withColumn("_rank", (F.col("_upto") - F.col("_n")) / F.lit(float(max(1, n - 1))))
    ranks = stored(ranks.select("criterion", "value", "_rank"), "ranks")
    sent = F.broadcast if ranks.count() <= held_values else (lambda df: df)
    out = measures
    for name, (column, higher) in RANKED.items():
        one = ranks.where(F.col("criterion") == name).select(F.col("value").alias("_value"), (F.col("_rank") if higher else 1 - F.col("_rank")).alias(f"s_{name}"))
        out = out.join(sent(one), out[column].cast("double") == one["_value"], "left").drop("_value")
    out = out.withColumn("s_flood_safety", 1 - F.coalesce("flood", F.lit(0.0)))
    return reranked(out, weights)


def reranked(sites: DataFrame, weights: dict[str, float] | None = None, where: Column | None = None) -> DataFrame:
    """The composite by other weights from scores that are there already; given weights replace the usual ones by name."""
    unknown = set(weights or {}) - set(SITE_WEIGHTS)
    if unknown:
        raise ValueError(f"no such criteria: {sorted(unknown)}")
    chosen = SITE_WEIGHTS | (weights or {})
    kept = sites if where is None else sites.where(where)
    return kept.withColumn("composite", weighted_blend({f"s_{k}": w for k, w in chosen.items()}))


def top(sites: DataFrame, most: int = 10) -> DataFrame:
    """The best sites, those without a composite last, ties to the lesser id."""
    return sites.orderBy(F.col("composite").desc_nulls_last(), "site").limit(most)


def scorecard(sites: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """A row for each site and criterion that counts: its score, weight, and what it adds to the composite."""
    chosen = {k: w for k, w in (SITE_WEIGHTS | (weights or {})).items() if w}
    known = sum((F.when(F.col(f"s_{k}").isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for k, w in chosen.items()), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(k).alias("criterion"), F.col(f"s_{k}").alias("score"), F.lit(float(w)).alias("weight")) for k, w in chosen.items()))
    rows = sites.select("site", known.alias("_known"), F.explode(each).alias("e"))
    return rows.select("site", "e.criterion", "e.score", "e.weight", F.try_divide(F.col("e.score") * F.col("e.weight"), F.col("_known")).alias("part"))
