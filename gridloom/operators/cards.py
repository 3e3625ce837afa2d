"""Wide rows about a parcel or an area: everything the model knows of it, a struct column a section, NULL where it knows nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking
from . import overlay, spatial
from .parcels import detail, flood_level, sale_history


def power(powers: DataFrame, sources: DataFrame, consequences: DataFrame, scores: DataFrame, scenario: str = "cat3") -> DataFrame:
    """area, source, name, edge_confidence, composite, and what fails with the source: the surest source of each area.

    powers: src, dst (an area), confidence; sources: source, name (a row each); consequences: source, headline, people,
    hospitals, plants, centers (a row each); scores: scenario, source, composite.  Ties go to the lesser source.
    """
    best = ranking.latest(powers.join(sources, F.col("src") == F.col("source"), "left_semi"), ["dst"], F.col("confidence").desc_nulls_last(), F.col("src"))
    risk = scores.where(F.col("scenario") == scenario).groupBy("source").agg(F.max("composite").alias("composite"))
    known = best.select(F.col("dst").alias("area"), F.col("src").alias("source"), F.col("confidence").alias("edge_confidence")).join(sources.select("source", "name"), "source")
    known = known.join(consequences.select("source", "headline", "people", "hospitals", "plants", "centers"), "source", "left").join(risk, "source", "left")
    return known.select("area", "source", "name", "edge_confidence", "composite", "headline", "people", "hospitals", "plants", "centers")


def community(scores: DataFrame) -> DataFrame:
    """area, score and percentile (percent rank of the score among all areas that have a row, unknown scores last)."""
    ranked = ranking.global_rank(scores.select("area", F.col("resilience").alias("score")), "score", "percentile", percent=True)
    return ranked.where(F.col("score").isNotNull())


def road_access(travel: DataFrame) -> DataFrame:
    """area, hospital and minutes; areas from which none is reached have no row."""
    return travel.where(F.col("hospital").isNotNull()).select("area", "hospital", "minutes")


def flood(shapes: DataFrame, zones: DataFrame, key: str, unit: float = 0.01, size: int = 1 << 16) -> DataFrame:
    """key, fraction (3 digits), level and worst_zone (the last label) of every shape.

    shapes: key (whole numbers), rings; zones: zone (whole numbers), label, rings.  Overlapping zones count each, up to 1.
    A shape without an area has fraction 0.
    """
    # a zone that a shape only touches counts for its label
    common = overlay.shared(shapes.select(key, "rings"), zones.select("zone", "rings", "label"), key, "zone", unit, size, kind="label")
    sums = common.groupBy(key).agg(F.sum("common").alias("wet"), F.max("label").alias("worst_zone"))
    whole = areas_of(shapes, key)
    share = F.least(F.greatest(F.coalesce(F.try_divide("wet", "whole"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = shapes.select(key).join(whole, key, "left").join(sums, key, "left").withColumn("_share", share)
    return rows.select(key, F.round("_share", 3).alias("fraction"), flood_level(F.col("_share")).alias("level"), "worst_zone")


def areas_of(shapes: DataFrame, key: str) -> DataFrame:
    """key and whole: the area of each shape; holes wind the other way than outer rings."""

    def twice(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.aggregate(F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])

    total = F.aggregate(F.transform("rings", twice), F.lit(0.0), lambda s, t: s + t)
    return shapes.select(key, (F.abs(total) / 2).alias("whole"))


def one_shape(pieces: DataFrame, key: str) -> DataFrame:
    """key and rings of all pieces of a key: borders that two pieces share cancel out where areas are overlaid."""
    return pieces.groupBy(key).agg(F.flatten(F.collect_list("rings")).alias("rings"))


def sales(rows: DataFrame, *then: Column, most: int = 25) -> DataFrame:
    """parcel and sales: its last ones as structs, the latest first."""
    last = sale_history(rows.where(F.col("sold").isNotNull()), "parcel", "sold", *then, most=most)
    held = [c for c in rows.columns if c != "parcel"]
    each = F.array_sort(F.collect_list(F.struct("sale_rank", *held)))
    return last.groupBy("parcel").agg(F.transform(each, lambda s: F.struct(*(s[c].alias(c) for c in held))).alias("sales"))


def parcel_cards(pieces: DataFrame, areas: DataFrame, sold: DataFrame, by_area: dict[str, DataFrame], zones: DataFrame, sites: DataFrame, cell: float, unit: float = 0.01, size: int = 1 << 16) -> DataFrame:
    """A row a parcel: its own fields, ``area`` that holds it, and the sections record, sales, flood, site and those of ``by_area``.

    pieces: parcel (whole numbers), value, cuerdas, rings, x, y and more: the piece of the highest value speaks for the
    parcel (ties to the lesser x, y); areas: area, ring; sold: as ``sales`` gives it; by_area: tables by area, a row each;
    sites: parcel, site, use_type, composite (the best one is shown).
    """
    own = ranking.latest(pieces.drop("rings"), ["parcel"], F.col("value").desc_nulls_last(), F.col("x"), F.col("y"))
    counts = pieces.groupBy("parcel").agg(F.count("*").alias("pieces"), F.sum("cuerdas").alias("total_cuerdas"))
    fields = [c for c in own.columns if c not in ("parcel", "x", "y", "cuerdas")]
    record = own.join(counts, "parcel").select("parcel", *fields, "pieces", "total_cuerdas")
    inside = spatial.points_in_rings(own.select("parcel", "x", "y"), areas.select("area", "ring"), cell).groupBy("parcel").agg(F.min("area").alias("area"))
    best = ranking.latest(sites, ["parcel"], F.col("composite").desc_nulls_last(), F.col("site"))
    shapes = one_shape(pieces, "parcel")
    cards = detail(own.select("parcel", "x", "y").join(inside, "parcel", "left"), {"record": record, "flood": flood(shapes, zones, "parcel", unit, size), "site": best}, "parcel")
    return detail(cards.join(sold, "parcel", "left"), by_area, "area")


def planned(items: DataFrame, areas: DataFrame, serving: DataFrame) -> DataFrame:
    """area and planned: works of a portfolio on the area itself or on what powers it, in their order.

    items: entity, kind, cost, uplift, place; areas: area (also an entity); serving: area, source.  At most one work an entity
    and scenario, so a card holds few.
    """
    about = areas.select("area", F.col("area").alias("entity")).unionByName(serving.select("area", F.col("source").alias("entity"))).distinct()
    rows = about.join(items.select("entity", "kind", "cost", "uplift", "place"), "entity")
    return rows.groupBy("area").agg(F.array_sort(F.collect_list(F.struct("place", "entity", "kind", "cost", "uplift"))).alias("planned"))


def civic_cards(areas: DataFrame, serving: DataFrame, resilience: DataFrame, travel: DataFrame, zones: DataFrame, items: DataFrame, unit: float = 0.01, size: int = 1 << 16) -> DataFrame:
    """A row an area: its name and town, and the sections power, community, road, flood and planned.

    areas: area (whole numbers), name, town, rings; serving: as ``power`` gives it; items: a portfolio.
    """
    sections = {"power": serving, "community": community(resilience), "road": road_access(travel), "flood": flood(areas, zones, "area", unit, size)}
    cards = detail(areas.drop("rings"), sections, "area")
    return cards.join(planned(items, areas, serving), "area", "left").withColumn("planned", F.coalesce("planned", F.array().cast("array<struct<place:int,entity:bigint,kind:string,cost:double,uplift:double>>")))
