"""Parcels and their owners: search, one row per parcel, sale history, snapshots by month, ownership tables, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranking, text
from .tables import snapshot_deltas

# Sales outside these bounds of price and earliest date are not believed.
PRICES, EARLIEST = (1e3, 5e7), "1980-01-01"
# Upper bounds of the covered fraction, and the flood level below them; more is "high".
FLOOD_LEVELS = ((0.0, "minimal"), (0.1, "low"), (0.4, "moderate"))
# Fixed value: an owner that stands for unknown ones.
PLACEHOLDER = "JOHN DOE"


def sane_sale(amount: Column, date: Column, today: Column) -> Column:
    return amount.between(*PRICES) & date.between(F.lit(EARLIEST).cast("date"), today)


def flood_level(fraction: Column) -> Column:
    """minimal (none covered), low (under a tenth), moderate (under four tenths) or high; NULL is minimal."""
    (_, none), *others = FLOOD_LEVELS
    level = F.when(F.coalesce(fraction, F.lit(0.0)) <= 0, none)
    for bound, name in others:
        level = level.when(fraction < bound, name)
    return level.otherwise("high")


def latest_parcels(rows: DataFrame, parcel: str, sold: str, *then: Column) -> DataFrame:
    """One row per parcel: the last sale, unknown dates last."""
    return ranking.latest(rows, [parcel], F.col(sold).desc_nulls_last(), *then)


def sale_history(sales: DataFrame, parcel: str, sold: str, *then: Column, most: int = 5) -> DataFrame:
    """The last sales of each parcel with sale_rank 1..most."""
    place = F.row_number().over(Window.partitionBy(parcel).orderBy(F.col(sold).desc_nulls_last(), *then))
    return sales.withColumn("sale_rank", place).where(F.col("sale_rank") <= most)


def search(parcels: DataFrame, query: str, parcel: str, texts: list[str], most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first hits in order of parcel, and one row with the count of all hits, of owners and the box around them.

    Digits and dashes search the parcel number by prefix, anything else the texts.
    """
    hits = parcels.where(text.routed_search(query, parcel, *texts))
    summary = hits.agg(F.count("*").alias("total"), F.countDistinct("owner").alias("owners"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    return hits.orderBy(parcel).limit(most), summary


def detail(parcels: DataFrame, sections: dict[str, DataFrame], parcel: str) -> DataFrame:
    """Parcels with a struct column for each section (tables by parcel, at most a row each); NULL where there is none."""
    out = parcels
    for name, section in sections.items():
        held = section.select(parcel, F.struct(*(c for c in section.columns if c != parcel)).alias(name))
        out = out.join(held, parcel, "left")
    return out


def build_owners(parcels: DataFrame, parcel: str, contact: str, town: str, value: str) -> tuple[DataFrame, DataFrame]:
    """parcel_owner (a normalised owner per parcel) and owner_entities (a row per owner).

    The name shown is the most frequent spelling, ties to the least; blank owners are left out.
    """
    owned = parcels.select(F.col(parcel).alias("parcel"), text.owner_key(F.col(contact)).alias("owner"), text.collapse(F.col(contact)).alias("name"), F.col(town).alias("town"), F.col(value).alias("value"))
    owned = owned.where("owner is not null and owner <> ''")
    entities = owned.groupBy("owner").agg(
        F.expr("mode() within group (order by name)").alias("name"), F.count("*").alias("parcels"), F.countDistinct("name").alias("spellings"), F.countDistinct("town").alias("towns"), F.sum("value").alias("value")
    )
    return owned, entities


def largest_owners(entities: DataFrame, most: int = 25) -> DataFrame:
    return entities.where(F.col("owner") != PLACEHOLDER).orderBy(F.col("parcels").desc(), F.col("value").desc_nulls_last(), "owner").limit(most)


def owner_towns(owned: DataFrame) -> DataFrame:
    """owner, town, parcels, value and place: where an owner holds most comes first."""
    by = owned.groupBy("owner", "town").agg(F.count("*").alias("parcels"), F.sum("value").alias("value"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(F.col("parcels").desc(), "town")))


def take_snapshot(parcels: DataFrame, path: str, month: str, parcel: str, sold: str) -> None:
    """Freezes a month: one row per parcel under snapshot_month=<month>; taking a month again replaces it."""
    one = latest_parcels(parcels, parcel, sold)
    one.write.mode("overwrite").parquet(f"{path}/snapshot_month={month}")


def list_snapshots(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return []
    names = (s.getPath().getName() for s in files.listStatus(folder))
    return sorted(n.partition("=")[2] for n in names if n.startswith("snapshot_month="))


def monthly_deltas(spark: SparkSession, path: str, month: str, parcel: str, owner: str, value: str, sold: str) -> DataFrame | None:
    """Changes of a month against the snapshot before it; None for the first."""
    before = [m for m in list_snapshots(spark, path) if m < month]
    if not before:
        return None
    old, new = (spark.read.parquet(f"{path}/snapshot_month={m}") for m in (before[-1], month))
    return snapshot_deltas(old, new, parcel, owner, value, sold).withColumn("to_month", F.lit(month))
