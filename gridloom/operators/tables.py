"""Changes between snapshots, capped results, change-only histories and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import latest


#: Changes of value below this are rounding.
LEAST_CHANGE = 1.0


def snapshot_deltas(old: DataFrame, new: DataFrame, key: str, owner: str = "owner", value: str = "value", sold: str = "sold", least_change: float = LEAST_CHANGE) -> DataFrame:
    """key, change_type, old_value and new_value: new rows, owner and value changes, later sales, by one left join.

    Whether a row was there before is told by a mark, not by its fields: an owner, a value or a sale may be unknown.  An
    owner that is known now and differs, also from an unknown one, is a change; a value must be known in both.
    """
    a, b = (df.select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(value).alias("value"), F.col(sold).alias("sold")) for df in (old, new))
    both = b.alias("b").join(a.withColumn("there", F.lit(True)).alias("a"), "key", "left")
    text = lambda c: F.col(c).cast("string")
    money = lambda c: F.round(c, 2).cast("decimal(18,2)").cast("string")
    change = lambda kind, when, x, y: F.when(when, F.struct(F.lit(kind).alias("change_type"), x.alias("old_value"), y.alias("new_value")))
    there, none = F.col("a.there").isNotNull(), F.lit(None).cast("string")
    changes = F.array_compact(
        F.array(
            change("new_parcel", ~there, none, text("key")),
            change("owner_change", there & F.col("b.owner").isNotNull() & ~F.col("a.owner").eqNullSafe(F.col("b.owner")), text("a.owner"), text("b.owner")),
            change("value_change", there & (F.abs(F.col("b.value") - F.col("a.value")) >= least_change), money("a.value"), money("b.value")),
            change("sale", there & F.col("b.sold").isNotNull() & (F.col("a.sold").isNull() | (F.col("b.sold") > F.col("a.sold"))), text("a.sold"), text("b.sold")),
        )
    )
    return both.select("key", F.explode(changes).alias("c")).select("key", "c.change_type", "c.old_value", "c.new_value")


def changed_rows(df: DataFrame, keys: list[str], order: list[Column | str], fields: list[str]) -> DataFrame:
    """Rows whose fields differ from those of the row before with the same keys, and first rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*fields)
    return df.withColumn("_before", F.lag(now).over(w)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")


def islands(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Adds ``island``: the number of the run of equal labels that a row is in."""
    w = Window.partitionBy(*keys).orderBy(order)
    turns = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_turn", turns).withColumn("island", F.sum("_turn").over(w)).drop("_turn")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Existing rows with incoming ones in their place or beside them; of incoming rows the first in order."""
    new = latest(incoming, keys, *(order or (F.lit(1),)))
    return existing.join(new, keys, "left_anti").unionByName(new)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Existing rows and those incoming whose key is not there yet."""
    return existing.unionByName(latest(incoming, keys, *(order or (F.lit(1),))).join(existing, keys, "left_anti"))


def capped(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows in order, each with the count of all."""
    return df.orderBy(*order).limit(limit).join(F.broadcast(df.agg(F.count("*").alias("total"))), F.lit(True))
