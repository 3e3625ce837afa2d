"""Storm advisories and event catalogues: immutable inserts with replay, what to alert on, revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import latest


def new_advisories(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming advisories (storm, advisory, issued_at, fetched_at, affects, replay) that are not known yet, with ``alert``.

    An advisory is never changed once it is there; of incoming rows for one the first fetched counts.  Only live ones that
    affect the area are alerted on: replayed history stays silent.
    """
    first = latest(incoming, ["storm", "advisory"], F.col("fetched_at").asc_nulls_last(), F.col("issued_at").asc_nulls_last(), F.col("replay"))
    fresh = first.join(known.select("storm", "advisory"), ["storm", "advisory"], "left_anti")
    return fresh.withColumn("alert", ~F.coalesce("replay", F.lit(False)) & F.coalesce("affects", F.lit(False)))


def current_advisory(advisories: DataFrame) -> DataFrame:
    """The one advisory to show: live before replayed, then the last issued (unknown times last), then the last fetched."""
    order = [F.col("replay").asc(), F.col("issued_at").desc_nulls_last(), F.col("fetched_at").desc(), F.col("storm"), F.col("advisory")]
    return advisories.orderBy(*order).limit(1)


def revised(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The catalogue after an upsert: key, fields, revision and is_new.

    existing: key, fields and revision.  A new key begins at revision 1; a row whose fields differ takes the incoming ones
    and the next revision; others stay as they are.
    """
    old = existing.select(key, F.struct(*fields).alias("_old"), "revision")
    new = latest(incoming, [key], *(F.col(f).desc_nulls_last() for f in fields)).select(key, F.struct(*fields).alias("_new"))
    both = old.join(new, key, "full")
    changed = F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))
    now = F.coalesce("_new", "_old")
    return both.select(
        key, *(now[f].alias(f) for f in fields), F.when(F.col("_old").isNull(), 1).otherwise(F.col("revision") + changed.cast("int")).cast("int").alias("revision"), F.col("_old").isNull().alias("is_new")
    )


def new_counts(catalogue: DataFrame, size: str, significant: float = 4.5) -> DataFrame:
    """One row: new ids of an upsert, and how many of these are significant; older ones never are news again."""
    return catalogue.agg(F.count_if("is_new").alias("new"), F.count_if(F.col("is_new") & (F.col(size) >= significant)).alias("significant_new"))
