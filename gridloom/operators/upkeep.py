"""Keeping the model: confidence tiers, layer checks, rescoring triggers, lookups by what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.feeds import checksum

# Confidence tiers, the surest first.
TIERS = ("authoritative", "modeled", "proxy", "estimated")


def tier_rank(tier: Column) -> Column:
    """1 for the surest; an unknown layer is authoritative."""
    out = F.lit(1)
    for i, name in enumerate(TIERS, 1):
        out = F.when(tier == name, F.lit(i)).otherwise(out)
    return out


def weakest(*tiers: Column) -> Column:
    """A figure's tier: that of its weakest input."""
    worst = F.greatest(*(tier_rank(t) for t in tiers)) if len(tiers) > 1 else tier_rank(tiers[0])
    return F.element_at(F.array(*(F.lit(t) for t in TIERS)), worst)


def table_tiers(inputs: DataFrame, tiers: DataFrame) -> DataFrame:
    """table and tier from inputs (table, layer) and the layers' tiers (layer, tier)."""
    both = inputs.join(tiers, "layer", "left")
    return both.groupBy("table").agg(F.max(tier_rank(F.col("tier"))).alias("_r")).select("table", F.element_at(F.array(*(F.lit(t) for t in TIERS)), F.col("_r")).alias("tier"))


def layer_changes(known: DataFrame, probed: DataFrame, with_content: str | None = None) -> DataFrame:
    """layer, status (updated, skipped or error) and checksum of probed counts (layer, n) against known checksums.

    with_content names a column of a hash of the rows, so that edits which keep the count are seen too.
    """
    mine = checksum(F.col("layer"), F.col("n")) if with_content is None else F.substring(F.sha2(F.concat_ws(":", "layer", F.col("n").cast("string"), F.col(with_content).cast("string")), 256), 1, 16)
    new = probed.withColumn("new_checksum", F.when(F.col("n").isNotNull(), mine))
    both = new.join(known.select("layer", "checksum"), "layer", "left")
    status = F.when(F.col("new_checksum").isNull(), "error").when(F.col("new_checksum").eqNullSafe(F.col("checksum")), "skipped").otherwise("updated")
    return both.select("layer", status.alias("status"), F.coalesce("new_checksum", "checksum").alias("checksum"))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: the number of rows and a hash of them in any order."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("content"))


def rescore_needed(changes: DataFrame, driving: list[str]) -> DataFrame:
    """One row: whether a layer that scores depend on was updated."""
    return changes.agg(F.coalesce(F.bool_or((F.col("status") == "updated") & F.col("layer").isin(driving)), F.lit(False)).alias("rescore"))


def find_entity(entities: DataFrame, kind: str | None = None, name: str | None = None, src_gid: int | None = None, src_table: str | None = None, most: int = 100) -> DataFrame:
    """Entities that meet every condition given; at least one must be."""
    asked = {"kind": kind, "src_gid": src_gid, "src_table": src_table}
    if name is None and all(v is None for v in asked.values()):
        raise ValueError("say at least one of kind, name, src_gid and src_table")
    found = entities
    for column, value in asked.items():
        if value is not None:
            found = found.where(F.col(column) == value)
    if name is not None:
        found = found.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return found.orderBy("name", "src_gid").limit(most)


def nearest_budget(runs: DataFrame, scenario: str, budget: float) -> DataFrame:
    """The run of a scenario whose budget is nearest, the latest of equals."""
    order = F.struct(F.abs(F.col("budget") - budget).alias("off"), (-F.unix_micros("computed_at")).alias("age"), "run_id")
    return runs.where(F.col("scenario") == scenario).agg(F.min_by(F.struct(*runs.columns), order).alias("r")).where("r is not null").select("r.*")


def match_names(names: DataFrame, entities: DataFrame, name: str = "plant") -> DataFrame:
    """name and entity: the entity whose name begins with a plant's, generators first, then shorter names."""
    from ..functions.ranking import latest

    words = names.withColumn("_key", F.lower(F.trim(F.col(name))))
    first = entities.withColumn("_first", F.lower(F.split("name", " ")[0]))
    pairs = words.join(first, F.split("_key", " ")[0] == F.col("_first")).where(F.startswith(F.lower("name"), F.col("_key")))
    return latest(pairs, [name], F.col("is_generator").desc(), F.length("name"), F.col("entity")).select(name, "entity")


def current_state(scores: DataFrame, units: DataFrame) -> DataFrame:
    """entity, baseline = cascade * (1 + betweenness) and whether all its units are offline, with their names sorted."""
    by = units.groupBy("entity").agg(F.bool_and(~F.col("running")).alias("offline"), F.array_join(F.array_sort(F.collect_set("plant")), ", ").alias("plants"))
    base = F.round(F.col("cascade") * (1 + F.coalesce("betweenness", F.lit(0.0))), 4)
    return scores.join(by, "entity", "left").select("entity", base.alias("baseline"), F.coalesce("offline", F.lit(False)).alias("offline"), "plants")
