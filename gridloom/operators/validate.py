"""Backtests and sensitivity of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import global_rank, ordered_total
from ..storage import stored


def precision_recall(predicted: DataFrame, actual: DataFrame, keys: list[str], item: str) -> DataFrame:
    """hits, precision and recall of predicted against actual items by key."""
    p, a = predicted.select(*keys, item).distinct().withColumn("p", F.lit(1)), actual.select(*keys, item).distinct().withColumn("a", F.lit(1))
    both = p.join(a, [*keys, item], "full")
    hits = F.count_if((F.col("p") == 1) & (F.col("a") == 1))
    return both.groupBy(*keys).agg(hits.alias("hits"), F.round(F.try_divide(hits, F.count("p")), 4).alias("precision"), F.round(F.try_divide(hits, F.count("a")), 4).alias("recall"))


def rank_stability(scores: DataFrame, key: str, base: str, changed: str, group: str, top: int = 10) -> DataFrame:
    """By group: Spearman's rho of two scores, overlap of their top rows and whether the ranking is stable."""
    own = scores.select(group, key, base, changed).where(F.col(base).isNotNull() & F.col(changed).isNotNull())
    # both scores are ranked at once, by their different values
    stacked = own.select(group, F.inline(F.array(*(F.struct(F.lit(i).alias("_of"), F.col(c).cast("double").alias("_score")) for i, c in enumerate((base, changed))))))
    counts = stacked.groupBy(group, "_of", "_score").agg(F.count("*").alias("_n"))
    totals = ordered_total(counts, [group, "_of"], [F.col("_score")], F.col("_n"), "_upto")
    ranks = stored(totals.select(group, "_of", "_score", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias("_rank")), "ranks")
    ranked = own
    for i, (c, name) in enumerate(((base, "ra"), (changed, "rb"))):
        one = ranks.where(F.col("_of") == i).select(F.col(group), F.col("_score").alias(f"_v{i}"), F.col("_rank").alias(name))
        ranked = ranked.withColumn(f"_v{i}", F.col(c).cast("double")).join(one, [group, f"_v{i}"])
    out = ranked.groupBy(group).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))
    first = lambda c: own.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(c).desc(), F.col(key)))).where(F.col("_place") <= top).select(group, key)
    both = first(base).join(first(changed), [group, key]).groupBy(group).agg(F.count("*").alias("both"))  # ``top`` rows a group
    out = out.join(both, group, "left").na.fill(0, ["both"])
    rho, overlap = F.when(F.col("n") >= 3, F.round("rho", 4)), F.round(F.col("both") / F.least(F.col("n"), F.lit(top)), 4)
    return out.select(group, rho.alias("rho"), overlap.alias("overlap"), F.coalesce((rho >= 0.9) & (overlap >= 0.8), F.lit(False)).alias("stable"))


def sweep(assets: DataFrame, perturbations: DataFrame, top: int = 10) -> DataFrame:
    """By perturbation: how stable the composite ranking of assets (entity, hazard, cascade, betweenness) is under it.

    perturbations: perturbation, hazard_factor, cascade_factor, betweenness_factor, a few rows; all run in one job.
    """
    every = assets.join(F.broadcast(perturbations), F.lit(True))
    score = lambda h, c, b: h * c * (1 + b)
    h, c, b = F.coalesce("hazard", F.lit(0.03)), F.col("cascade"), F.coalesce("betweenness", F.lit(0.0))
    changed = score(F.least(h * F.col("hazard_factor"), F.lit(0.95)), c * F.col("cascade_factor"), b * F.col("betweenness_factor"))
    return rank_stability(every.select("entity", "perturbation", score(h, c, b).alias("base"), changed.alias("changed")), "entity", "base", "changed", "perturbation", top)


def rank_shifts(scores: DataFrame, key: str, base: str, changed: str, most: int = 15) -> DataFrame:
    """key, before, after and shift of the rows whose place changes most when one score replaces the other."""
    both = global_rank(global_rank(scores.select(key, (-F.col(base)).alias("_a"), (-F.col(changed)).alias("_b")), "_a", "before"), "_b", "after")
    moved = both.withColumn("shift", F.col("before") - F.col("after")).where("shift <> 0")
    return moved.select(key, "before", "after", "shift").orderBy(F.abs("shift").desc(), "after", key).limit(most)


def covered(predicted: DataFrame, actual: DataFrame, item: str) -> DataFrame:
    """One row: sorted items that were hit, missed and falsely named."""
    p, a = predicted.select(item).distinct().withColumn("p", F.lit(True)), actual.select(item).distinct().withColumn("a", F.lit(True))
    both = p.join(a, item, "full")
    of = lambda when: F.array_sort(F.collect_list(F.when(when, F.col(item))))
    return both.agg(of(F.col("p") & F.col("a")).alias("hits"), of(F.col("p").isNull()).alias("misses"), of(F.col("a").isNull()).alias("false_alarms"))
