"""Intervention catalogues and portfolios under a budget."""

from __future__ import annotations

import bisect
import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (type, construction USD, yearly upkeep USD, hazard, cascade and betweenness factors after the work).
INTERVENTIONS = [
    ("hardening", 2_500_000.0, 50_000.0, 0.50, 1.00, 1.00),
    ("redundant_feed", 8_000_000.0, 80_000.0, 0.85, 0.60, 0.50),
    ("elevation", 4_500_000.0, 30_000.0, 0.30, 1.00, 1.00),
    ("relocation", 35_000_000.0, 200_000.0, 0.03, 1.00, 1.00),
]
#: Present value of 1 a year for 30 years at 4 percent.
UPKEEP_YEARS = (1 - 1.04**-30) / 0.04


def catalog(assets: DataFrame) -> DataFrame:
    """Every intervention on every asset (entity, hazard, cascade, betweenness, benefit): cost, composites and uplift."""
    spark = assets.sparkSession
    kinds = spark.createDataFrame(INTERVENTIONS, "kind string, construction double, upkeep double, fh double, fc double, fb double")
    every = assets.join(F.broadcast(kinds), F.lit(True))
    before = F.col("hazard") * F.col("cascade") * (1 + F.col("betweenness"))
    after = (F.col("hazard") * F.col("fh")) * (F.col("cascade") * F.col("fc")) * (1 + F.col("betweenness") * F.col("fb"))
    return (
        every.withColumn("cost", F.col("construction") + F.col("upkeep") * UPKEEP_YEARS)
        .withColumn("before", before)
        .withColumn("after", after)
        .withColumn("uplift", F.greatest(F.col("before") - F.col("after"), F.lit(0.0)))
        .withColumn("avoided", F.col("benefit") * (1 - F.col("fh")))
        .withColumn("uplift_per_million", F.col("uplift") / (F.col("cost") / 1e6))
        .withColumn("net_per_million", (F.col("avoided") - F.col("cost")) / (F.col("cost") / 1e6))
        .select("entity", "kind", "cost", "before", "after", "uplift", "avoided", "uplift_per_million", "net_per_million")
    )


PORTFOLIO = "scenario string, place int, entity long, kind string, cost double, uplift double, total_cost double, total_uplift double"


#: Groups that what is left of a scenario is dealt into before its last scan.
PIECES = 16
#: Rows that a task holds before it prunes them again.
HELD = 50_000


def _undominated(frame: pd.DataFrame, columns: list[str], order: list[str]) -> pd.DataFrame:
    """Of one scenario's rows, those that neither an earlier row of the entity nor ``_most`` earlier entities undercut."""
    frame = frame.sort_values(order, ascending=[c in ("entity", "kind", "cost") for c in order], kind="stable")
    most, least, low, keep = frame["_most"].iloc[0], {}, [], []
    for entity, cost in zip(frame["entity"], frame["cost"], strict=True):
        own = least.get(entity, math.inf)
        keep.append(cost < own and (len(low) < most or cost < low[-1]))
        if keep[-1]:
            if own in low:
                low.remove(own)
            least[entity] = cost
            bisect.insort(low, cost)
            del low[int(min(most, len(low))) :]
    return frame.loc[keep, columns]


def contenders(items: DataFrame, budget: float, value: str, order: list[str]) -> DataFrame:
    """The rows of each scenario that can be in its portfolio, taken by ``order`` (cost, entity and kind ascending, others descending).

    A portfolio holds at most m = budget / least cost entities.  A row is out if an earlier row of its entity costs no
    more, or if rows that cost no more come earlier for m other entities.  In the greedy scan all of these would have
    fitted where the row fits, so its entity or m others are taken already.  In a best portfolio (ordered by value) the
    row can be replaced by an earlier one whose entity is not in it, at no loss.  Both hold for any part of the rows, so
    tasks prune their own first and a scenario's last group is small.
    """
    columns = list(dict.fromkeys(["scenario", *order, "entity", "kind", "cost", "uplift", value]))
    fit = items.where((F.col(value) > 0) & (F.col("cost") <= budget)).select(*columns)
    ratio = F.when(F.col("_least") > 0, F.floor(budget / F.col("_least") * (1 + 1e-9))).otherwise(F.lit(None))
    most = fit.groupBy(F.col("scenario").alias("_scenario")).agg(F.min("cost").alias("_least"))
    most = most.select("_scenario", F.coalesce(ratio.cast("double"), F.lit(math.inf)).alias("_most"))
    every = fit.join(F.broadcast(most), F.col("scenario").eqNullSafe(F.col("_scenario"))).select(*columns, "_most")
    both = [*columns, "_most"]

    def prune(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_undominated(own, both, order) for _, own in frame.groupby("scenario", dropna=False)])

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, again = [], 0, HELD
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n > again:
                held = [prune(pd.concat(held))]
                n = len(held[0])
                again = max(HELD, 2 * n)
        if held:
            yield prune(pd.concat(held))

    pruned = every.mapInPandas(tasks, every.schema)
    return pruned.groupBy("scenario", F.pmod(F.xxhash64("entity"), F.lit(PIECES))).applyInPandas(prune, every.schema).select(*columns)


def greedy(items: DataFrame, budget: float, by: str = "uplift_per_million") -> DataFrame:
    """Per scenario, the best value first, one per entity, skipping what no longer fits.

    A scenario's choice is one sequential scan; only its ``contenders`` come to it.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([by, "uplift", "entity", "kind"], ascending=[False, False, True, True])
        spent, gained, taken, rows = 0.0, 0.0, set(), []
        for row in frame.itertuples():
            if row.entity in taken or spent + row.cost > budget:
                continue
            taken.add(row.entity)
            spent, gained = spent + row.cost, gained + row.uplift
            rows.append((row.scenario, len(rows) + 1, row.entity, row.kind, row.cost, row.uplift, spent, gained))
        return pd.DataFrame(rows, columns=["scenario", "place", "entity", "kind", "cost", "uplift", "total_cost", "total_uplift"])

    return contenders(items, budget, "uplift", [by, "uplift", "entity", "kind"]).groupBy("scenario").applyInPandas(choose, PORTFOLIO)


def _hull(options: list[tuple[float, float, str]]) -> list[tuple[float, float, float, int]]:
    """The convex hull of one list from (0, 0) on as steps: rate, cost, value and the number of the option reached."""
    hull = [(0.0, 0.0, -1)]
    for cost, value, j in sorted(((c, v, j) for j, (c, v, _) in enumerate(options) if v > 0), key=lambda p: (p[0], -p[1])):
        if value <= hull[-1][1]:
            continue
        while len(hull) > 1 and (value - hull[-1][1]) * (hull[-1][0] - hull[-2][0]) >= (hull[-1][1] - hull[-2][1]) * (cost - hull[-1][0]):
            hull.pop()
        hull.append((cost, value, j))
    return [(math.inf if b[0] <= a[0] else (b[1] - a[1]) / (b[0] - a[0]), b[0] - a[0], b[1] - a[1], b[2]) for a, b in zip(hull, hull[1:], strict=False)]


def best_choice(options: list[list[tuple[float, float, str]]], budget: float, seconds: float = math.inf) -> tuple[float, list[int], bool]:
    """The most value of at most one (cost, value, name) per list within a budget, and which: dynamic programming with a bound.

    List by list the choices so far that no other beats in cost and value are kept, unless their bound is below a choice
    already known.  The bound fills the budget left with the steps of the other lists' convex hulls, steepest first, the
    last one in part; without that part it is a choice.  When the time is up the best choice so far is given; the last of
    what is returned says whether the choice is proved to be the best.
    """
    hulls = [_hull(own) for own in options]
    order = sorted(range(len(options)), key=lambda i: -max((step[0] for step in hulls[i]), default=0.0))
    steps = sorted(((rate, place, cost, value, j) for place, i in enumerate(order) for rate, cost, value, j in hulls[i]), key=lambda x: (-x[0], x[1]))
    cost, value, levels, proved = np.zeros(1), np.zeros(1), [], True
    until = time.monotonic() + seconds
    for k in range(len(order) + 1):
        rest = [x for x in steps if x[1] >= k]
        upto = np.concatenate([[0.0], np.cumsum([x[2] for x in rest])])
        gain = np.concatenate([[0.0], np.cumsum([x[3] for x in rest])])
        rates = np.array([x[0] if x[2] > 0 else 0.0 for x in rest] + [0.0])
        fits = np.searchsorted(upto, budget - cost, "right") - 1
        low = value + gain[fits]
        high = low + rates[fits] * (budget - cost - upto[fits])
        if k == len(order) or time.monotonic() > until:
            proved = k == len(order) or float(high.max()) <= float(low.max())
            break
        alive = np.flatnonzero(high >= low.max() - 1e-9 * max(1.0, abs(low.max())))
        parts = [(cost[alive], value[alive], alive, np.full(len(alive), -1))]
        for j, (c, v, _) in enumerate(options[order[k]]):
            if v > 0:
                ok = alive[cost[alive] + c <= budget]
                parts.append((cost[ok] + c, value[ok] + v, ok, np.full(len(ok), j)))
        cost, value, parent, pick = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.lexsort((-value, cost))
        at = at[np.concatenate([[True], value[at][1:] > np.maximum.accumulate(value[at])[:-1]])]
        cost, value = cost[at], value[at]
        levels.append((parent[at], pick[at]))
    state, chosen = int(low.argmax()), [-1] * len(options)
    best = float(low[state])
    for _, place, _, _, j in rest[: fits[state]]:
        chosen[order[place]] = j
    for k in range(len(levels) - 1, -1, -1):
        chosen[order[k]] = int(levels[k][1][state])
        state = int(levels[k][0][state])
    return best, chosen, proved


def exact(items: DataFrame, budget: float, value: str = "uplift", seconds: float = math.inf) -> DataFrame:
    """Per scenario, the portfolio of the most value with at most one intervention an entity.

    Beyond ``seconds`` the best found so far is given, with ``proved`` false.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        groups = [g.sort_values("kind") for _, g in frame.groupby("entity", sort=True)]
        _, picks, proved = best_choice([list(zip(g["cost"], g[value], g["kind"], strict=True)) for g in groups], budget, seconds)
        rows, spent, gained = [], 0.0, 0.0
        for g, j in zip(groups, picks, strict=True):
            if j >= 0:
                r = g.iloc[j]
                spent, gained = spent + r["cost"], gained + r["uplift"]
                rows.append((r["scenario"], len(rows) + 1, r["entity"], r["kind"], r["cost"], r["uplift"], spent, gained, proved))
        return pd.DataFrame(rows, columns=["scenario", "place", "entity", "kind", "cost", "uplift", "total_cost", "total_uplift", "proved"])

    return contenders(items, budget, value, [value, "cost", "entity", "kind"]).groupBy("scenario").applyInPandas(choose, f"{PORTFOLIO}, proved boolean")


def portfolio(items: DataFrame, budget: float, seconds: float = 30.0) -> DataFrame:
    """The exact choice by net benefit where any item has a benefit, else the greedy one by uplift.

    items: as for ``greedy``, with benefit (equity counted in), economic and property.
    """
    if items.where(F.col("benefit") > 0).isEmpty():
        return greedy(items, budget).withColumn("proved", F.lit(False))
    net = F.col("benefit") + F.coalesce("economic", F.lit(0.0)) - F.coalesce("property", F.lit(0.0)) - F.col("cost")
    return exact(items.withColumn("net", net), budget, "net", seconds)


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: differences in cost and uplift, and counts of items only in a, only in b and in both."""
    both = a.select(*keys, F.col("cost").alias("ca"), F.col("uplift").alias("ua"), F.lit(1).alias("a")).join(b.select(*keys, F.col("cost").alias("cb"), F.col("uplift").alias("ub"), F.lit(1).alias("b")), keys, "full")
    # decimals: the same sums in any order
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,4)" if c[0] == "c" else "decimal(20,8)")), F.lit(0)).cast("decimal(38,8)")
    return both.agg(
        (total("cb") - total("ca")).cast("double").alias("delta_cost"), F.round((total("ub") - total("ua")).cast("double"), 4).alias("delta_uplift"),
        F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"),
    )


def store_run(items: DataFrame, path: str, run: str, computed_at: str) -> None:
    """Keeps a portfolio as run ``run``, computed at a time in ISO form; storing a run again replaces it."""
    items.withColumn("computed_at", F.lit(computed_at).cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{path}/run={run}")


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """run, computed_at, items, cost and uplift of each run kept; a run of no item has no row."""
    kept = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(f"{path}/run=*")
    return kept.groupBy(F.col("run").cast("string").alias("run"), "computed_at").agg(F.count("*").alias("items"), F.sum("cost").alias("cost"), F.sum("uplift").alias("uplift"))


def last_run(spark: SparkSession, path: str) -> DataFrame:
    """The items of the run computed last, of two at one time the later name."""
    kept = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(f"{path}/run=*").withColumn("run", F.col("run").cast("string"))
    newest = kept.groupBy("run", "computed_at").agg(F.lit(1)).agg(F.max(F.struct("computed_at", "run")).alias("m")).select("m.run")
    return kept.join(F.broadcast(newest), "run", "left_semi")
