"""Ranks, running totals and rank statistics over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

#: Ranges that distinct values are dealt into.
RANGES = 200


def range_number(df: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """Number of the range of ``column`` that a value lies in; the driver sees only the bounds."""
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx(column, shares, 10_000)).first()[0] or []))
    if not bounds:
        return F.lit(0)
    value = F.col(column)
    at = F.array_position(F.sort_array(F.array_append(F.array(*(F.lit(b) for b in bounds)), value)), value)
    return F.coalesce(at, F.lit(0)).cast("int")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over rows up to and including each, by a unique ``order`` column."""
    dealt = df.withColumn("_range", range_number(df, order))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))  # a row per range
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def ordered_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same keys up to and including each, in an order without ties.

    Rows are dealt into ranges of (keys, order), so neither a large key nor many equal values are one task; what is
    summed without a range is a row per range.  The dealt table is stored: ranges are drawn once.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    dealt = stored(df.withColumn("_value", value).repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))  # a row per range
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside"))
    if keys:
        starts = out.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min(F.col(name) - F.col("_value")).alias("_start"))
        same = F.lit(True)
        for k in keys:
            same = same & out[k].eqNullSafe(starts[f"_{k}"])
        out = out.join(starts, same).withColumn(name, F.col(name) - F.col("_start"))
    return out.select(*df.columns, name)


def place(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row number within keys in an order without ties, as ``ordered_total`` counts it."""
    return ordered_total(df, keys, order, F.lit(1).cast("long"), name)


def average_rank(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Adds the rank within keys by ``column`` ascending, ties at the mean of their places; rows without a value drop out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    totals = ordered_total(counts, keys, [F.col(column)], F.col("_n"), "_upto")
    return df.join(totals.select(*keys, column, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(name)), [*keys, column])


def global_rank(df: DataFrame, column: str, name: str = "rank", percent: bool = False, average: bool = False) -> DataFrame:
    """Rank (1 for the least, ties alike) or percent_rank by ``column`` ascending, NULLs last and counted.

    Values are counted first, so what is ordered is distinct values in ranges, not rows.
    average: ties get the mean of their places.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    totals = running_total(counts, "_value", "_n", "_upto")
    less = F.col("_upto") - F.col("_n")
    n = df.agg(F.count("*").alias("all"), F.count(column).alias("known")).first()
    ranked = df.join(totals, df[column] == totals["_value"], "left")
    if percent:
        value = F.when(F.lit(n["all"] <= 1), F.lit(0.0)).otherwise(F.coalesce(less, F.lit(n["known"])).cast("double") / F.lit(float(max(1, n["all"] - 1))))
    elif average:
        value = F.coalesce(less + (F.col("_n") + 1) / 2.0, F.lit(n["known"] + (n["all"] - n["known"] + 1) / 2.0))
    else:
        value = F.coalesce(less, F.lit(n["known"])) + 1
    return ranked.withColumn(name, value).drop("_value", "_n", "_upto")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rho of the average ranks of two columns; NULL below three rows."""
    both = global_rank(global_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra", average=True), b, "_rb", average=True)
    return both.agg(F.when(F.count("*") >= 3, F.corr("_ra", "_rb")).alias("rho"), F.count("*").alias("n"))


def weighted_blend(parts: dict[str, float]) -> Column:
    """Weighted mean of the columns that are not NULL; columns of weight 0 drop out, and all NULL gives NULL."""
    used = {c: w for c, w in parts.items() if w}
    if not used:
        return F.lit(None).cast("double")
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in used.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in used.items()), F.lit(0.0))
    return F.try_divide(top, weight)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")
