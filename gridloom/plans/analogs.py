"""The model's tables made from the TPC-H-like tables: nodes, feeding and powering edges, points, areas, parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import latest


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(key: str) -> tuple[Column, Column]:
    """A point of every key, scattered over about 10 km."""
    return (F.col(key) * 7919) % 10007, (F.col(key) * 104729) % 10009


def points(df: DataFrame, key: str, prefix: str = "") -> DataFrame:
    x, y = at(key)
    return df.withColumn(f"{prefix}x", x.cast("double")).withColumn(f"{prefix}y", y.cast("double"))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges src -> dst between suppliers, with cycles."""
    s = read(spark, sf_dir, "supplier")
    n = s.count()
    both = F.explode(F.array((F.col("s_suppkey") * 3 + 1) % n, (F.col("s_suppkey") * 5 + 2) % n))
    return s.select(F.col("s_suppkey").alias("src"), both.alias("dst"))


def powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, confidence, weight: each part is powered by the supplier that sold most of it."""
    sold = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("price"))
    top = latest(sold, ["l_partkey"], F.col("q").desc(), F.col("l_suppkey"))
    part = read(spark, sf_dir, "part")
    return top.join(part, top["l_partkey"] == part["p_partkey"]).select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("p_type").alias("kind"), (F.lit(0.4) + 0.05 * (F.col("p_size") % 5)).alias("confidence"), F.col("price").alias("weight")
    )


def criticality(spark: SparkSession) -> DataFrame:
    """Hospital, water plant and health center count 10, 5 and 3, anything else 1."""
    rows = [("ECONOMY", 10.0), ("STANDARD", 5.0), ("PROMO", 3.0), ("SMALL", 1.0), ("MEDIUM", 1.0), ("LARGE", 1.0)]
    return spark.createDataFrame(rows, "kind string, criticality double")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and its box x1, y1, x2, y2 in a grid of five by five."""
    n = F.col("n_nationkey")
    col, row = n % 5, F.floor(n / 5).cast("int")
    return read(spark, sf_dir, "nation").select("n_nationkey", (col * 2002).cast("double").alias("x1"), (row * 2002).cast("double").alias("y1"), ((col + 1) * 2002).cast("double").alias("x2"), ((row + 1) * 2002).cast("double").alias("y2"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parcels at two months: some are new in the second, some changed owner, value or sale, and some fields are unknown."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 10 != 0).select(
        "o_orderkey", F.when(k % 13 != 0, F.col("o_custkey")).alias("owner"), F.when(k % 19 != 0, F.col("o_totalprice")).alias("value"), F.when(k % 29 != 0, F.col("o_orderdate")).alias("sold")
    )
    value = F.when(k % 5 == 0, F.col("o_totalprice") * 2).when(k % 3 == 0, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice"))
    new = o.select(
        "o_orderkey", F.when(k % 17 != 0, F.when(k % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).alias("owner"), F.when(k % 23 != 0, value).alias("value"),
        F.when(k % 31 != 0, F.when(k % 11 == 0, F.col("o_orderdate") + F.expr("interval 30 days")).otherwise(F.col("o_orderdate"))).alias("sold"),
    )
    return old, new


FEEDS_SQL = """feeds as (
  select s_suppkey as src, (s_suppkey * 3 + 1) % (select count(*) from supplier) as dst from supplier
  union select s_suppkey, (s_suppkey * 5 + 2) % (select count(*) from supplier) from supplier
)"""
POWERS_SQL = """powers as (
  select l_suppkey as src, l_partkey as dst, p_type as kind, 0.4::double + 0.05::double * (p_size % 5) as confidence, price as weight
  from (select *, row_number() over (partition by l_partkey order by q desc, l_suppkey) as rn
        from (select l_partkey, l_suppkey, sum(l_quantity) as q, sum(l_extendedprice) as price from lineitem group by 1, 2))
  join part on p_partkey = l_partkey where rn = 1
)"""
REACH_SQL = """reach as (
  select s_suppkey as root, s_suppkey as node, 0 as depth from supplier
  union select r.root, f.dst, r.depth + 1 from reach r join feeds f on f.src = r.node where r.depth < {depth}
)"""
CRITICALITY_SQL = "case kind when 'ECONOMY' then 10.0::double when 'STANDARD' then 5.0::double when 'PROMO' then 3.0::double else 1.0::double end"
AREAS_SQL = """areas as (
  select n_nationkey, (n_nationkey % 5) * 2002.0 as x1, (n_nationkey // 5) * 2002.0 as y1, (n_nationkey % 5 + 1) * 2002.0 as x2, (n_nationkey // 5 + 1) * 2002.0 as y2 from nation
)"""


def points_sql(table: str, key: str, name: str) -> str:
    return f"{name} as (select *, (({key} * 7919) % 10007)::double as x, (({key} * 104729) % 10009)::double as y from {table})"
