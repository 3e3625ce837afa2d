"""Queries of advisories, revisions, cells of areas, pairs of places, asset types, views and repaired rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import advisories, raster, whatif
from ..sources.views import create_views
from .analogs import points, points_sql, read
from .registry import query

# An order is an advisory of the storm of its customer, numbered by priority; even ones were fetched before.
_ADVISORIES = """adv as (select o_custkey as storm, o_orderpriority as advisory, o_orderdate as issued_at, o_orderkey as fetched_at, o_totalprice > 200000 as affects, o_orderstatus = 'F' as replay, o_orderkey % 2 = 0 as old from orders)"""


def _advisories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, d, "orders")
    every = o.select(
        F.col("o_custkey").alias("storm"), F.col("o_orderpriority").alias("advisory"), F.col("o_orderdate").alias("issued_at"), F.col("o_orderkey").alias("fetched_at"),
        (F.col("o_totalprice") > 200000).alias("affects"), (F.col("o_orderstatus") == "F").alias("replay"),
    )
    return every.where("fetched_at % 2 = 0"), every.where("fetched_at % 2 = 1")


@query(
    f"""with {_ADVISORIES}, firsts as (select *, row_number() over (partition by storm, advisory order by fetched_at) as rn from adv where not old)
select storm, advisory, fetched_at, replay, not replay and affects as alert from firsts f where rn = 1 and not exists (select 1 from adv a where a.old and a.storm = f.storm and a.advisory = f.advisory)"""
)
def advisory_insert(spark: SparkSession, d: str) -> DataFrame:
    return advisories.new_advisories(*_advisories(spark, d)).select("storm", "advisory", "fetched_at", "replay", "alert")


@query(f"with {_ADVISORIES} select storm, advisory, issued_at, fetched_at, replay from adv order by replay, issued_at desc nulls last, fetched_at desc limit 1")
def current_advisory(spark: SparkSession, d: str) -> DataFrame:
    known, new = _advisories(spark, d)
    return advisories.current_advisory(known.unionByName(new)).select("storm", "advisory", "issued_at", "fetched_at", "replay")


_REVISED = """old as (select c_custkey, c_mktsegment as segment, c_nationkey::double / 4 as size, (c_custkey % 3 + 1)::int as revision from customer where c_custkey % 5 <> 0),
new as (select c_custkey, case when c_custkey % 7 = 0 then 'MOVED' else c_mktsegment end as segment, c_nationkey::double / 4 as size from customer where c_custkey % 4 <> 0),
merged as (select c_custkey, coalesce(n.segment, o.segment) as segment, coalesce(n.size, o.size) as size,
  case when o.c_custkey is null then 1 when n.c_custkey is not null and n.segment <> o.segment then revision + 1 else revision end as revision, o.c_custkey is null as is_new from old o full join new n using (c_custkey))"""


def _revised(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select(k, F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey").cast("double") / 4).alias("size"))
    old = c.where(k % 5 != 0).withColumn("revision", (k % 3 + 1).cast("int"))
    new = c.where(k % 4 != 0).withColumn("segment", F.when(k % 7 == 0, "MOVED").otherwise(F.col("segment")))
    return advisories.revised(old, new, "c_custkey", ["segment", "size"])


@query(f"with {_REVISED} select c_custkey, segment, size, revision, is_new from merged")
def revised_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return _revised(spark, d)


@query(f'with {_REVISED} select count(*) filter (where is_new) as "new", count(*) filter (where is_new and size >= 4.5) as significant_new from merged')
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    return advisories.new_counts(_revised(spark, d), "size")


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return points(read(spark, d, "supplier"), "s_suppkey").select("s_suppkey", F.array(p(0.25, 0.25), p(900.25, 0.25), p(0.25, 900.25), p(0.25, 0.25)).alias("ring"))


_CELLS = f"{points_sql('supplier', 's_suppkey', 's')}, cells as (select s_suppkey, x + 0.25 as x, y + 0.25 as y, floor(y / 100)::bigint - 1 + r.range as row, floor(x / 100)::bigint - 1 + c.range as col from s, range(12) r, range(12) c)"


@query(f"with {_CELLS} select s_suppkey, row, col from cells where col * 100 + 50 >= x and row * 100 + 50 >= y and col * 100 + 50 - x + row * 100 + 50 - y < 900")
def cells_by_centre(spark: SparkSession, d: str) -> DataFrame:
    return raster.rasterized(_triangles(spark, d), 100.0).select("s_suppkey", "row", "col")


@query(f"with {_CELLS} select s_suppkey, row, col from cells where col * 100 + 100 >= x and row * 100 + 100 >= y and greatest(col * 100, x) - x + greatest(row * 100, y) - y <= 900")
def cells_touched(spark: SparkSession, d: str) -> DataFrame:
    return raster.rasterized(_triangles(spark, d), 100.0, touched=True).select("s_suppkey", "row", "col")


@query(
    f"""with {points_sql('supplier', 's_suppkey', 's')} select b.s_suppkey + 1 as trip, least(greatest(floor((10010 - a.y) / 300), 0), 33)::int as r1, least(greatest(floor(a.x / 300), 0), 33)::int as c1,
  least(greatest(floor((10010 - b.y) / 300), 0), 33)::int as r2, least(greatest(floor(b.x / 300), 0), 33)::int as c2, case when b.s_suppkey = 0 then 3 else 1 end as alternatives from s a, s b where a.s_suppkey = (select max(s_suppkey) from supplier)"""
)
def pair_trips(spark: SparkSession, d: str) -> DataFrame:
    """Trips from the last supplier to every one."""
    s = points(read(spark, d, "supplier"), "s_suppkey")
    start = s.agg(F.max(F.struct("s_suppkey", "x", "y")).alias("m")).select(F.col("m.x").alias("x1"), F.col("m.y").alias("y1"))
    pairs = s.select((F.col("s_suppkey") + 1).alias("pair"), F.col("x").alias("x2"), F.col("y").alias("y2")).join(F.broadcast(start), F.lit(True))
    return raster.pair_trips(pairs, 0.0, 10010.0, 300.0, 34, 34)


@query(
    """with t as (select p_partkey, case p_partkey % 6 when 0 then 'rail' when 1 then 'road' when 2 then 'bridge' when 3 then 'substation' when 4 then 'castle' end as type from part)
select p_partkey, type, case when type in ('rail', 'road', 'bridge') then 'line' when type = 'substation' then 'point' end as geometry, case when type in ('rail', 'road', 'bridge') then type when type = 'substation' then 'transmission' end as model from t"""
)
def asset_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    kinds = F.when(k == 0, "rail").when(k == 1, "road").when(k == 2, "bridge").when(k == 3, "substation").when(k == 4, "castle")
    return whatif.resolved(read(spark, d, "part").select("p_partkey", kinds.alias("type"))).select("p_partkey", "type", "geometry", "model")


@query("select n_name as area, count(*) as sites from supplier join nation on n_nationkey = s_nationkey group by 1")
def convenience_views(spark: SparkSession, d: str) -> DataFrame:
    create_views({"nation": read(spark, d, "nation"), "supplier": read(spark, d, "supplier")}, {"areas": "nation", "sites": "supplier", "zones": "not loaded"})
    return spark.sql("select n_name as area, count(*) as sites from sites join areas on n_nationkey = s_nationkey group by 1")


@query(
    """select s_suppkey, s_suppkey % 4 = 0 as valid, case when s_suppkey % 4 = 3 then null else 4 end as points, case when s_suppkey % 4 = 3 then null else 5000.0::double end as area from supplier"""
)
def rings_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Rings as they should be, left open, with a point said twice or at infinity, and without area."""
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    k = F.col("s_suppkey") % 4
    whole, flat = F.array(p(0, 0), p(100, 0), p(0, 100), p(0, 0)), F.array(p(0, 0), p(50, 0), p(100, 0), p(0, 0))
    twice = F.array(p(0, 0), p(100, 0), p(100, 0), p("inf", 0), p(0, 100), p(0, 0))
    ring = F.when(k == 0, whole).when(k == 1, F.slice(whole, 1, 3)).when(k == 2, twice).otherwise(flat)
    mended = geo.ring_repaired(F.col("ring"))
    rings = read(spark, d, "supplier").select("s_suppkey", ring.alias("ring"))
    return rings.select("s_suppkey", geo.ring_valid(F.col("ring")).alias("valid"), F.when(mended.isNotNull(), F.size(mended)).alias("points"), geo.ring_area(mended).alias("area"))
