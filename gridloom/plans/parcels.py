"""Queries of parcels, owners, what-if scenarios and transport interventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parcels, whatif
from .analogs import FEEDS_SQL, POWERS_SQL, REACH_SQL, feeds, points, points_sql, powers, read
from .registry import query


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").withColumn("parcel", F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))


@query("select o_custkey, o_orderkey, rank::int as sale_rank from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey) as rank from orders) where rank <= 5")
def sale_history(spark: SparkSession, d: str) -> DataFrame:
    return parcels.sale_history(read(spark, d, "orders"), "o_custkey", "o_orderdate", F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.col("sale_rank").cast("int").alias("sale_rank"))


_FOUND = f"""{points_sql('customer', 'c_custkey', 'c')}, found as (
  select lpad(o_orderkey::varchar, 8, '0') as parcel, o_custkey as owner, x, y from orders join c on c_custkey = o_custkey where starts_with(lpad(o_orderkey::varchar, 8, '0'), '000001'))"""


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = points(read(spark, d, "customer"), "c_custkey")
    held = _orders(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey")).select("parcel", F.col("o_custkey").alias("owner"), "c_name", "x", "y")
    return parcels.search(held, "000001", "parcel", ["c_name"], 20)


@query(f"with {_FOUND} select parcel, owner from found order by parcel limit 20")
def parcel_search(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)[0].select("parcel", "owner")


@query(f"with {_FOUND} select count(*) as total, count(distinct owner) as owners, min(x) as x1, max(x) as x2, min(y) as y1, max(y) as y2 from found")
def parcel_search_summary(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)[1]


@query(
    """with spent as (select o_custkey as owner, count(*) as n, sum(o_totalprice) as total from orders group by 1), latest as (select o_custkey as owner, max(o_orderdate) as sold from orders group by 1)
select c_custkey as owner, n as sales, round(total, 2) as total, sold, case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 0.0 else (c_custkey % 7) / 10.0 end::double as fraction,
  case when c_custkey % 5 in (0, 1) or c_custkey % 7 = 0 then 'minimal' when c_custkey % 7 < 1 then 'low' when c_custkey % 7 < 4 then 'moderate' else 'high' end as flood_level
from customer left join spent on spent.owner = c_custkey left join latest on latest.owner = c_custkey"""
)
def parcel_detail(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders"), F.col("owner")
    owners = read(spark, d, "customer").select(F.col("c_custkey").alias("owner"))
    spent = o.groupBy(F.col("o_custkey").alias("owner")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    latest = o.groupBy(F.col("o_custkey").alias("owner")).agg(F.max("o_orderdate").alias("sold"))
    out = parcels.detail(owners, {"spent": spent, "latest": latest}, "owner").withColumn("fraction", F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, 0.0).otherwise((k % 7) / 10.0))
    return out.select("owner", F.col("spent.n").alias("sales"), F.round("spent.total", 2).alias("total"), F.col("latest.sold").alias("sold"), "fraction", parcels.flood_level(F.col("fraction")).alias("flood_level"))


_OWNED = """owned as (select upper(regexp_replace(trim(replace(c_name, '#', ' ')), '\\s+', ' ', 'g')) as full_name, c_nationkey as town, c_acctbal as value, case when c_custkey % 3 = 0 then 'JOHN DOE' else 'FUND ' || (c_custkey % 50) end as owner,
  case when c_custkey % 3 = 0 then 'John Doe' when c_custkey % 2 = 0 then 'Fund ' || (c_custkey % 50) || ', Inc.' else 'FUND ' || (c_custkey % 50) || ' LLC' end as name from customer)"""


def _owned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    number = (k % 50).cast("string")
    contact = F.when(k % 3 == 0, "John Doe").when(k % 2 == 0, F.concat(F.lit(" Fund  "), number, F.lit(", Inc."))).otherwise(F.concat(F.lit("FUND "), number, F.lit(" LLC ")))
    return parcels.build_owners(read(spark, d, "customer").withColumn("contact", contact), "c_custkey", "contact", "c_nationkey", "c_acctbal")


@query(
    f"""with {_OWNED}, names as (select owner, name, count(*) as n from owned group by 1, 2), best as (select owner, name, row_number() over (partition by owner order by n desc, name) as rn from names)
select owner, min(b.name) as name, count(*) as parcels, count(distinct o.name) as spellings, count(distinct town) as towns, round(sum(value), 2) as value from owned o join best b using (owner) where rn = 1 group by owner"""
)
def owner_entities(spark: SparkSession, d: str) -> DataFrame:
    return _owned(spark, d)[1].withColumn("value", F.round("value", 2))


@query(f"with {_OWNED} select owner, count(*) as parcels from owned where owner <> 'JOHN DOE' group by 1 order by parcels desc, sum(value) desc nulls last, owner limit 25")
def largest_owners(spark: SparkSession, d: str) -> DataFrame:
    return parcels.largest_owners(_owned(spark, d)[1]).select("owner", "parcels")


@query(f"with {_OWNED} select owner, town, count(*) as parcels, row_number() over (partition by owner order by count(*) desc, town) as place from owned group by 1, 2")
def owner_towns(spark: SparkSession, d: str) -> DataFrame:
    return parcels.owner_towns(_owned(spark, d)[0]).select("owner", "town", "parcels", F.col("place").cast("long").alias("place"))


# -- what-if -------------------------------------------------------------------------------------


@query("select s_suppkey, case when s_suppkey % 5 = 0 then 0.0 else s_acctbal end as s_acctbal from supplier where s_suppkey % 7 <> 0 union all select -1, 1.0")
def scenario_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    changed = base.where("s_suppkey % 5 = 0 and s_suppkey % 7 <> 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal"))
    added = changed.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(1.0)))
    return whatif.overlay(base, added, base.where("s_suppkey % 7 = 0"), ["s_suppkey"])


@query(
    f"""with recursive {FEEDS_SQL}, {POWERS_SQL}, {REACH_SQL.format(depth=20)}, served as (
  select root, node as entity, 'node' as kind, 'FEEDS' as via from reach where node <> root union select r.root, p.dst, p.kind, 'POWERS' from reach r join powers p on p.src = r.node
)
select root, kind, via, count(*) as entities, coalesce(sum(p_size * 10), 0)::bigint as population from served left join part on p_partkey = entity group by 1, 2, 3"""
)
def whatif_failure(spark: SparkSession, d: str) -> DataFrame:
    failed = read(spark, d, "supplier").select(F.col("s_suppkey").alias("root"))
    people = read(spark, d, "part").select(F.col("p_partkey").alias("entity"), (F.col("p_size") * 10).alias("population"))
    return whatif.failure(feeds(spark, d), powers(spark, d), failed, people, 20)


@query(
    """with a as (select p_partkey, case p_partkey % 4 when 0 then 'rail' when 1 then 'road' when 2 then 'bridge' else 'water' end as type, p_size * 100.0::double as length, case p_size % 3 when 0 then 'tunnel' when 1 then 'elevated' end as terrain,
  case p_size % 2 when 0 then 'new_corridor' end as work, p_size * 2.0::double as span, p_size * 10 as population from part)
select p_partkey, round(case type when 'rail' then length * case terrain when 'tunnel' then 120000.0::double when 'elevated' then 40000 else 15000 end when 'road' then length * case work when 'new_corridor' then 3500.0::double else 2000 end
    when 'bridge' then case when span < 20 then 3000000.0::double when span <= 60 then span * 250000 else span * 350000 end end, 2) as construction,
  round(case type when 'rail' then length * 7686.25::double when 'road' then length * 768.625::double when 'bridge' then 1537250.0::double end, 2) as maintenance,
  case type when 'rail' then 20000.0::double when 'road' then 3600.0 when 'bridge' then 36.0 end as capacity, case type when 'rail' then floor(population * 0.05::double)::bigint when 'water' then null else population end as affected from a"""
)
def asset_costs(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    assets = read(spark, d, "part").select(
        k, F.when(k % 4 == 0, "rail").when(k % 4 == 1, "road").when(k % 4 == 2, "bridge").otherwise("water").alias("type"), (size * 100.0).alias("length"), F.when(size % 3 == 0, "tunnel").when(size % 3 == 1, "elevated").alias("terrain"),
        F.when(size % 2 == 0, "new_corridor").alias("work"), (size * 2.0).alias("span"), (size * 10).alias("population"), F.lit(None).cast("int").alias("lanes"), F.lit(None).cast("boolean").alias("posted"), F.lit(5.0).alias("detour_km"),
    )
    out = whatif.asset_costs(assets)
    return out.select("p_partkey", F.round("construction", 2).alias("construction"), F.round("maintenance", 2).alias("maintenance"), "capacity", F.col("affected").cast("long").alias("affected"))


@query("select p_partkey, round(p_size * 2.0::double + p_size + 3 + 4 + 5 - (p_retailprice + 7), 4) as score from part")
def asset_objective(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    parts = read(spark, d, "part").select(
        "p_partkey", size.alias("construction"), size.alias("maintenance"), F.lit(3.0).alias("property_impact"), F.lit(4.0).alias("environmental_impact"), F.lit(5.0).alias("disaster_vulnerability"), F.col("p_retailprice").alias("population_benefit"), F.lit(7.0).alias("economic_benefit")
    )
    return parts.select("p_partkey", F.round(whatif.objective({"construction": 2.0}), 4).alias("score"))


@query(
    """with p as (select p_partkey as entity, p_size::double as minutes, p_partkey % 13 * 100 as population, case when p_partkey % 3 > 0 then (p_partkey % 3) / 4.0::double end as svi from part),
w as (select * from p where minutes > 15 order by minutes desc, entity limit 100), e as (
  select *, least(saves, minutes) as saved, least(minutes / 120, 2.0::double) as b from w join (values ('road_hardening', 15.0::double, 5000000.0::double, 15.0::double), ('new_access_road', 25.0, 15000000.0, 30.0)) k(kind, above, cost, saves) on minutes > above)
select entity, kind, cost, round(b + 1e-9::double, 4) as before, round(b - greatest((minutes - saved) / 120, 0) + 1e-9::double, 4) as uplift, round(population * saved * 10.0::double * 2 * 15.3725::double, 2) as benefit from e"""
)
def transport_catalog(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    places = read(spark, d, "part").select(k.alias("entity"), F.col("p_size").cast("double").alias("minutes"), (k % 13 * 100).alias("population"), F.when(k % 3 > 0, (k % 3) / 4.0).alias("svi"))
    return whatif.transport_catalog(places).select("entity", "kind", "cost", "before", "uplift", "benefit")


@query(
    """with c as (select p_partkey % 8 as route, p_partkey, case when p_size < 20 then 'standard' when p_size < 40 then 'elevated' else 'tunnel' end as terrain, (p_size % 2)::double as flood from part),
t as (select *, case when lag(terrain) over w is not distinct from terrain and row_number() over w > 1 then 0 else 1 end as turn from c window w as (partition by route order by p_partkey)),
i as (select *, sum(turn) over (partition by route order by p_partkey) as island from t)
select route, island::bigint as island, min(terrain) as terrain, count(*) * 300.0::double as metres, round(avg(flood), 6) as flooded, count(*) * 300.0::double * case min(terrain) when 'standard' then 15000.0::double when 'elevated' then 40000 else 120000 end as construction from i group by 1, 2"""
)
def route_segments(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    cells = read(spark, d, "part").select((F.col("p_partkey") % 8).alias("route"), "p_partkey", F.when(size < 20, "standard").when(size < 40, "elevated").otherwise("tunnel").alias("terrain"), (size % 2).cast("double").alias("flood"))
    return whatif.route_costs(cells, ["route"], "p_partkey", 300.0).select("route", "island", "terrain", "metres", F.round("flooded", 6).alias("flooded"), "construction")
