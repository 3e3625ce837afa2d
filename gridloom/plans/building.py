"""Queries of entities and edges made from layers, of upkeep, and of samples along lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, raster, upkeep, validate
from .analogs import points, points_sql, read
from .registry import query


def _layers(spark: SparkSession, d: str) -> DataFrame:
    c, s = points(read(spark, d, "customer"), "c_custkey"), points(read(spark, d, "supplier"), "s_suppkey")
    far = F.when(F.col("gid") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("x"))
    home = c.select(F.col("c_custkey").alias("gid"), F.regexp_replace("c_name", "#", "   ").alias("name"), "x", "y", "c_mktsegment").withColumn("x", far)
    site = s.select(F.col("s_suppkey").alias("gid"), F.lit("  ").alias("name"), "x", "y", "s_acctbal")
    return build.entities({"customer": ("home", home, {"segment": F.col("c_mktsegment")}), "supplier": ("site", site, {})})


@query(
    """select 'home' as kind, regexp_replace(c_name, '#', ' ') as name, 'customer' as src_table, c_custkey as src_gid, c_mktsegment as segment from customer where c_custkey % 10 <> 0
union all select 'site', null, 'supplier', s_suppkey, null from supplier"""
)
def entity_build(spark: SparkSession, d: str) -> DataFrame:
    return _layers(spark, d).select("kind", "name", "src_table", "src_gid", F.col("attrs")["segment"].alias("segment"))


@query("select (select count(*) from customer where c_custkey % 4 = 0) + (select count(*) from part where p_partkey % 3 = 0) as changed")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.col("c_name")).alias("name"))
    p = read(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("  x"))).otherwise(F.col("p_brand")).alias("name"))
    return build.clean_names({"customer": c, "part": p})[1]


_SITES = f"{points_sql('customer', 'c_custkey', 'c')}, {points_sql('supplier', 's_suppkey', 's')}, pairs as (select c_custkey, c_nationkey, s_suppkey, s_nationkey, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) as dist from c, s)"


def _sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = points(read(spark, d, "customer"), "c_custkey", "a").select("c_custkey", F.col("c_nationkey").alias("nation"), "ax", "ay")
    return c, points(read(spark, d, "supplier"), "s_suppkey", "b").select("s_suppkey", F.col("s_nationkey").alias("nation"), "bx", "by")


@query(f"with {_SITES} select s_suppkey as src, c_custkey as dst, round(dist, 4) as weight, case when dist <= 5000 then 0.6::double else 0.4::double end as confidence from (select *, row_number() over (partition by c_custkey order by dist, s_suppkey) as rn from pairs) where rn = 1")
def powers_nearest(spark: SparkSession, d: str) -> DataFrame:
    c, s = _sites(spark, d)
    return build.powers(c.drop("nation"), s.drop("nation"), "c_custkey", "s_suppkey").withColumn("weight", F.round("weight", 4))


@query(
    f"""with {_SITES}, serves as (select * from (select *, row_number() over (partition by c_custkey order by dist, s_suppkey) as rn from pairs where c_nationkey = s_nationkey) where rn = 1)
select s_suppkey % 7 as root, count(distinct c_custkey) as areas from serves group by 1"""
)
def water_downstream(spark: SparkSession, d: str) -> DataFrame:
    c, s = _sites(spark, d)
    serves = build.water_serves(c, s, "c_custkey", "s_suppkey", "nation")
    powers = s.select((F.col("s_suppkey") % 7).alias("src"), F.col("s_suppkey").alias("dst"))
    return build.water_downstream(powers, serves)


@query(
    f"""with {_SITES}, near as (select *, row_number() over (partition by s_suppkey order by dist, c_custkey) as rn from pairs)
select 's' || s_suppkey as src, c_custkey::varchar as dst, 0.8::double as confidence from near where rn = 1 union all select c_custkey::varchar, 's' || s_suppkey, 0.8::double from near where rn = 1
union all select 's' || s_suppkey, 'f' || c_custkey, 0.7::double from (select *, row_number() over (partition by s_suppkey order by dist, 'f' || c_custkey) as place from near where dist <= 5000) where place <= 5"""
)
def intermodal_links(spark: SparkSession, d: str) -> DataFrame:
    c, s = _sites(spark, d)
    cities = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("city"), F.col("bx").alias("ax"), F.col("by").alias("ay"))
    areas = c.select("c_custkey", F.col("ax").alias("bx"), F.col("ay").alias("by"))
    return build.intermodal(cities, areas, areas.withColumn("facility", F.concat(F.lit("f"), F.col("c_custkey").cast("string"))), "city", "c_custkey", "facility")


_LINE = f"{points_sql('supplier', 's_suppkey', 's')}, marks as (select s_suppkey as line, x, y, unnest(range(0, 17)) * 100.0 as m from s), along as (select line, least(m, 1550)::double as dist, (x + least(m, 800))::double as x, (y + greatest(least(m, 1550) - 800, 0))::double as y from marks)"


def _line_samples(spark: SparkSession, d: str) -> DataFrame:
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    lines = points(read(spark, d, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("line"), F.array(p(0, 0), p(800, 0), p(800, 750)).alias("points"))
    return raster.sample_lines(lines, 100.0)


@query(f"with {_LINE} select line, row_number() over (partition by line order by dist)::int as place, dist, round(x, 4) as x, round(y, 4) as y from along")
def line_samples(spark: SparkSession, d: str) -> DataFrame:
    return _line_samples(spark, d).select("line", "place", "dist", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    f"""with {_LINE}, cells as (select line, dist, floor(y / 300)::bigint as row, floor(x / 300)::bigint as col from along),
turns as (select *, lag(row) over w as r, lag(col) over w as c from cells window w as (partition by line order by dist))
select line, row_number() over (partition by line order by dist)::int as place, row, col from turns where r is null or r <> row or c <> col"""
)
def line_cells(spark: SparkSession, d: str) -> DataFrame:
    return raster.cell_paths(_line_samples(spark, d), 300.0)


@query(
    """with probed as (select event_type as layer, count(*) as n from events group by 1), known as (select layer, substr(sha256(layer || ':' || (case when layer = 'click' then n + 1 else n end)), 1, 16) as checksum from probed where layer <> 'view')
select layer, case when k.checksum = substr(sha256(layer || ':' || n), 1, 16) then 'skipped' else 'updated' end as status, substr(sha256(layer || ':' || n), 1, 16) as checksum from probed left join known k using (layer)"""
)
def layer_changes(spark: SparkSession, d: str) -> DataFrame:
    probed = read(spark, d, "events").groupBy(F.col("event_type").alias("layer")).agg(F.count("*").alias("n"))
    from ..sources.feeds import checksum

    before = F.when(F.col("layer") == "click", F.col("n") + 1).otherwise(F.col("n"))
    return upkeep.layer_changes(probed.where("layer <> 'view'").select("layer", checksum(F.col("layer"), before).alias("checksum")), probed)


@query(
    """with t as (select n_nationkey, greatest(case n_nationkey % 4 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end, case n_regionkey when 3 then 4 when 2 then 3 else 1 end) as r from nation)
select n_nationkey, case r when 1 then 'authoritative' when 2 then 'modeled' when 3 then 'proxy' else 'estimated' end as tier from t"""
)
def weakest_tier(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("n_nationkey") % 4, F.col("n_regionkey")
    one = F.when(a == 0, "authoritative").when(a == 1, "modeled").when(a == 2, "proxy").otherwise("estimated")
    two = F.when(b == 3, "estimated").when(b == 2, "proxy").otherwise("not listed")
    return read(spark, d, "nation").select("n_nationkey", upkeep.weakest(one, two).alias("tier"))


@query(
    """with s as (select p_partkey, p_retailprice as a, p_retailprice + p_size * 10 as b from part), r as (select p_partkey, rank() over (order by a desc) as before, rank() over (order by b desc) as after from s)
select p_partkey, before, after, before - after as shift from r where before <> after order by abs(before - after) desc, after, p_partkey limit 15"""
)
def rank_shifts(spark: SparkSession, d: str) -> DataFrame:
    scores = read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_retailprice") + F.col("p_size") * 10).alias("b"))
    return validate.rank_shifts(scores, "p_partkey", "a", "b")


@query(
    """with p as (select p_partkey as entity, (p_partkey % 50 + 1) / 60.0::double as h, p_size::double as c, (p_partkey % 7) / 100.0::double as b from part),
v as (select 'flood' as perturbation, 1.3::double as fh, 1.0::double as fc, 1.0::double as fb union all select 'centrality', 1.0, 1.0, 5.0),
t as (select perturbation, entity, h * c * (1 + b) as x, least(h * fh, 0.95::double) * (c * fc) * (1 + b * fb) as y from p, v),
r as (select *, rank() over (partition by perturbation order by x) + (count(*) over (partition by perturbation, x) - 1) / 2.0::double as rx, rank() over (partition by perturbation order by y) + (count(*) over (partition by perturbation, y) - 1) / 2.0::double as ry,
  row_number() over (partition by perturbation order by x desc, entity) as px, row_number() over (partition by perturbation order by y desc, entity) as py from t)
select perturbation, round(corr(rx, ry), 3) as rho, round(count(*) filter (where px <= 10 and py <= 10) / 10.0::double, 4) as overlap from r group by 1"""
)
def sensitivity_sweep(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    assets = read(spark, d, "part").select(k.alias("entity"), ((k % 50 + 1) / 60.0).alias("hazard"), F.col("p_size").cast("double").alias("cascade"), ((k % 7) / 100.0).alias("betweenness"))
    ways = spark.createDataFrame([("flood", 1.3, 1.0, 1.0), ("centrality", 1.0, 1.0, 5.0)], "perturbation string, hazard_factor double, cascade_factor double, betweenness_factor double")
    return validate.sweep(assets, ways).select("perturbation", F.round("rho", 3).alias("rho"), "overlap")
