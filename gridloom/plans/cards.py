"""Cards of parcels and areas: parts are parcels of one to three pieces, nations areas, suppliers what powers them, frames flood zones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cards, optimize, scoring
from ..storage import shared_folder
from .analogs import AREAS_SQL, areas, points, points_sql, read
from .registry import query
from .shapes import _FRAMES, CELL, UNIT, _box, frames

_MODEL = f"""{_FRAMES}, {AREAS_SQL}, {points_sql('part', 'p_partkey', 'p')}, serving as (
  select s_nationkey as area, s_suppkey as source, s_name as name, confidence, case when s_suppkey % 4 > 0 then (s_suppkey * 31 % 101) / 101.0::double end as composite, people, hospitals,
    case when people > 0 and hospitals > 0 then 'Failure affects ' || format('{{:,}}', people) || ' people and ' || hospitals || case when hospitals = 1 then ' hospital' else ' hospitals' end
      when people > 0 then 'Failure affects ' || format('{{:,}}', people) || ' people' when hospitals > 0 then 'Failure affects ' || hospitals || case when hospitals = 1 then ' hospital' else ' hospitals' end else 'No downstream impact' end as headline
  from (select *, s_suppkey * 313 % 5000 as people, s_suppkey % 3 as hospitals, (s_suppkey % 10) / 10.0::double as confidence, row_number() over (partition by s_nationkey order by s_suppkey % 10 desc, s_suppkey) as rn from supplier) where rn = 1
), community as (
  select * from (select n_nationkey as area, score, percent_rank() over (order by score nulls last) as percentile from (select n_nationkey, case when n_nationkey % 6 > 0 then (n_nationkey * 11 % 17) / 17.0::double end as score from nation)) where score is not null
), road as (select n_nationkey as area, 'H' || n_nationkey as hospital, n_nationkey % 9 * 7.0::double as minutes from nation where n_nationkey % 4 > 0 and n_nationkey % 8 <> 1)"""
_LEVEL = "case when coalesce({0}, 0) <= 0 then 'minimal' when {0} < 0.1 then 'low' when {0} < 0.4 then 'moderate' else 'high' end"


def _serving(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    supplier = read(spark, d, "supplier")
    people, hospitals, none = (s * 313 % 5000).cast("long"), s % 3, F.lit(0).cast("long")
    sources = supplier.select(s.alias("source"), F.col("s_name").alias("name"))
    consequences = supplier.select(s.alias("source"), text.outage_headline(people, hospitals, none, none).alias("headline"), people.alias("people"), hospitals.alias("hospitals"), none.alias("plants"), none.alias("centers"))
    powers = supplier.select(s.alias("src"), F.col("s_nationkey").cast("long").alias("dst"), (s % 10 / 10.0).alias("confidence"))
    scores = supplier.where(s % 4 > 0).select(F.lit("cat3").alias("scenario"), s.alias("source"), (s * 31 % 101 / 101.0).alias("composite"))
    return cards.power(powers, sources, consequences, scores)


def _community(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read(spark, d, "nation").select(n.cast("long").alias("area"), F.when(n % 6 > 0, n * 11 % 17 / 17.0).alias("resilience"))


def _travel(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read(spark, d, "nation").where(n % 4 > 0).select(n.cast("long").alias("area"), F.when(n % 8 != 1, F.concat(F.lit("H"), n)).alias("hospital"), (n % 9 * 7.0).alias("minutes"))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select(F.col("s_suppkey").alias("zone"), F.concat(F.lit("Z"), F.col("s_nationkey") % 3).alias("label"), "rings")


@query(
    f"""with {_MODEL}, parcels as (select p_partkey, x, y, x + 300 * (1 + p_size % 3) as x9, y + 300 as y9, 1 + p_size % 3 as pieces, p_retailprice + p_size % 3 as value from p), wet as (
  select p_partkey, sum((least(x2, x9) - greatest(x1, x)) * (least(y2, y9) - greatest(y1, y))) as common from parcels, frames where x1 < x9 and x < x2 and y1 < y9 and y < y2 group by 1
), sold as (
  select l_partkey, count(*) as sales, max(l_shipdate) as last_sold, round(sum(l_extendedprice), 2) as amounts from (select *, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey, l_linenumber) as rn from lineitem where l_shipdate is not null) where rn <= 25 group by 1
), held as (select p_partkey, n_nationkey as area from parcels join areas on areas.x1 <= x and x < areas.x2 and areas.y1 <= y and y < areas.y2 where n_nationkey <> 24)
select p_partkey, held.area, pieces, round(value, 2) as value, pieces * 0.25::double as cuerdas, sales, last_sold, amounts, round(least(coalesce(common, 0) / ((x9 - x) * 300), 1), 3)::double as flooded, {_LEVEL.format('common / ((x9 - x) * 300)')} as level,
  source, headline, round(composite, 6) as composite, round(percentile, 6) as percentile, hospital, minutes, case when p_partkey % 3 = 0 then p_partkey * 2 + case when p_partkey % 2 = 0 then 0 else 1 end end as site
from parcels left join held using (p_partkey) left join wet using (p_partkey) left join sold on l_partkey = p_partkey left join serving on serving.area = held.area left join community on community.area = held.area left join road on road.area = held.area"""
)
def parcel_cards(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a parcel with its seven sections."""
    k, n, size = F.col("p_partkey"), F.col("n_nationkey"), F.col("p_size") % 3
    part = points(read(spark, d, "part"), "p_partkey").withColumn("i", F.explode(F.sequence(F.lit(0), size.cast("int"))))
    left = F.col("x") + F.col("i") * 300.0
    pieces = part.select(k.alias("parcel"), (F.col("p_retailprice") + F.col("i")).alias("value"), F.lit(0.25).alias("cuerdas"), F.array(_box(left, F.col("y"), left + 300.0, F.col("y") + 300.0)).alias("rings"), "x", "y")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    around = areas(spark, d).where(n != 24).select(n.cast("long").alias("area"), ring.alias("ring"))
    sold = read(spark, d, "lineitem").select(F.col("l_partkey").alias("parcel"), F.col("l_shipdate").alias("sold"), F.col("l_extendedprice").alias("amount"), "l_orderkey", "l_linenumber")
    by_site = F.explode(F.array(F.struct((k * 2).alias("site"), (1 - k % 2).alias("c")), F.struct((k * 2 + 1).alias("site"), (k % 2).alias("c"))))
    sites = read(spark, d, "part").where(k % 3 == 0).select(k.alias("parcel"), by_site.alias("s")).select("parcel", "s.site", F.lit("industrial").alias("use_type"), F.col("s.c").cast("double").alias("composite"))
    by_area = {"power": _serving(spark, d), "community": cards.community(_community(spark, d)), "road": cards.road_access(_travel(spark, d))}
    out = cards.parcel_cards(pieces, around, cards.sales(sold, F.col("l_orderkey"), F.col("l_linenumber")), by_area, _zones(spark, d), sites, 2002.0, UNIT, CELL)
    many = F.when(F.col("sales").isNotNull(), F.size("sales")).cast("long")
    return out.select(
        F.col("parcel").alias("p_partkey"), "area", "record.pieces", F.round("record.value", 2).alias("value"), F.col("record.total_cuerdas").alias("cuerdas"), many.alias("sales"), F.get("sales.sold", F.lit(0)).alias("last_sold"),
        F.round(F.aggregate("sales", F.lit(0.0), lambda s, x: s + x["amount"]), 2).alias("amounts"), F.col("flood.fraction").alias("flooded"), "flood.level", "power.source", "power.headline", F.round("power.composite", 6).alias("composite"),
        F.round("community.percentile", 6).alias("percentile"), "road.hospital", "road.minutes", "site.site",
    )


_ITEMS = """items as (select * from (select s_suppkey as entity, 'hardening' as kind, s_acctbal as cost, s_suppkey % 7 / 7.0::double as uplift, s_suppkey + 1 as place from supplier where s_suppkey % 2 = 0
  union all select n_nationkey + 1000000000, 'road_hardening', 5.0, 0.5, 0 from nation where n_nationkey % 5 = 0))"""


@query(
    f"""with {_MODEL}, {_ITEMS}, wet as (
  select n_nationkey, sum((least(f.x2, a.x2) - greatest(f.x1, a.x1)) * (least(f.y2, a.y2) - greatest(f.y1, a.y1))) as common from areas a, frames f where f.x1 < a.x2 and a.x1 < f.x2 and f.y1 < a.y2 and a.y1 < f.y2 group by 1
), near as (select area, entity, kind, place from serving join items on entity = source union all select entity - 1000000000, entity, kind, place from items where kind = 'road_hardening'),
works as (select area, count(*) as works, string_agg(kind, ',' order by place, entity) as kinds from near group by 1)
select n_nationkey as area, n_name as name, source, people, round(confidence, 4) as confidence, round(score, 6) as score, round(percentile, 6) as percentile, hospital, minutes, round(least(coalesce(common, 0) / (2002.0 * 2002), 1), 3)::double as flooded,
  {_LEVEL.format('common / (2002.0 * 2002)')} as level, coalesce(works, 0) as works, coalesce(kinds, '') as kinds
from nation left join serving on serving.area = n_nationkey left join community on community.area = n_nationkey left join road on road.area = n_nationkey left join wet using (n_nationkey) left join works on works.area = n_nationkey"""
)
def civic_cards(spark: SparkSession, d: str) -> DataFrame:
    """A card for every nation; the works are those of the portfolio stored last."""
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    shape = F.array(_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    around = areas(spark, d).join(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
    around = around.select(n.cast("long").alias("area"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("town"), shape.alias("rings"))
    works = read(spark, d, "supplier").where(s % 2 == 0).select(s.alias("entity"), F.lit("hardening").alias("kind"), F.col("s_acctbal").alias("cost"), (s % 7 / 7.0).alias("uplift"), (s + 1).cast("int").alias("place"))
    roads = read(spark, d, "nation").where(n % 5 == 0).select(n.cast("long").alias("entity"), F.lit("road_hardening").alias("kind"), F.lit(5.0).alias("cost"), F.lit(0.5).alias("uplift"), F.lit(0).alias("place"))
    # ids of nations and suppliers must differ, as both are entities
    apart = lambda df, c: df.withColumn(c, F.col(c) + 1_000_000_000)
    path = f"{shared_folder(spark)}/portfolios-{uuid.uuid4().hex}"
    optimize.store_run(works.withColumn("kind", F.lit("relocation")), path, "older", "2026-01-01T00:00:00")
    optimize.store_run(works.unionByName(apart(roads, "entity")), path, "newer", "2026-02-01T00:00:00")
    moved = {x: apart(df, "area") for x, df in {"areas": around, "serving": _serving(spark, d), "community": _community(spark, d), "travel": _travel(spark, d)}.items()}
    out = cards.civic_cards(moved["areas"], moved["serving"], moved["community"], moved["travel"], _zones(spark, d), optimize.last_run(spark, path), UNIT, CELL)
    return out.select(
        (F.col("area") - 1_000_000_000).alias("area"), "name", "power.source", "power.people", F.round("power.edge_confidence", 4).alias("confidence"), F.round("community.score", 6).alias("score"), F.round("community.percentile", 6).alias("percentile"),
        "road.hospital", "road.minutes", F.col("flood.fraction").alias("flooded"), "flood.level", F.size("planned").cast("long").alias("works"), F.array_join("planned.kind", ",").alias("kinds"),
    )


@query(
    """with a as (
  select n_nationkey, (n_nationkey * 37 % 100) / 100.0::double as flood, case when n_nationkey % 4 < 3 then (n_nationkey * 7 % 90)::double end as slope, case when n_nationkey % 9 > 0 then (n_nationkey * 13 % 50) / 100.0::double end as poverty,
    case when n_nationkey % 3 > 0 then (n_nationkey * 17 % 40) / 100.0::double end as elderly, case when n_nationkey % 5 > 0 then (n_nationkey * 19 % 40) / 100.0::double end as disabled from nation
), blends as (
  select n_nationkey, round(0.30 * poverty + 0.15 * coalesce(elderly, 0.185) + 0.10 * coalesce(disabled, 0.255) + 0.30 * flood + 0.15 * (1 - least(coalesce(slope, 38) / 76.0, 1)), 6) as blend from a
)
select n_nationkey, round(percent_rank() over (order by blend nulls last), 6) as svi from blends"""
)
def svi_social(spark: SparkSession, d: str) -> DataFrame:
    """Vulnerability of nations from five terms."""
    n = F.col("n_nationkey")
    known = read(spark, d, "nation").select(
        n, (n * 37 % 100 / 100.0).alias("flood"), F.when(n % 4 < 3, (n * 7 % 90).cast("double")).alias("slope"), F.when(n % 9 > 0, n * 13 % 50 / 100.0).alias("poverty"),
        F.when(n % 3 > 0, n * 17 % 40 / 100.0).alias("elderly"), F.when(n % 5 > 0, n * 19 % 40 / 100.0).alias("disabled"),
    )
    return scoring.vulnerability(known, social=True).select("n_nationkey", F.round("svi", 6).alias("svi"))
