"""Suitability of parts' plots as sites: suppliers are what lies near, nations the areas around, frames the flood zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sites
from .analogs import AREAS_SQL, areas, points, points_sql, read
from .registry import query
from .shapes import _FRAMES, CELL, UNIT, frames, plots

_MEASURED = f"""{_FRAMES}, {points_sql('part', 'p_partkey', 'p')}, {AREAS_SQL}, targets as (
  select s_suppkey as target, x as tx, y as ty, ['substation', 'water', 'port', 'bulk_port', 'airport'][s_suppkey % 5 + 1] as kind, case when s_suppkey % 3 > 0 then (s_suppkey * 37 % 100) / 100.0::double end as risk from s
), dists as (select p_partkey, kind, target, risk, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) as dist from p, targets
), near as (select * from (select *, row_number() over (partition by p_partkey, kind order by dist, target) as rn from dists) where rn = 1
), wide as (
  select p_partkey, max(dist) filter (kind = 'substation') as dist_substation, max(target) filter (kind = 'substation') as substation, max(risk) filter (kind = 'substation') as substation_risk, max(dist) filter (kind = 'water') as dist_water,
    max(dist) filter (kind = 'port') as dist_port, max(dist) filter (kind = 'bulk_port') as dist_bulk_port, max(dist) filter (kind = 'airport') as dist_airport from near group by 1
), held as (
  select p_partkey, n_nationkey as area, (n_nationkey * 7 % 13) / 13.0::double as svi, case when n_nationkey % 4 > 0 then n_nationkey % 9 * 7.0::double end as minutes
  from p join areas on x1 <= x and x < x2 and y1 <= y and y < y2 where n_nationkey <> 24
), wet as (
  select p_partkey, sum((least(x2, x + 200 + p_size) - greatest(x1, x)) * (least(y2, y + 300) - greatest(y1, y))) as common
  from p, frames where x1 < x + 200 + p_size and x < x2 and y1 < y + 300 and y < y2 group by 1
), m as (
  select p_partkey, dist_substation, substation, substation_risk, dist_water, dist_port, dist_bulk_port, dist_airport, area, svi, minutes, least(coalesce(common, 0) / ((200 + p_size) * 300.0), 1)::double as flood,
    case when p_partkey % 3 > 0 and p_size % 11 > 0 then p_retailprice * 10 end / ((200 + p_size) * 300.0::double) as land_per_m2
  from p left join wide using (p_partkey) left join held using (p_partkey) left join wet using (p_partkey)
), scores as (
  select *, case when dist_substation is not null then 1 - percent_rank() over (order by dist_substation nulls last) end as s_power_access, case when substation_risk is not null then 1 - percent_rank() over (order by substation_risk nulls last) end as s_grid_reliability,
    1 - flood as s_flood_safety, case when dist_water is not null then 1 - percent_rank() over (order by dist_water nulls last) end as s_water_access, case when minutes is not null then 1 - percent_rank() over (order by minutes nulls last) end as s_road_access,
    case when dist_port is not null then 1 - percent_rank() over (order by dist_port nulls last) end as s_port_access, case when dist_bulk_port is not null then 1 - percent_rank() over (order by dist_bulk_port nulls last) end as s_bulk_port_access,
    case when dist_airport is not null then 1 - percent_rank() over (order by dist_airport nulls last) end as s_air_access, case when svi is not null then percent_rank() over (order by svi nulls last) end as s_dev_impact,
    case when land_per_m2 is not null then 1 - percent_rank() over (order by land_per_m2 nulls last) end as s_land_value from m
)"""
_WEIGHTS = {"power_access": 0.18, "grid_reliability": 0.15, "flood_safety": 0.20, "water_access": 0.12, "road_access": 0.15, "port_access": 0.15, "land_value": 0.05}


def _blend(weights: dict[str, float]) -> str:
    top = " + ".join(f"{w}::double * coalesce(s_{k}, 0)" for k, w in weights.items())
    return f"({top}) / nullif({' + '.join(f'case when s_{k} is null then 0 else {w}::double end' for k, w in weights.items())}, 0)"


_MEASURES = ("dist_substation", "substation_risk", "dist_water", "dist_port", "dist_bulk_port", "dist_airport", "svi", "minutes", "flood", "land_per_m2")
_SCORES = tuple(f"s_{k}" for k in (*_WEIGHTS, "bulk_port_access", "air_access", "dev_impact"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    k, n, s = F.col("p_partkey"), F.col("n_nationkey"), F.col("s_suppkey")
    part = read(spark, d, "part")
    plot = (F.col("p_size") + 200) * 300.0
    own = points(part, "p_partkey").select(k.alias("site"), "x", "y", plot.alias("area_m2"), k.alias("parcel")).join(plots(spark, d).select(k.alias("site"), "rings"), "site")
    kind = F.element_at(F.array(*(F.lit(x) for x in sites.NEAR)), (s % 5 + 1).cast("int"))
    targets = points(read(spark, d, "supplier"), "s_suppkey", "b").select(kind.alias("kind"), s.alias("target"), "bx", "by", F.when(s % 3 > 0, (s * 37 % 100) / 100.0).alias("risk"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    around = areas(spark, d).where(n != 24).select(n.alias("area"), ring.alias("ring"), ((n * 7 % 13) / 13.0).alias("svi"), (n / 25.0).alias("resilience"))
    travel = read(spark, d, "nation").where(n % 4 > 0).select(n.alias("area"), (n % 9 * 7.0).alias("minutes"))
    zones = frames(spark, d).select(s.alias("zone"), "rings")
    values = part.where(k % 3 > 0).select(k.alias("parcel"), F.when(F.col("p_size") % 11 > 0, F.col("p_retailprice") * 10).alias("land"), F.col("p_brand").alias("owner"), F.col("p_retailprice").alias("total"))
    return sites.scored(sites.measured(own, targets, around, travel, zones, values, 2002.0, UNIT, CELL))


@query(
    f"""with {_MEASURED} select p_partkey, substation, area, {', '.join(f'round({c}, 6) as {c}' for c in (*_MEASURES, *_SCORES))}, round({_blend(_WEIGHTS)}, 6) as composite from scores"""
)
def site_suitability(spark: SparkSession, d: str) -> DataFrame:
    """Ten criteria of every plot measured from the tables, their scores, and the composite by the usual weights."""
    rounded = [F.round(c, 6).alias(c) for c in (*_MEASURES, *_SCORES, "composite")]
    return _scored(spark, d).select(F.col("site").alias("p_partkey"), "substation", "area", *rounded)


_SHIFTED = _WEIGHTS | {"power_access": 0.0, "bulk_port_access": 0.3, "air_access": 0.1, "dev_impact": 0.2}


@query(
    f"""with {_MEASURED}, blended as (select *, {_blend({k: w for k, w in _SHIFTED.items() if w})} as composite from scores where substation % 2 = 0)
select p_partkey, round(composite, 6) as composite from (select *, row_number() over (order by round(composite, 6) desc nulls last, p_partkey) as rn from blended) where rn <= 25"""
)
def site_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The best 25 plots served by even suppliers, by other weights from the same scores."""
    shifted = sites.reranked(_scored(spark, d), _SHIFTED, F.col("substation") % 2 == 0).withColumn("composite", F.round("composite", 6))
    return sites.top(shifted, 25).select(F.col("site").alias("p_partkey"), "composite")


@query(
    f"""with {_MEASURED}, known as (select *, {' + '.join(f'case when s_{k} is null then 0 else {w}::double end' for k, w in _WEIGHTS.items())} as known from scores)
{' union all '.join(f"select p_partkey, '{k}' as criterion, round(s_{k}, 6) as score, {w}::double as weight, round(s_{k} * {w}::double / nullif(known, 0), 6) as part from known" for k, w in _WEIGHTS.items())}"""
)
def site_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """What each criterion adds to a plot's composite."""
    rows = sites.scorecard(_scored(spark, d))
    return rows.select(F.col("site").alias("p_partkey"), "criterion", F.round("score", 6).alias("score"), "weight", F.round("part", 6).alias("part"))
