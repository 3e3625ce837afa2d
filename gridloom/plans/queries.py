"""Registered queries: each operator on the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, ranking, text
from ..operators import bits, blocks, graph, optimize, raster, scoring, spatial, tables, validate, wayfinding
from ..streaming import feeds as streams
from .analogs import AREAS_SQL, CRITICALITY_SQL, FEEDS_SQL, POWERS_SQL, REACH_SQL, areas, criticality, feeds, points, points_sql, powers, read, snapshots
from .registry import query

#: As deep as failures are followed.
DEPTH = 20


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("root"))


def _levels(spark: SparkSession, d: str, first: bool = True) -> bits.Levels:
    return bits.levels(feeds(spark, d), _roots(spark, d), DEPTH, first)


def _served(spark: SparkSession, d: str) -> DataFrame:
    return bits.served(_levels(spark, d), powers(spark, d))


def _impact(spark: SparkSession, d: str, floor: float = 0.0) -> DataFrame:
    return bits.impact(_levels(spark, d), powers(spark, d), criticality(spark), floor)


_GRAPH = f"with recursive {FEEDS_SQL}, {POWERS_SQL}, {REACH_SQL.format(depth=DEPTH)}"
_SERVED = f"""{_GRAPH}, served as (
  select root, node as entity, 'node' as kind, depth, 1.0::double as confidence, 'FEEDS' as via from reach where node <> root
  union all select r.root, p.dst, p.kind, r.depth + 1, p.confidence, 'POWERS' from reach r join powers p on p.src = r.node
)"""


# -- graph ---------------------------------------------------------------------------------------


@query(
    f"""{_SERVED}, once as (
  select *, row_number() over (partition by root, entity order by depth, confidence desc) as rn from served where via = 'POWERS'
), scored as (
  select root, round(sum({CRITICALITY_SQL} * confidence), 4) as impact, count(*) as served from once where rn = 1 group by root
)
select root, impact, served, row_number() over (order by impact desc, root) as rank from scored"""
)
def cascade_rank(spark: SparkSession, d: str) -> DataFrame:
    impact = _impact(spark, d)
    return ranking.place(impact, [], [F.col("impact").desc(), F.col("root")])


@query(
    f"""{_SERVED}, once as (
  select *, row_number() over (partition by root, entity order by depth, confidence desc) as rn from served where via = 'POWERS' and confidence >= 0.5
)
select root, round(sum({CRITICALITY_SQL} * confidence), 4) as impact, count(*) as served from once where rn = 1 group by root"""
)
def cascade_confidence_floor(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, 0.5)


@query(f"{_SERVED} select root, entity, kind, depth, round(confidence, 4) as confidence, via from served where root = 0")
def downstream_of(spark: SparkSession, d: str) -> DataFrame:
    served = graph.downstream(feeds(spark, d), powers(spark, d), _roots(spark, d).where("root = 0"), DEPTH)
    return served.select("root", "entity", "kind", "depth", F.round("confidence", 4).alias("confidence"), "via")


@query(f"{_SERVED} select root, kind, count(distinct entity) as entities from served group by root, kind")
def affected_counts(spark: SparkSession, d: str) -> DataFrame:
    return _served(spark, d).select("root", "kind", "entities")


@query(
    f"""{_SERVED}, counts as (
  select root, count(distinct case when kind = 'ECONOMY' then entity end) as hospitals, count(distinct case when kind = 'STANDARD' then entity end) as plants,
         count(distinct case when kind = 'PROMO' then entity end) as centers, count(distinct case when via = 'POWERS' then entity end) * 100 as people from served group by root
), parts as (
  select *, list_filter([case when people > 0 then format('{{:,}}', people) || ' people' end,
    case when hospitals > 0 then hospitals || case when hospitals = 1 then ' hospital' else ' hospitals' end end,
    case when plants > 0 then plants || case when plants = 1 then ' water plant' else ' water plants' end end,
    case when centers > 0 then centers || case when centers = 1 then ' health center' else ' health centers' end end], lambda x: x is not null) as p from counts
)
select root, people, hospitals, plants, centers, case when len(p) = 0 then 'No downstream impact' when len(p) = 1 then 'Failure affects ' || p[1]
  else 'Failure affects ' || array_to_string(p[1:len(p) - 1], ', ') || ' and ' || p[len(p)] end as headline from parts"""
)
def downstream_summary(spark: SparkSession, d: str) -> DataFrame:
    of = lambda when: F.sum(F.when(when, F.col("entities")).otherwise(0))
    kind = F.col("kind")
    counts = _served(spark, d).groupBy("root").agg(of(kind == "ECONOMY").alias("hospitals"), of(kind == "STANDARD").alias("plants"), of(kind == "PROMO").alias("centers"), (of(F.col("via") == "POWERS") * 100).alias("people"))
    return counts.select("root", "people", "hospitals", "plants", "centers", text.outage_headline(F.col("people"), F.col("hospitals"), F.col("plants"), F.col("centers")).alias("headline"))


@query(f"with {POWERS_SQL} select dst, src, round(confidence, 4) as confidence, row_number() over (partition by dst order by confidence desc, weight desc, src) as place from powers")
def what_serves_top(spark: SparkSession, d: str) -> DataFrame:
    return graph.what_serves(powers(spark, d)).select("dst", "src", F.round("confidence", 4).alias("confidence"), F.col("place").cast("long").alias("place"))


@query(
    f"""with {FEEDS_SQL}, nodes as (
  select s_suppkey as node, s_suppkey % 7 = 0 as private, s_suppkey % 11 = 0 as generator, (s_nationkey % 4) * 38.0 as kv from supplier
), judged as (
  select f.src as a, f.dst as b, case when x.private <> y.private then y.private when x.generator <> y.generator then x.generator when x.kv <> y.kv then x.kv > y.kv end as forward
  from feeds f join nodes x on x.node = f.src join nodes y on y.node = f.dst
)
select case when forward then a else b end as src, case when forward then b else a end as dst, 0.65::double as confidence from judged where forward is not null"""
)
def feeds_orientation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    nodes = read(spark, d, "supplier").select(k.alias("node"), (k % 7 == 0).alias("private"), (k % 11 == 0).alias("generator"), ((F.col("s_nationkey") % 4) * 38.0).alias("kv"))
    edges = feeds(spark, d).distinct().select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.orient(edges, nodes)


@query(
    f"""with {FEEDS_SQL}, {POWERS_SQL}
select f.src as root, count(distinct p.dst) as parts, count(distinct s.s_nationkey) as nations from feeds f join powers p on p.src = f.dst join supplier s on s.s_suppkey = f.dst group by f.src"""
)
def two_hop_service(spark: SparkSession, d: str) -> DataFrame:
    f, p, s = feeds(spark, d).distinct(), powers(spark, d), read(spark, d, "supplier")
    both = f.join(p.select(F.col("src").alias("mid"), F.col("dst").alias("part")), f["dst"] == F.col("mid")).join(s, F.col("mid") == s["s_suppkey"])
    return both.groupBy(F.col("src").alias("root")).agg(F.countDistinct("part").alias("parts"), F.countDistinct("s_nationkey").alias("nations"))


_TREE = "edges as (select s_suppkey as src, (s_suppkey * 4) % (select count(*) from supplier) as dst from supplier)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    n = s.count()
    return s.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 4) % n).alias("dst"))


@query(
    f"""with recursive {_TREE}, ends as (select src, dst from edges union select dst, src from edges),
closure as (select src as node, src as other from ends union select c.node, b.dst from closure c join ends b on b.src = c.other)
select node, min(other) as component from closure group by node"""
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_tree(spark, d))


@query(
    f"""with recursive {FEEDS_SQL}, ends as (select src as a, dst as b from feeds where src <> dst union select dst, src from feeds where src <> dst),
closure as (select src as a, src as b from feeds union select dst, dst from feeds union select c.a, e.b from closure c join ends e on e.a = c.b),
named as (select a as node, min(b) as component from closure group by a),
largest as (select component, count(*) as n from named group by 1 order by n desc, component limit 1),
walks as (select node as s, node as v, 0 as d from named union select s, b, d + 1 from walks join ends on a = v where d < 12),
dist as (select s, v, min(d) as d from walks group by 1, 2),
paths as (select node as s, node as v, 0 as d from named union all select p.s, e.b, p.d + 1 from paths p join ends e on e.a = p.v join dist t on t.s = p.s and t.v = e.b and t.d = p.d + 1),
ways as (select s, v, max(d) as d, count(*) as n from paths group by 1, 2),
through as (select x.v as node, sum(x.n * y.n / z.n::double) as total from ways x join ways y on y.s = x.v join ways z on z.s = x.s and z.v = y.v where x.d + y.d = z.d and x.d > 0 and y.d > 0 group by 1)
select node, round(case when component = (select component from largest) then coalesce(total / (((select n from largest) - 1) * ((select n from largest) - 2)), 0) else 0 end, 6)::double as betweenness from named left join through using (node)"""
)
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(feeds(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


@query(
    f"""with recursive {_TREE}, ends as (select src as a, dst as b from edges where src <> dst union select dst, src from edges where src <> dst),
closure as (select a, a as b from ends union select c.a, e.b from closure c join ends e on e.a = c.b), sizes as (select a as node, count(*) as n from closure group by 1),
without as (select a as cut, min(b) as v from ends group by a union select w.cut, e.b from without w join ends e on e.a = w.v where e.b <> w.cut)
select node from sizes join (select cut, count(*) as seen from without group by 1) on cut = node where seen < n - 1"""
)
def articulation(spark: SparkSession, d: str) -> DataFrame:
    return blocks.articulation_points(_tree(spark, d))


@query(
    f"""with recursive {FEEDS_SQL}, costs as (select src, dst, 1.0::double + (src + dst) % 3 as cost from feeds),
walk as (select s_suppkey as node, 0.0::double as dist, 0 as hops from supplier where s_suppkey % 25 = 0
  union select c.dst, w.dist + c.cost, w.hops + 1 from walk w join costs c on c.src = w.node where w.hops < 25)
select node, min(dist)::double as dist from walk group by node"""
)
def access_distance(spark: SparkSession, d: str) -> DataFrame:
    edges = feeds(spark, d).distinct().withColumn("cost", 1.0 + (F.col("src") + F.col("dst")) % 3)
    sources = read(spark, d, "supplier").where("s_suppkey % 25 = 0").select(F.col("s_suppkey").alias("node"))
    return graph.shortest_paths(edges, sources).select("node", "dist")


@query(
    f"""with {FEEDS_SQL}, typed as (select src, dst, src % 3 = 0 as directed, case when dst % 4 = 0 then 0.0 else 2.0 end as weight from feeds)
select src, dst, case when weight = 0 then 1.0::double else weight::double end as weight from typed
union all select dst, src, case when weight = 0 then 1.0::double else weight::double end from typed where not directed"""
)
def subgraph_export(spark: SparkSession, d: str) -> DataFrame:
    typed = feeds(spark, d).distinct().withColumn("directed", F.col("src") % 3 == 0).withColumn("weight", F.when(F.col("dst") % 4 == 0, 0.0).otherwise(2.0))
    return graph.both_ways(typed)


# -- space ---------------------------------------------------------------------------------------

_SITES = f"{points_sql('customer', 'c_custkey', 'c')}, {points_sql('supplier', 's_suppkey', 's')}"


def _a(spark: SparkSession, d: str) -> DataFrame:
    return points(read(spark, d, "customer"), "c_custkey", "a").select("c_custkey", "c_nationkey", "ax", "ay")


def _b(spark: SparkSession, d: str) -> DataFrame:
    return points(read(spark, d, "supplier"), "s_suppkey", "b").select("s_suppkey", "s_nationkey", "bx", "by")


@query(
    f"""with {points_sql('customer', 'c_custkey', 'c')}, {AREAS_SQL}
select c_custkey, a.n_nationkey, round(sqrt((x - (x1 + x2) / 2) * (x - (x1 + x2) / 2) + (y - (y1 + y2) / 2) * (y - (y1 + y2) / 2)), 4)::double as dist
from c join areas a on x >= x1 and x < x2 and y >= y1 and y < y2"""
)
def locate_in_area(spark: SparkSession, d: str) -> DataFrame:
    inside = spatial.points_in_boxes(points(read(spark, d, "customer"), "c_custkey"), areas(spark, d), 2002.0)
    middle = geo.distance(F.col("x"), F.col("y"), (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    return inside.select("c_custkey", "n_nationkey", F.round(middle, 4).alias("dist"))


@query(
    f"""with {points_sql('customer', 'c_custkey', 'c')}, {AREAS_SQL}
select n_nationkey, count(*) as customers from c join areas on x >= x1 and x < x2 and y >= y1 and y < y2 and x + y < x1 + y1 + 2002 and (x, y) <> (x1, y1) group by 1"""
)
def locate_in_ring(spark: SparkSession, d: str) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lower = areas(spark, d).withColumn("ring", F.array(p("x1", "y1"), p("x2", "y1"), p("x1", "y2"), p("x1", "y1"))).select("n_nationkey", "x1", "y1", "ring")
    inside = spatial.points_in_rings(points(read(spark, d, "customer"), "c_custkey"), lower, 2002.0).where("x <> x1 or y <> y1")
    return inside.groupBy("n_nationkey").agg(F.count("*").alias("customers"))


_PAIRS = f"with {_SITES}, pairs as (select c_custkey, s_suppkey, c_nationkey, s_nationkey, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) as dist from c, s)"


@query(f"{_PAIRS} select c_custkey, s_suppkey, round(dist, 4) as dist from (select *, row_number() over (partition by c_custkey order by dist, s_suppkey) as rn from pairs) where rn = 1")
def nearest_site(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(_a(spark, d), _b(spark, d), "c_custkey", "s_suppkey", 1000.0).withColumn("dist", F.round("dist", 4))


@query(f"{_PAIRS} select s_suppkey, count(*) as customers from (select *, row_number() over (partition by c_custkey order by dist, s_suppkey) as rn from pairs) where rn = 1 group by 1")
def voronoi_assign(spark: SparkSession, d: str) -> DataFrame:
    owned = spatial.nearest(_a(spark, d), _b(spark, d), "c_custkey", "s_suppkey", 1000.0)
    return owned.groupBy("s_suppkey").agg(F.count("*").alias("customers"))


@query(
    f"""{_PAIRS}, near as (select *, row_number() over (partition by c_custkey order by dist, s_suppkey) as rn from pairs where dist <= 400)
select c_custkey, n.s_suppkey, round(n.dist, 4) as dist from customer left join near n using (c_custkey) where coalesce(rn, 1) = 1"""
)
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(_a(spark, d), _b(spark, d), "c_custkey", "s_suppkey", 400.0, bounded=True).withColumn("dist", F.round("dist", 4))


@query(f"{_PAIRS} select c_custkey, s_suppkey, round(dist, 4) as dist from (select *, row_number() over (partition by c_custkey order by dist, s_suppkey) as rn from pairs where c_nationkey = s_nationkey) where rn = 1")
def nearest_by_group(spark: SparkSession, d: str) -> DataFrame:
    a, b = _a(spark, d).withColumnRenamed("c_nationkey", "nation"), _b(spark, d).withColumnRenamed("s_nationkey", "nation")
    return spatial.nearest_by_group(a, b, ["nation"], "c_custkey", "s_suppkey").withColumn("dist", F.round("dist", 4))


@query(f"{_PAIRS} select s_suppkey, count(*) as customers from pairs where dist <= 700 group by 1")
def within_distance_count(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within_distance(_a(spark, d), _b(spark, d), 700.0).groupBy("s_suppkey").agg(F.count("*").alias("customers"))


@query(
    f"""with {points_sql('supplier', 's_suppkey', 's')}, {AREAS_SQL}, meeting as (
  select s_suppkey, n_nationkey, (least(x + 600, x2) - greatest(x, x1)) * (least(y + 900, y2) - greatest(y, y1)) / (600.0 * 900.0) as share from s, areas where x < x2 and x1 < x + 600 and y < y2 and y1 < y + 900
)
select s_suppkey, n_nationkey, round(share, 4)::double as share from meeting where share > 0.2"""
)
def area_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = points(read(spark, d, "supplier"), "s_suppkey").select("s_suppkey", F.col("x").alias("ax1"), F.col("y").alias("ay1"), (F.col("x") + 600).alias("ax2"), (F.col("y") + 900).alias("ay2"))
    b = areas(spark, d).withColumnsRenamed({k: f"b{k}" for k in ("x1", "y1", "x2", "y2")})
    share = geo.box_overlap(*(F.col(c) for c in ("ax1", "ay1", "ax2", "ay2", "bx1", "by1", "bx2", "by2"))) / (600.0 * 900.0)
    return spatial.boxes_meeting(a, b, 2002.0).select("s_suppkey", "n_nationkey", F.round(share, 4).alias("share"), share.alias("exact")).where("exact > 0.2").drop("exact")


@query(
    f"""with {points_sql('part', 'p_partkey', 'p')}, {points_sql('supplier', 's_suppkey', 's')}, pairs as (
  select p_partkey, s_suppkey, p_size % 25 = s_nationkey as same, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) as dist from p, s
), best as (
  select *, row_number() over (partition by p_partkey order by case when same then 0 else 1 end, dist, s_suppkey) as rn from pairs where (same and dist <= 3000) or dist <= 300
)
select p_partkey, s_suppkey, case when same then 'named' else 'nearest' end as matched_by from best where rn = 1"""
)
def route_fallback_match(spark: SparkSession, d: str) -> DataFrame:
    p = points(read(spark, d, "part"), "p_partkey", "a").select("p_partkey", (F.col("p_size") % 25).alias("named"), "ax", "ay")
    sites = _b(spark, d)
    named = spatial.within_distance(p, sites.withColumn("named", F.col("s_nationkey")), 3000.0, keys=("named",)).select("p_partkey", "s_suppkey", "dist", F.lit(True).alias("same"))
    close = spatial.within_distance(p, sites, 300.0).where(~F.col("named").eqNullSafe(F.col("s_nationkey"))).select("p_partkey", "s_suppkey", "dist", F.lit(False).alias("same"))
    pairs = named.union(close)
    best = ranking.latest(pairs, ["p_partkey"], F.col("same").desc(), F.col("dist"), F.col("s_suppkey"))
    return best.select("p_partkey", "s_suppkey", F.when(F.col("same"), "named").otherwise("nearest").alias("matched_by"))


@query(
    f"with {points_sql('customer', 'c_custkey', 'c')} select min(x) as x1, max(x) as x2, min(y) as y1, max(y) as y2, count(*) as total, (select count(*) from (select 1 from customer limit 50)) as shown from c"
)
def bbox_count_capped(spark: SparkSession, d: str) -> DataFrame:
    p = points(read(spark, d, "customer"), "c_custkey")
    shown = tables.capped(p, 50, F.col("c_custkey")).agg(F.count("*").alias("shown"))
    return p.agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("total")).join(F.broadcast(shown), F.lit(True))


# -- scores --------------------------------------------------------------------------------------

_ASSETS = """assets as (
  select s_suppkey as entity, case s_suppkey % 6 when 0 then 'VE' when 1 then 'AE' when 2 then 'A' when 3 then 'AO' when 4 then 'X' end as zone, s_nationkey % 3 = 0 as in_sea_level, s_nationkey % 4 = 0 as in_surge,
         case when s_suppkey % 5 < 4 then (s_suppkey * 13 % 30)::double end as slope, case when s_suppkey % 4 < 3 then (s_suppkey * 137 % 6000)::double end as fault_distance from supplier
), hazards as (
  select entity, scenario, round(least(0.95, least(coalesce(case zone when 'VE' then 0.85::double when 'AE' then 0.70::double when 'A' then 0.60::double when 'AO' then 0.40::double when 'X' then 0.05::double end, 0.03::double) * multiplier, 0.95)
    + case when sea_level and in_sea_level then 0.30::double else 0 end + case when surge and in_surge then 0.25::double else 0 end
    + case when slope >= 20 then 0.15::double when slope >= 10 then 0.08::double else 0 end
    + case when seismic then case when fault_distance <= 500 then 0.30::double when fault_distance <= 2000 then 0.15::double when fault_distance <= 5000 then 0.05::double else 0 end else 0 end), 4) as hazard
  from assets, (values ('cat3', false, true, 1.5::double, false), ('slr2ft', true, false, 1.0::double, false), ('combined', true, true, 1.5::double, false), ('quake', false, false, 0.0::double, true)) t(scenario, sea_level, surge, multiplier, seismic)
)"""


def _hazards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    zone = F.when(k % 6 == 0, "VE").when(k % 6 == 1, "AE").when(k % 6 == 2, "A").when(k % 6 == 3, "AO").when(k % 6 == 4, "X")
    assets = read(spark, d, "supplier").select(
        k.alias("entity"), zone.alias("zone"), (F.col("s_nationkey") % 3 == 0).alias("in_sea_level"), (F.col("s_nationkey") % 4 == 0).alias("in_surge"),
        F.when(k % 5 < 4, (k * 13 % 30).cast("double")).alias("slope"), F.when(k % 4 < 3, (k * 137 % 6000).cast("double")).alias("fault_distance"),
    )
    return scoring.hazard(assets)


@query(f"with {_ASSETS} select entity, scenario, hazard from hazards")
def hazard_score(spark: SparkSession, d: str) -> DataFrame:
    return _hazards(spark, d).select("entity", "scenario", "hazard")


@query(
    f"""{_SERVED}, {_ASSETS}, once as (
  select *, row_number() over (partition by root, entity order by depth, confidence desc) as rn from served where via = 'POWERS'
), impact as (select root, round(sum({CRITICALITY_SQL} * confidence), 4) as cascade from once where rn = 1 group by root),
scored as (select scenario, h.entity, round(hazard * cascade * (1 + (h.entity % 10) / 100.0::double) + 1e-9::double, 4) as composite from hazards h join impact on root = h.entity)
select scenario, entity, composite, row_number() over (partition by scenario order by composite desc, entity) as rank from scored"""
)
def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    impact = _impact(spark, d).select(F.col("root").alias("entity"), F.col("impact").alias("cascade"))
    both = _hazards(spark, d).join(impact, "entity").withColumn("betweenness", (F.col("entity") % 10) / 100.0)
    return scoring.composite(both).select("scenario", "entity", "composite", F.col("rank").cast("long").alias("rank"))


_NATIONS = """nations as (
  select n_nationkey, n_regionkey, count(distinct c_custkey) as customers, coalesce(avg(c_acctbal), 0) as income, (select count(*) from supplier where s_nationkey = n_nationkey) as facilities
  from nation left join customer on c_nationkey = n_nationkey group by 1, 2
), judged as (
  select *, round((n_nationkey * 37 % 100) / 100.0, 4)::double as flood, case when n_nationkey % 4 < 3 then (n_nationkey * 7 % 90)::double end as slope from nations
), ranked as (
  select *, percent_rank() over (order by round(0.7 * flood + 0.3 * (1 - least(coalesce(slope, 38) / 76.0, 1)), 6) nulls last) as svi from judged
)"""


def _nations(spark: SparkSession, d: str) -> DataFrame:
    n, c, s = read(spark, d, "nation"), read(spark, d, "customer"), read(spark, d, "supplier")
    people = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("customers"), F.avg("c_acctbal").alias("income"))
    sites = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("facilities"))
    k = F.col("n_nationkey")
    both = n.join(people, "n_nationkey", "left").join(sites, "n_nationkey", "left").na.fill(0, ["customers", "facilities"]).na.fill(0.0, ["income"])
    both = both.withColumn("flood", F.round((k * 37 % 100) / 100.0, 4)).withColumn("slope", F.when(k % 4 < 3, (k * 7 % 90).cast("double")))
    return scoring.vulnerability(both)


@query(f"with {_NATIONS} select n_nationkey, round(svi, 6) as svi from ranked")
def svi_percentile(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d).select("n_nationkey", F.round("svi", 6).alias("svi"))


@query(
    f"""with {_NATIONS} select n_nationkey, round(0.5 * (1 - svi) + 0.3 * (least(facilities / (case when customers = 0 then null else customers end / 1000.0), 0.02) / 0.02) + 0.2 *
  case n_nationkey % 5 when 0 then 0.9 when 1 then 0.8 when 2 then 0.7 when 3 then 0.5 else 0.3 end, 4)::double as resilience from ranked"""
)
def community_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    kinds = F.when(k == 0, "relocation").when(k == 1, "elevation").when(k == 2, "hardening").when(k == 3, "redundant_feed")
    return scoring.community(_nations(spark, d).withColumn("population", F.nullif("customers", F.lit(0))).withColumn("intervention", kinds)).select("n_nationkey", "resilience")


@query(f"with {_NATIONS} select n_regionkey, round(coalesce(sum(customers * svi) / nullif(sum(customers), 0), 0.5), 6)::double as svi from ranked group by 1")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    return n.groupBy("n_regionkey").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("customers") * F.col("svi")), F.sum("customers")), F.lit(0.5)), 6).alias("svi"))


@query(
    f"""{_SERVED}, people as (select p_partkey as entity, p_size * 10 as population, p_retailprice as income from part),
per_root as (select root, sum(population) as population, sum(population * income) / nullif(sum(population), 0) as income from served join people using (entity) where via = 'POWERS' group by root)
select root, population::bigint as population, round(population * (0.822::double * 5.0::double * 33.6::double * 17.29::double), 2) as benefit, round(population * (0.822::double * 5.0::double * 33.6::double * 17.29::double) * 0.4::double, 2) as economic,
  round(population * income / 365, 2) as daily from per_root"""
)
def voll_exposure(spark: SparkSession, d: str) -> DataFrame:
    people = read(spark, d, "part").select(F.col("p_partkey").alias("entity"), (F.col("p_size") * 10).alias("population"), F.col("p_retailprice").alias("income"))
    return scoring.exposure(_levels(spark, d, first=False), powers(spark, d), people)


_SITES_OF_HOMES = f"{points_sql('part', 'p_partkey', 'p')}, {points_sql('supplier', 's_suppkey', 's')}"
_HOMES = "people as (select p_partkey as entity, p_size * 10 as population, case when p_size % 7 > 0 then p_retailprice * 100 end as home_value, case when p_size % 6 > 0 then (p_partkey * 37 % 100) / 100.0::double end as svi from part)"


def _homes(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return read(spark, d, "part").select(
        k.alias("entity"), (size * 10).alias("population"), F.when(size % 7 > 0, F.col("p_retailprice") * 100).alias("home_value"), F.when(size % 6 > 0, (k * 37 % 100) / 100.0).alias("svi")
    )


@query(
    f"""{_SERVED}, {_HOMES},
per_root as (select root, sum(population * coalesce(svi, 0.5::double)) / nullif(sum(population), 0) as svi from served join people using (entity) where via = 'POWERS' group by root)
select s_suppkey as root, round(coalesce(svi, 0.5::double), 6) as svi from supplier left join per_root on root = s_suppkey"""
)
def reached_svi(spark: SparkSession, d: str) -> DataFrame:
    return scoring.reached_vulnerability(_levels(spark, d, first=False), powers(spark, d), _homes(spark, d)).select("root", F.round("svi", 6).alias("svi"))


@query(
    f"""{_SERVED}, {_HOMES}, {_SITES_OF_HOMES},
per_root as (select root, sum(population * home_value) / nullif(sum(population), 0) as home_value from served join people using (entity) where via = 'POWERS' group by root),
near as (select s_suppkey as root, sum(p_size) as housing from s join p on sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) <= 500 group by 1)
select s_suppkey as root, coalesce(housing, 0)::bigint as housing, round(coalesce(housing, 0) * coalesce(home_value, 0) * 0.05::double, 2) as property_impact
from supplier left join per_root on per_root.root = s_suppkey left join near on near.root = s_suppkey"""
)
def relocation_impact(spark: SparkSession, d: str) -> DataFrame:
    roots = points(read(spark, d, "supplier"), "s_suppkey", "a").select(F.col("s_suppkey").alias("root"), "ax", "ay")
    homes = points(read(spark, d, "part"), "p_partkey", "b").select(F.col("p_size").alias("housing"), "bx", "by")
    return scoring.relocation(_levels(spark, d, first=False), powers(spark, d), _homes(spark, d), roots, homes)


@query("select p_partkey, round(percent_rank() over (order by case when p_size % 9 > 0 then p_retailprice end nulls last), 8) as pr from part")
def percent_rank_null_last(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 9 > 0, F.col("p_retailprice")).alias("v"))
    return ranking.global_rank(part, "v", "pr", percent=True).select("p_partkey", F.round("pr", 8).alias("pr"))


@query(
    """select p_partkey, round((coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3) / nullif(case when a is not null then 0.5 else 0 end + case when b is not null then 0.3 else 0 end, 0), 8)::double as blend
from (select p_partkey, case when p_size % 3 > 0 then p_size / 50.0::double end as a, case when p_size % 2 > 0 then p_retailprice / 2000 end as b from part)"""
)
def weighted_blend(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    part = read(spark, d, "part").select("p_partkey", F.when(size % 3 > 0, size / 50.0).alias("a"), F.when(size % 2 > 0, F.col("p_retailprice") / 2000).alias("b"), F.lit(1.0).alias("unused"))
    return part.select("p_partkey", F.round(ranking.weighted_blend({"a": 0.5, "b": 0.3, "unused": 0.0}), 8).alias("blend"))


@query(
    f"""{_PAIRS}, near as (select c_custkey, min(dist) as d1, min(case when s_suppkey % 3 = 0 then dist end) as d2 from pairs group by 1),
ranked as (select c_custkey, 1 - percent_rank() over (order by d1 nulls last) as s1, 1 - percent_rank() over (order by d2 nulls last) as s2 from near)
select c_custkey, round((s1 * 0.18::double + s2 * 0.12::double) / (0.18::double + 0.12::double), 6) as composite from ranked"""
)
def rerank_weights(spark: SparkSession, d: str) -> DataFrame:
    a, b = _a(spark, d), _b(spark, d)
    one = spatial.nearest(a, b, "c_custkey", "s_suppkey", 1000.0).select("c_custkey", F.col("dist").alias("d1"))
    two = spatial.nearest(a, b.where("s_suppkey % 3 = 0"), "c_custkey", "s_suppkey", 1000.0).select("c_custkey", F.col("dist").alias("d2"))
    return scoring.site_scores(one.join(two, "c_custkey"), {"power_access": "d1", "water_access": "d2"}).select("c_custkey", "composite")


_YEARS = """years as (select year(l_shipdate) as run, l_returnflag as scenario, l_suppkey as entity, sum(l_quantity) as q from lineitem group by 1, 2, 3),
history as (select scenario, run, entity, row_number() over (partition by scenario, run order by q desc, entity) as rank from years),
two as (select *, dense_rank() over (partition by scenario order by run desc) as age from history)"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    years = read(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("run"), F.col("l_returnflag").alias("scenario"), F.col("l_suppkey").alias("entity")).agg(F.sum("l_quantity").alias("q"))
    return ranking.place(years, ["scenario", "run"], [F.col("q").desc(), F.col("entity")]).select("scenario", "run", "entity", "rank")


@query(
    f"""with {_YEARS}, moved as (
  select n.scenario, n.entity, n.rank, p.rank as previous from (select * from two where age = 1 and rank <= 10) n left join (select * from two where age = 2) p using (scenario, entity)
  where p.rank is null or p.rank > 10 or abs(n.rank - p.rank) >= 3
)
select scenario, entity, rank, previous from (select *, row_number() over (partition by scenario order by rank, entity) as place from moved) where place <= 5"""
)
def rank_movement(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rank_movement(_history(spark, d))


@query(
    f"""with {points_sql('supplier', 's_suppkey', 's')} select count(*) filter (where s_nationkey % 5 = 0) as hospitals, count(*) as assets, sum(s_suppkey * 10)::bigint as population,
  case when sum(s_suppkey * 10) >= 1000000 then 'island-wide' else 'local' end as reach from s where x >= 2000 and x < 8000 and y >= 1000 and y < 6000"""
)
def storm_consequence(spark: SparkSession, d: str) -> DataFrame:
    cone = spark.createDataFrame([(2000.0, 1000.0, 8000.0, 6000.0)], "x1 double, y1 double, x2 double, y2 double")
    hit = spatial.points_in_boxes(points(read(spark, d, "supplier"), "s_suppkey"), cone, 2002.0)
    return hit.agg(
        F.count_if(F.col("s_nationkey") % 5 == 0).alias("hospitals"), F.count("*").alias("assets"), F.sum(F.col("s_suppkey") * 10).alias("population"),
        F.when(F.sum(F.col("s_suppkey") * 10) >= 1_000_000, "island-wide").otherwise("local").alias("reach"),
    )


# -- parcels and owners --------------------------------------------------------------------------


@query(
    """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc) as rn from orders) where rn = 1"""
)
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return ranking.latest(read(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey", "o_totalprice")


_SNAPSHOTS = """old as (select o_orderkey as key, case when o_orderkey % 13 <> 0 then o_custkey end as owner, case when o_orderkey % 19 <> 0 then o_totalprice end as value,
  case when o_orderkey % 29 <> 0 then o_orderdate end as sold from orders where o_orderkey % 10 <> 0),
new as (select o_orderkey as key, case when o_orderkey % 17 = 0 then null when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end as owner,
  case when o_orderkey % 23 = 0 then null when o_orderkey % 5 = 0 then o_totalprice * 2 when o_orderkey % 3 = 0 then o_totalprice + 0.5 else o_totalprice end as value,
  case when o_orderkey % 31 = 0 then null when o_orderkey % 11 = 0 then o_orderdate + interval 30 days else o_orderdate end as sold from orders),
deltas as (
  select n.key, 'new_parcel' as change_type, null::varchar as old_value, n.key::varchar as new_value from new n left join old o using (key) where o.key is null
  union all select key, 'owner_change', o.owner::varchar, n.owner::varchar from new n join old o using (key) where n.owner is distinct from o.owner and n.owner is not null
  union all select key, 'value_change', o.value::decimal(18, 2)::varchar, n.value::decimal(18, 2)::varchar from new n join old o using (key) where abs(n.value - o.value) >= 1
  union all select key, 'sale', strftime(o.sold, '%Y-%m-%d %H:%M:%S'), strftime(n.sold, '%Y-%m-%d %H:%M:%S') from new n join old o using (key) where n.sold > o.sold or (o.sold is null and n.sold is not null)
)"""


@query(f"with {_SNAPSHOTS} select * from deltas")
def snapshot_deltas(spark: SparkSession, d: str) -> DataFrame:
    return tables.snapshot_deltas(*snapshots(spark, d), "o_orderkey")


@query(f"with {_SNAPSHOTS} select change_type, count(*) as n from deltas group by 1")
def delta_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.snapshot_deltas(*snapshots(spark, d), "o_orderkey").groupBy("change_type").agg(F.count("*").alias("n"))


@query(
    """select count(*) as sales, count(*) filter (where o_totalprice > 300000) as large, quantile_disc(o_totalprice, 0.5) as median, quantile_disc(o_totalprice, 0.5) filter (where o_orderdate >= date '2000-01-01') as median_recent
from orders where o_totalprice between 1000 and 50000000 and o_orderdate between date '1980-01-01' and date '2001-08-01'"""
)
def sales_summary_filter(spark: SparkSession, d: str) -> DataFrame:
    sane = read(spark, d, "orders").where(F.col("o_totalprice").between(1e3, 5e7) & F.col("o_orderdate").between("1980-01-01", "2001-08-01"))
    return sane.agg(
        F.count("*").alias("sales"), F.count_if(F.col("o_totalprice") > 300000).alias("large"), F.expr("percentile_disc(0.5) within group (order by o_totalprice)").alias("median"),
        F.expr("percentile_disc(0.5) within group (order by o_totalprice) filter (where o_orderdate >= timestamp_ntz'2000-01-01 00:00:00')").alias("median_recent"),
    )


@query(
    """with sales as (select c_nationkey as nation, year(o_orderdate) as y, o_totalprice as price from orders join customer on c_custkey = o_custkey),
now as (select nation, count(*) as n, sum(price) as total from sales where y = 2000 group by 1), before as (select nation, count(*) as n from sales where y = 1999 group by 1)
select n.nation, n.n, round(n.total, 2) as total, round((n.n - b.n) / b.n::double, 4) as momentum from now n left join before b using (nation)"""
)
def sales_by_nation_momentum(spark: SparkSession, d: str) -> DataFrame:
    sales = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("price"))
    by = sales.where("y in (1999, 2000)").groupBy("nation").agg(F.count_if(F.col("y") == 2000).alias("n"), F.sum(F.when(F.col("y") == 2000, F.col("price"))).alias("total"), F.count_if(F.col("y") == 1999).alias("m"))
    return by.where("n > 0").select("nation", "n", F.round("total", 2).alias("total"), F.round(F.try_divide(F.col("n") - F.col("m"), F.col("m").cast("double")), 4).alias("momentum"))


@query("select year(o_orderdate)::int as year, count(*) as sales, quantile_disc(o_totalprice, 0.5) as median from orders group by 1")
def sales_by_year(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("sales"), F.expr("percentile_disc(0.5) within group (order by o_totalprice)").alias("median"))


@query(
    """with counts as (select o_custkey as owner, o_orderpriority as p, count(*) as n from orders group by 1, 2), best as (select *, row_number() over (partition by owner order by n desc, p) as rn from counts)
select o_custkey as owner, count(*) as parcels, round(sum(o_totalprice), 2) as total, min(b.p) as display, count(distinct o_orderstatus) as states from orders join best b on b.owner = o_custkey and rn = 1 group by 1"""
)
def owner_mode_rollup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(
        F.count("*").alias("parcels"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.expr("mode() within group (order by o_orderpriority)").alias("display"), F.countDistinct("o_orderstatus").alias("states")
    )


@query("select c_custkey, c_name from customer where starts_with(c_custkey::varchar, '12') union all select c_custkey, c_name from customer where c_name ilike '%r#00000099%'")
def owner_search(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumn("id", F.col("c_custkey").cast("string"))
    hits = lambda q: c.where(text.routed_search(q, "id", "c_name")).select("c_custkey", "c_name")
    return hits("12").unionByName(hits("r#00000099"))


@query("select o_custkey as owner, o_orderkey as parcel, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)::decimal(18, 2)::double as held from orders")
def owner_timeline(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("parcel"), F.sum("o_totalprice").over(w).cast("decimal(18,2)").cast("double").alias("held"))


_FOLD = f"translate(upper(translate({{}}, '{text.ACCENTED}', '{text.FOLDED}')), '.', '')"


@query(
    f"""select doc_id, nullif(regexp_replace(trim(regexp_replace(regexp_replace({_FOLD.format("replace(text, 'ß', 'ss') || ', Inc.'")}, '[^0-9A-Z ]', ' ', 'g'), '\\s+', ' ', 'g')), '(\\s+(LLC|INC|INCORPORATED|CORP|CORPORATION|LTD|LIMITED|LP|LLP|PSC|SRL))+$', ''), '') as owner_key
from documents"""
)
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("text", F.lit(", Inc."))
    return read(spark, d, "documents").select("doc_id", F.nullif(text.owner_key(name), F.lit("")).alias("owner_key"))


@query(
    """select c_custkey, case when street is null then town when street like '%' || town || '%' then street else street || ', ' || town end as address
from (select c_custkey, n_name as town, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then 'CALLE ' || c_custkey else 'CALLE ' || c_custkey || ' ' || n_name end as street from customer join nation on n_nationkey = c_nationkey)"""
)
def address_backfill(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    street = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" Calle  "), k.cast("string"))).otherwise(F.concat(F.lit("calle "), k.cast("string"), F.lit("  "), F.lower("n_name")))
    return both.select("c_custkey", text.address(street, F.col("n_name")).alias("address"))


# -- relational ----------------------------------------------------------------------------------


@query("select l_orderkey, string_agg(distinct l_returnflag, ', ' order by l_returnflag) as flags, bool_or(l_quantity > 40) as any_large, bool_and(l_quantity > 5) as all_some from lineitem group by 1")
def listagg_sorted(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ")
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(flags.alias("flags"), F.bool_or(F.col("l_quantity") > 40).alias("any_large"), F.bool_and(F.col("l_quantity") > 5).alias("all_some"))


@query("select (select count(*) from customer) as customers, (select count(*) from orders) as orders, (select count(*) from supplier) as suppliers, (select count(*) from part) as parts, (select coalesce(sum(l_quantity), 0) from lineitem)::double as quantity")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, name, agg: read(spark, d, t).agg(agg.alias(name))
    out = one("customer", "customers", F.count("*"))
    for t, name, agg in (("orders", "orders", F.count("*")), ("supplier", "suppliers", F.count("*")), ("part", "parts", F.count("*")), ("lineitem", "quantity", F.coalesce(F.sum("l_quantity"), F.lit(0.0)))):
        out = out.join(F.broadcast(one(t, name, agg)), F.lit(True))
    return out


@query("select c_mktsegment, c_nationkey, count(*) as n, grouping(c_mktsegment)::int as g from customer group by rollup (c_mktsegment, c_nationkey)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.grouping("c_mktsegment").cast("int").alias("g"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    on = c["c_custkey"] == o["o_custkey"]
    return c.join(o.where("o_totalprice > 400000"), on, "left_semi").join(o.where("o_orderstatus = 'F'"), on, "left_anti").select("c_custkey")


@query("select substr(p_brand, 1, 7) as brand, count(*) as parts, avg(p_retailprice) as price from part where p_name not like '%\\_%' escape '\\' and p_name ilike '%RED%' group by 1")
def brand_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").where(~F.col("p_name").like("%\\_%") & F.col("p_name").ilike("%RED%"))
    return p.groupBy(F.substring("p_brand", 1, 7).alias("brand")).agg(F.count("*").alias("parts"), F.avg("p_retailprice").alias("price"))


# -- optimisation --------------------------------------------------------------------------------

_KINDS = "(values ('hardening', 2500000.0::double, 50000.0::double, 0.5::double, 1.0::double, 1.0::double), ('redundant_feed', 8000000.0, 80000.0, 0.85, 0.6, 0.5), ('elevation', 4500000.0, 30000.0, 0.3, 1.0, 1.0), ('relocation', 35000000.0, 200000.0, 0.03, 1.0, 1.0)) k(kind, construction, upkeep, fh, fc, fb)"
_CATALOG = f"""base as (select p_partkey as entity, (p_partkey % 50) / 50.0::double as hazard, p_size::double as cascade, (p_partkey % 7) / 100.0::double as betweenness, p_retailprice * 10000 as benefit from part),
catalog as (select entity, kind, construction + upkeep * ((1 - 1.04::double ** -30) / 0.04::double) as cost, greatest(hazard * cascade * (1 + betweenness) - (hazard * fh) * (cascade * fc) * (1 + betweenness * fb), 0) as uplift, benefit * (1 - fh) as avoided from base, {_KINDS})"""


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    assets = read(spark, d, "part").select(k.alias("entity"), ((k % 50) / 50.0).alias("hazard"), F.col("p_size").cast("double").alias("cascade"), ((k % 7) / 100.0).alias("betweenness"), (F.col("p_retailprice") * 10000).alias("benefit"))
    return optimize.catalog(assets)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).withColumn("scenario", F.concat(F.lit("s"), (F.col("entity") % 3).cast("string")))


@query(f"with {_CATALOG} select entity, kind, round(cost, 2) as cost, round(uplift, 6) as uplift, round(avoided, 2) as avoided, round(uplift / (cost / 1000000), 6) as per_million from catalog")
def intervention_catalog(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).select("entity", "kind", F.round("cost", 2).alias("cost"), F.round("uplift", 6).alias("uplift"), F.round("avoided", 2).alias("avoided"), F.round("uplift_per_million", 6).alias("per_million"))


@query(
    f"""with recursive {_CATALOG}, fit as (select 's' || entity % 3 as scenario, entity, kind, cost, uplift, uplift / (cost / 1000000) as rate from catalog where uplift > 0 and cost <= 60000000),
queue as (select *, row_number() over (partition by scenario order by rate desc, uplift desc, entity, kind) as rn from fit),
scan as (
  select distinct scenario, 0::bigint as rn, 0::bigint as place, null::bigint as entity, null::varchar as kind, null::double as cost, null::double as uplift, 0::double as spent, 0::double as gained, []::bigint[] as taken, false as chosen from queue
  union all select q.scenario, q.rn, place + t::int, q.entity, q.kind, q.cost, q.uplift, case when t then spent + q.cost else spent end, case when t then gained + q.uplift else gained end, case when t then list_append(taken, q.entity) else taken end, t
  from (select s.*, q.rn as next, not list_contains(s.taken, q.entity) and s.spent + q.cost <= 60000000 as t from scan s join queue q on q.scenario = s.scenario and q.rn = s.rn + 1) s join queue q on q.scenario = s.scenario and q.rn = s.next
)
select scenario, place::int as place, entity, kind, cost, uplift, spent as total_cost, gained as total_uplift from scan where chosen"""
)
def portfolio_greedy(spark: SparkSession, d: str) -> DataFrame:
    return optimize.greedy(_items(spark, d), 60e6)


@query()
def portfolio_exact(spark: SparkSession, d: str) -> DataFrame:
    return optimize.exact(_items(spark, d), 60e6)


@query(
    f"""with {_CATALOG}, a as (select * from catalog where kind in ('hardening', 'elevation')), b as (select * from catalog where kind in ('elevation', 'relocation'))
select ((select sum(cost::decimal(20, 4)) from b) - (select sum(cost::decimal(20, 4)) from a))::double as delta_cost, round(((select sum(uplift::decimal(20, 8)) from b) - (select sum(uplift::decimal(20, 8)) from a))::double, 4) as delta_uplift,
  (select count(*) from a anti join b using (entity, kind)) as only_a, (select count(*) from b anti join a using (entity, kind)) as only_b, (select count(*) from a semi join b using (entity, kind)) as shared"""
)
def portfolio_compare(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    a, b = c.where("kind in ('hardening', 'elevation')"), c.where("kind in ('elevation', 'relocation')")
    return optimize.compare(a, b, ["entity", "kind"])


@query(
    """with t as (select p_partkey, p_retailprice as base, p_retailprice + p_size * m as changed, m from part, (values (0), (10), (100)) v(m)),
r as (select *, rank() over (partition by m order by base) + (count(*) over (partition by m, base) - 1) / 2.0::double as ra, rank() over (partition by m order by changed) + (count(*) over (partition by m, changed) - 1) / 2.0::double as rb,
  row_number() over (partition by m order by base desc, p_partkey) as pa, row_number() over (partition by m order by changed desc, p_partkey) as pb from t),
s as (select m, round(corr(ra, rb), 4) as rho, round(count(*) filter (where pa <= 10 and pb <= 10) / 10.0::double, 4) as overlap from r group by m)
select m, rho, overlap, rho >= 0.9 and overlap >= 0.8 as stable from s"""
)
def sensitivity_grid(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").withColumn("m", F.explode(F.array(F.lit(0), F.lit(10), F.lit(100)))).select("p_partkey", F.col("p_retailprice").alias("base"), (F.col("p_retailprice") + F.col("p_size") * F.col("m")).alias("changed"), "m")
    return validate.rank_stability(t, "p_partkey", "base", "changed", "m")


@query(
    """with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0::double as ra, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0::double as rb from part)
select round(corr(ra, rb), 6) as rho, count(*) as n from r"""
)
def spearman_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.spearman(read(spark, d, "part"), "p_size", "p_retailprice").select(F.round("rho", 6).alias("rho"), "n")


@query(
    """with p as (select distinct s_suppkey % 4 as event, s_nationkey as item from supplier where s_suppkey % 3 = 0), a as (select n_nationkey % 4 as event, n_nationkey as item from nation where n_nationkey % 2 = 0),
m as (select coalesce(p.event, a.event) as event, p.item as pi, a.item as ai from p full join a on p.event = a.event and p.item = a.item), c as (select event, count(*) filter (where pi is not null and ai is not null) as hits, count(pi) as np, count(ai) as na from m group by event)
select event, hits, round(hits / nullif(np, 0)::double, 4) as precision, round(hits / nullif(na, 0)::double, 4) as recall from c"""
)
def backtest_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "supplier").where("s_suppkey % 3 = 0").select((F.col("s_suppkey") % 4).alias("event"), F.col("s_nationkey").cast("long").alias("item"))
    a = read(spark, d, "nation").where("n_nationkey % 2 = 0").select((F.col("n_nationkey") % 4).cast("long").alias("event"), F.col("n_nationkey").cast("long").alias("item"))
    return validate.precision_recall(p, a, ["event"], "item")


# -- rasters -------------------------------------------------------------------------------------

# A cell of each part, 50 to a row.
_GRID = "grid as (select p_partkey // 50 as row, p_partkey % 50 as col, ((p_partkey // 50 * 7 + p_partkey % 50 * 13) % 50 + p_size * 0.5)::double as value from part)"
_GRADIENTS = """g as (select *, lag(value) over (partition by row order by col) as l, lead(value) over (partition by row order by col) as r, lag(value) over (partition by col order by row) as u, lead(value) over (partition by col order by row) as d from grid),
slopes as (select row, col, value, case when l is null then (r - value) / 30 when r is null then (value - l) / 30 else (r - l) / 60 end as gx, case when u is null then (d - value) / 30 when d is null then (value - u) / 30 else (d - u) / 60 end as gy from g)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    cells = read(spark, d, "part").select(F.floor(k / 50).cast("long").alias("row"), (k % 50).alias("col"), "p_size")
    return cells.select("row", "col", ((F.col("row") * 7 + F.col("col") * 13) % 50 + F.col("p_size") * 0.5).cast("double").alias("value"))


@query(f"with {_GRID}, {_GRADIENTS} select row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 4) as slope from slopes")
def slope_gradient(spark: SparkSession, d: str) -> DataFrame:
    return raster.slope(_grid(spark, d), 30.0).select("row", "col", F.round("slope", 4).alias("slope"))


@query(
    f"""with {_GRID}, {_GRADIENTS} select row, col, round(greatest(sin(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + cos(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135) - atan2(-gx, gy)), 0) * 255, 4) as shade from slopes"""
)
def hillshade(spark: SparkSession, d: str) -> DataFrame:
    return raster.hillshade(_grid(spark, d), 30.0).select("row", "col", F.round("shade", 4).alias("shade"))


@query(f"with {_GRID}, {_GRADIENTS} select distinct (row // 10)::bigint as big_row, (col // 10)::bigint as big_col from slopes where degrees(atan(sqrt(gx * gx + gy * gy) / 3)) < 15")
def low_slope_cells(spark: SparkSession, d: str) -> DataFrame:
    flat = raster.slope(_grid(spark, d), 90.0).where("slope < 15")
    return flat.select(F.floor(F.col("row") / 10).alias("big_row"), F.floor(F.col("col") / 10).alias("big_col")).distinct()


@query(
    f"""with {points_sql('supplier', 's_suppkey', 's')}, {points_sql('customer', 'c_custkey', 'c')}, cells as (select distinct floor(y / 300)::bigint as row, floor(x / 300)::bigint as col from c),
means as (select floor(y / 300)::bigint as row, floor(x / 300)::bigint as col, avg(s_acctbal) as mean from s group by 1, 2)
select row, col, round(coalesce(mean, (select median(mean) from means)), 4) as value from cells left join means using (row, col)"""
)
def grid_bin_mean_fill(spark: SparkSession, d: str) -> DataFrame:
    cells = points(read(spark, d, "customer"), "c_custkey").select(F.floor(F.col("y") / 300).alias("row"), F.floor(F.col("x") / 300).alias("col")).distinct()
    samples = points(read(spark, d, "supplier"), "s_suppkey").withColumn("value", F.col("s_acctbal"))
    return raster.bin_mean(samples, cells, 300.0).withColumn("value", F.round("value", 4))


def _surface(spark: SparkSession, d: str) -> DataFrame:
    r, c = F.col("row"), F.col("col")
    return raster.cost_surface(
        _grid(spark, d).select("row", "col", (F.col("value") / 3).alias("grade"), F.when(c % 7 == 0, 1.0).otherwise(0.0).alias("flood"), ((r * c % 10) / 10.0).alias("people"), ((r % 10 == 3) & (c > 10)).alias("water"))
    )


@query(
    f"""with {_GRID} select row, col, round(case when row % 10 = 3 and col > 10 then 1000000.0::double else greatest(case when value / 3 >= 15 then 8.0::double when value / 3 >= 5 then 2.667::double else 1.0::double end
  + 0.5::double * case when col % 7 = 0 then 1 else 0 end - least(3.0::double * (row * col % 10) / 10.0::double, 3.0::double), 0.1::double) end, 6) as cost from grid"""
)
def cost_surface(spark: SparkSession, d: str) -> DataFrame:
    return _surface(spark, d).withColumn("cost", F.round("cost", 6))


@query()
def least_cost_path(spark: SparkSession, d: str) -> DataFrame:
    surface = _surface(spark, d)
    last = surface.agg(F.max("row").cast("int").alias("last"))
    one, two = F.struct(F.lit(1).cast("long").alias("trip"), F.lit(0).alias("c1"), F.lit(20).alias("c2"), F.lit(3).alias("alternatives")), F.struct(F.lit(2).cast("long").alias("trip"), F.lit(45).alias("c1"), F.lit(2).alias("c2"), F.lit(1).alias("alternatives"))
    trips = last.select(F.explode(F.array(one, two)).alias("t"), "last").select("t.trip", F.lit(0).alias("r1"), "t.c1", F.greatest(F.col("last") - 1, F.lit(0)).alias("r2"), "t.c2", "t.alternatives")
    return wayfinding.least_cost_paths(surface, trips)


@query(
    """with t as (select p_partkey, p_type, case when lag(p_type) over (order by p_partkey) is not distinct from p_type and row_number() over (order by p_partkey) > 1 then 0 else 1 end as turn, p_partkey % 8 as line from part),
u as (select line, p_partkey, p_type, case when lag(p_type) over (partition by line order by p_partkey) is not distinct from p_type and row_number() over (partition by line order by p_partkey) > 1 then 0 else 1 end as turn from t),
i as (select *, sum(turn) over (partition by line order by p_partkey) as island from u)
select line, island::bigint as island, min(p_type) as kind, count(*) as cells from i group by 1, 2"""
)
def segment_islands(spark: SparkSession, d: str) -> DataFrame:
    runs = tables.islands(read(spark, d, "part").withColumn("line", F.col("p_partkey") % 8), ["line"], "p_partkey", "p_type")
    return runs.groupBy("line", "island").agg(F.min("p_type").alias("kind"), F.count("*").alias("cells"))


@query(
    """with p as (select p_partkey % 8 as line, p_partkey, (p_partkey // 8 * 100)::double as dist, case when p_size % 4 > 0 then p_size::double end as e from part),
f as (select *, last_value(e ignore nulls) over (partition by line order by p_partkey rows unbounded preceding) as elevation from p)
select line, p_partkey, elevation, round((elevation - lag(elevation) over w) / nullif(dist - lag(dist) over w, 0) * 100, 4) as grade from f window w as (partition by line order by p_partkey)"""
)
def profile_grade(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    samples = read(spark, d, "part").select((k % 8).alias("line"), "p_partkey", (F.floor(k / 8) * 100).cast("double").alias("dist"), F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("double")).alias("elevation"))
    return raster.profile(samples, ["line"], "p_partkey").select("line", "p_partkey", "elevation", "grade")


# -- feeds ---------------------------------------------------------------------------------------


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is null or b is distinct from event_type")
def change_only_history(spark: SparkSession, d: str) -> DataFrame:
    return tables.changed_rows(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return tables.upsert(e.where("event_id % 2 = 0"), e, ["user_id"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type")


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def append_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_type", "event_id")
    return tables.insert_ignore(e.limit(0), e, ["user_id", "event_type"], F.col("event_id"))


@query(
    """select event_type, max(ts) as fetched_at, date_diff('second', date_trunc('second', max(ts)), timestamp '2024-01-31 00:00:00') / 60.0 > 1.5 * 600 as stale from events group by 1 union all select 'never', null, true"""
)
def feed_freshness(spark: SparkSession, d: str) -> DataFrame:
    last = read(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("fetched_at"))
    last = last.union(spark.range(1).select(F.lit("never"), F.lit(None).cast("timestamp_ntz"))).withColumn("interval_minutes", F.lit(600)).withColumn("at", F.col("fetched_at").cast("timestamp"))
    feeds_ = last.select("event_type", F.col("at").alias("fetched_at"), "interval_minutes", F.col("fetched_at").alias("kept"))
    return streams.freshness(feeds_, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("event_type", F.col("kept").alias("fetched_at"), "stale")


@query(
    """select * from (select 'event' as kind, ts as "at", event_type as detail from events where value > 100 union all select 'order', o_orderdate, o_orderpriority from orders) order by "at" desc nulls last, kind, detail limit 12"""
)
def typed_change_stream(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("value > 100").select(F.col("ts").alias("at"), F.col("event_type").alias("detail"))
    o = read(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("detail"))
    return streams.change_stream({"event": e, "order": o})


@query("select event_id, b is null or ts - b > interval 24 hours as sent from (select *, lag(ts) over (partition by user_id, event_type order by ts) as b from events)")
def alert_dedup(spark: SparkSession, d: str) -> DataFrame:
    return streams.alert_dedup(read(spark, d, "events"), ["user_id", "event_type"], "ts").select("event_id", "sent")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    by = read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("select start, count(*) as n from (select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as start from events) group by 1")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query(
    """with g as (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 6 hours then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, session"""
)
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("select l.event_id, r.event_id as previous from events l asof left join (select user_id, ts, event_id from events where event_type = 'click') r on l.user_id = r.user_id and l.ts > r.ts where l.event_type = 'purchase'")
def asof_previous(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    return e.withColumn("previous", F.last(click, ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "previous")


@query("select event_type, count(*) as n, sum((json_extract(props, '$.k')::bigint)) ::bigint as k, substr(sha256(event_type || ':' || count(*)), 1, 16) as checksum from events group by 1")
def json_checksum(spark: SparkSession, d: str) -> DataFrame:
    by = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("k"))
    from ..sources.feeds import checksum

    return by.withColumn("checksum", checksum(F.col("event_type"), F.col("n")))
