"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source queues its documents in a shuffled order (by md5 of doc_id, or of the text's md5), as often as ``max_repeats`` times.  A queued
document's virtual finish time is its source's cumulative size up to it, divided by the source's target.  The mix is
all queued documents in order of finish time, cut off where their sizes reach the budget (the size of the input).

Cumulative sizes come from sums over ranges of the shuffle order plus a window inside each range, so no source and no
doc_id, however many rows it has, is one task.  The cut needs a histogram of finish times and the order of one of its ranges.

Edge cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 are never
taken; a source without words has target 0; repeated rows count one by one; a text of any length is counted where it is;
an empty table gives an empty result; only doc_id, text and source are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Rows aimed at in a range of the shuffle order, and ranges of finish time for each unit of it.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 5_000, 64, 65_536
#: Partitions that ranges of the shuffle order are dealt into at most.
MOST_PARTS = 10_000
#: A table of sources up to this many rows is broadcast (each under 200 bytes beside its name).
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> source_no, budget and target, a row per source.

    Sorted by cap / weight, sources up to some place stop at their caps and the others share what is left by weight;
    what a unit of weight then gets is the largest of the shares computed at each place.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "source_no")
    everything = Window.partitionBy()
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    return (
        sizes.withColumn("source_no", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(pattern, ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_on", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("share", F.max((F.col("budget") - F.col("caps_before")) / F.col("weights_on")).over(everything))
        .select("source", "source_no", "source_size", "budget", F.least("cap", F.col("weight") * F.col("share")).alias("target"))
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    return mixed(docs, weights, max_repeats, doc_id, text, source)[0].select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of ``mix_sources`` with the columns ``keep``, and the table of sources."""
    sized = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text_or_empty(text)).alias("size"),
            F.when(F.col(doc_id).isNull(), F.md5(text_or_empty(text))).alias("unnamed"),
            *(F.col(c).alias(f"kept_{c}") for c in keep),
        ),
        "sized",
    )
    n = sized.count()
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("unnamed")))  # rows without an id are shuffled by their text
    sized = sized.withColumn("key", key).drop("unnamed")

    sources = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "sources")
    few = sources.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    numbered = sized.join(small(sources), same(sized, sources), "inner").drop(sources["source"])
    # ranges of the whole order, so rows that share a key are several ranges too
    parts = max(1, min(math.ceil(n / RANGE_ROWS), MOST_PARTS))
    numbered = written(numbered.repartitionByRange(parts, "source_no", "key", "doc_id", "size", "row").withColumn("range", F.spark_partition_id()), "numbered")
    before = Window.partitionBy("source_no").orderBy("range")
    offsets = numbered.groupBy("source_no", "range").agg(F.sum("size").alias("range_size")).select("source_no", "range", (F.sum("range_size").over(before) - F.col("range_size")).alias("offset"))
    inside = Window.partitionBy("source_no", "range").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = numbered.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["source_no", "range"]).withColumn("cumulative", F.col("offset") + F.col("inside"))
    queued = written(queued.drop("offset", "inside", "range"), "queued")

    def finish(repeat: Column) -> Column:
        return (repeat * F.col("source_size") + F.col("cumulative")).cast("double") / F.col("target")

    rows = queued.where("size > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("finish", finish(F.col("repeat")))
    per_unit = min(MOST_RANGES, max(LEAST_RANGES, math.ceil(max_repeats * n / RANGE_ROWS)))
    rows = rows.withColumn("slot", F.least(F.floor(F.col("finish") * per_unit), F.lit(3 * per_unit)).cast("long"))
    # at most 3 * MOST_RANGES + 1 rows
    slots = rows.groupBy("slot").agg(F.sum("size").alias("slot_size"), F.first("budget").alias("slot_budget"))
    slots = slots.withColumn("slot_before", F.sum("slot_size").over(Window.orderBy("slot")) - F.col("slot_size"))
    full = slots.where("slot_before <= slot_budget").orderBy(F.col("slot").desc()).limit(1)
    order = ["finish", "source_no", "repeat", "key", "row"]
    within = Window.partitionBy("slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    crossing = rows.join(F.broadcast(full), "slot").withColumn("reached", F.col("slot_before") + F.sum("size").over(within))
    place = crossing.agg(F.max("slot").alias("slot"), F.max(F.when(F.col("reached") <= F.col("budget"), F.struct(*order))).alias("last")).first()  # one row

    def chosen(e: int) -> Column:
        if place.slot is None:
            return F.lit(False)
        at = finish(F.lit(e))
        before = F.least(F.floor(at * per_unit), F.lit(3 * per_unit)) < place.slot
        if place.last is None:
            return before
        mine = F.struct(at.alias("finish"), F.col("source_no"), F.lit(e).alias("repeat"), F.col("key"), F.col("row"))
        return before | (mine <= F.struct(*(F.lit(place.last[c]).alias(c) for c in order)))

    taken = sum((F.when(chosen(e), F.col("size")).otherwise(F.lit(0)) for e in range(max_repeats)), F.lit(0))
    out = queued.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", *(F.col(f"kept_{c}").alias(c) for c in keep)), sources


SQL = r"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))) as key,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), named as (
  select *, row_number() over (order by source nulls last) as source_no from totals
), weighed as (
  select *, case (source_no - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         (source_size * 3)::double as cap, (sum(source_size) over ())::bigint as budget
  from named
), placed as (
  select *, coalesce(sum(cap) over (order by cap / weight, source_no rows between unbounded preceding and 1 preceding), 0) as caps_before,
         sum(weight) over (order by cap / weight, source_no rows between current row and unbounded following) as weights_on
  from weighed
), targets as (
  select *, least(cap, weight * max((budget - caps_before) / weights_on) over ()) as target from placed
), queued as (
  select s.doc_id, s.size, s.key, t.source_no, t.source_size, t.target, t.budget,
         sum(s.size) over (partition by t.source_no order by s.key, s.doc_id, s.size rows between unbounded preceding and current row) as cumulative
  from sized s join targets t on s.source is not distinct from t.source
), repeats as (
  select *, (e.repeat * source_size + cumulative)::double / target as finish
  from queued, (select unnest([0, 1, 2]) as repeat) e where size > 0
), ordered as (
  select *, sum(size) over (order by finish, source_no, repeat, key rows between unbounded preceding and current row) as reached from repeats
), kept as (
  select doc_id, cast(sum(size) as bigint) as taken from ordered where reached <= budget group by doc_id
)
select q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) as taken
from queued q left join kept k on k.doc_id = q.doc_id
"""
