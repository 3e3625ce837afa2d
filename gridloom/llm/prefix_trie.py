r"""The prefix trie of conversations by smallest-member ownership, with DataFrame functions only but for SHA-256.

A node is a distinct sequence of first turns; its members are the conversations that start with it.  The smallest member
owns the node, and then every node further down its path that it is in, so each conversation owns a suffix of its own
path: one number, the depth of its topmost owned node, says which.  Windows along each path give running sums of words
and mark where the owned suffix begins; then one group-by over prefixes sums, member by member, the words below the node
minus the words of owned nodes below it (each node is owned once, so what is left is every repeat), the owned nodes one
deeper (children) and the flags of owned leaves.

A prefix is known by its depth and 128 bits: sums of hashes of its numbered turns.  Sums over a path are taken range by range, so
a conversation with any share of the rows is many tasks; of ranges, only those that begin inside a conversation are sent
to all tasks, one row a range at most.  The owner of a prefix is found by a group-by and comes back by conv_id, so the
root and other prefixes that everybody shares are never one task.  Digests of member lists are taken over pieces of at
most PIECE ids in order, one task a list, since SHA-256 reads its input from first to last.

Edge cases: null role or text is empty; rows with a null conv_id are in no conversation; turns with equal numbers are
ordered by role, then text, null numbers first; repeated rows are repeated turns; texts of any length are hashed where
they are read and ordered once; an empty table gives an empty result; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, text_or_empty, written
from .mixing import word_count

#: Conversations are dealt into groups of so many ids; each may begin with turns of the first of its group.
GROUP = 20
#: At most so many turns, less one, are taken over.
HEADS = 4
#: Member ids that are joined into one text before they are hashed.
PIECE = 512
#: Characters of a role or text that ranges are told apart by; the driver sees no more of them.
RANGE_CHARS = 40


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position (from 1), t1 and t2 (hashes of role and text), words, and the range that the row was ordered in."""
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text")).where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first()]
    rows = rows.repartitionByRange(*order, F.substring("role", 1, RANGE_CHARS), F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(*order, "role", "text")
    hashes = (F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2))
    rows = written(rows.select("conv_id", F.monotonically_increasing_id().alias("at"), *hashes, word_count(F.col("text")).alias("words")), "turns")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    sizes = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("at")) + F.coalesce("n_before", F.lit(0))
    return _carried(rows, _before(sizes, "n")).select("conv_id", place.alias("position"), "t1", "t2", "words", "range")


def _before(pieces: DataFrame, *sums: str) -> DataFrame:
    """Sums over a conversation's earlier ranges, for ranges that begin inside a conversation: one row a range at most."""
    w = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("range"))
    return pieces.select("conv_id", "range", first.alias("first"), *(F.sum(s).over(w).alias(f"{s}_before") for s in sums)).where("first > 1").drop("first")


def _carried(rows: DataFrame, before: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(before), ["conv_id", "range"], "left")


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over: the unsigned CRC-32 of its decimal id, modulo HEADS."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


_SUMS = ("s1", "s2", "s3", "s4")


def _key(names: tuple[Column, ...]) -> tuple[Column, Column]:
    return F.xxhash64(*names), F.xxhash64(*reversed(names))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key (a, b), key of the parent (pa, pb), words, words up to here, and length: a row for each rebuilt prefix.

    turns: as ``numbered`` gives it, stored.  A conversation is rebuilt from the first turns of its group's first one and
    its own turns after as many.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("position").alias("n"), F.min("range").alias("range"), F.max("range").alias("last"))
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("position") < HEADS))
    first = first.groupBy(F.col("conv_id").alias("host")).agg(F.array_sort(F.collect_list(F.struct("position", "t1", "t2", "words"))).alias("first"))  # under HEADS rows
    sizes = sizes.withColumn("host", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", head_turns(F.col("conv_id")))
    head = F.when(F.col("first").isNull() | (F.col("h") == 0), F.array().cast("array<struct<position:int,t1:long,t2:long,words:long>>")).otherwise(F.slice("first", 1, F.greatest("h", F.lit(1))))
    info = sizes.join(first, "host", "left").withColumn("head", head).withColumn("k", F.size("head"))
    info = written(info.select("conv_id", "h", "k", "head", "range", (F.col("last") > F.col("range")).alias("spread"), (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")

    def rebuilt(of: DataFrame, side: DataFrame) -> DataFrame:
        own = turns.join(side.select("conv_id", "h", "k", "length"), "conv_id").where("position > h").select("conv_id", "range", (F.col("position") - F.col("h") + F.col("k")).alias("depth"), "t1", "t2", "words", "length")
        heads = of.select("conv_id", "range", "length", F.inline("head")).withColumnRenamed("position", "depth")
        rows = own.unionByName(heads)
        x, y = F.xxhash64("t1", "t2", "depth"), F.xxhash64("depth", "t2", "t1")
        low, high = (lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda v: F.shiftrightunsigned(v, 32))
        return rows.select("conv_id", "range", "depth", "words", "length", low(x).alias("s1"), high(x).alias("s2"), low(y).alias("s3"), high(y).alias("s4"))

    spread = info.where("spread")  # a conversation in several ranges: fewer than there are ranges
    sums = rebuilt(spread, F.broadcast(spread)).groupBy("conv_id", "range").agg(*(F.sum(s).alias(s) for s in (*_SUMS, "words")))
    w = Window.partitionBy("conv_id", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = _carried(rebuilt(info, info).repartition("conv_id", "range"), _before(sums, *_SUMS, "words"))
    upto = {s: F.sum(s).over(w) + F.coalesce(f"{s}_before", F.lit(0)) for s in (*_SUMS, "words")}
    rows = rows.select("conv_id", "depth", "length", "words", upto["words"].alias("upto"), *_SUMS, *(upto[s].alias(f"{s}_upto") for s in _SUMS))
    a, b = _key(tuple(F.col(f"{s}_upto") for s in _SUMS))
    pa_, pb = (F.when(F.col("depth") == 1, F.lit(0).cast("long")).otherwise(x) for x in _key(tuple(F.col(f"{s}_upto") - F.col(s) for s in _SUMS)))
    rows = rows.select("conv_id", "depth", a.alias("a"), b.alias("b"), pa_.alias("pa"), pb.alias("pb"), "words", "upto", "length")
    zero = F.lit(0).cast("long")
    roots = info.select("conv_id", F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), zero.alias("words"), zero.alias("upto"), "length")
    return roots.union(rows)


def member_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b and SHA-256 of the ascending, comma-joined conv_ids of each key's rows."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for depth, a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (depth, a, b) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (depth, a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield made(out)
            out = []
        if now is not None:
            yield made([(*now, state.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "a", "b", "ends_sha256"])

    key = ["depth", "a", "b"]
    dealt = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").withColumn("part", F.spark_partition_id())
    lists = dealt.groupBy(*key, "part").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))  # the ids of one range at most
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(PIECE))
    pieces = lists.withColumn("start", F.explode(starts)).withColumn("ids", F.slice("ids", F.col("start"), F.lit(PIECE)))
    pieces = pieces.select(*key, F.element_at("ids", 1).alias("least"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return pieces.repartition(*key).sortWithinPartitions(*key, "least").mapInArrow(digests, "depth int, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its key (a, b)."""
    turns = written(numbered(conversations, conv_id, turn, role, text), "numbered")
    rows = written(paths(turns), "paths")
    discard(turns)
    key = ["depth", "a", "b"]
    before = (F.col("upto") - F.col("words")).alias("before")
    nodes = rows.groupBy(*key).agg(F.min(F.struct("conv_id", before, "pa", "pb")).alias("own"), F.max("length").alias("longest"))
    nodes = written(nodes.select(*key, "own.*", "longest"), "nodes")
    owners = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before", "pa", "pb")).alias("top"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    owners = written(owners.select("conv_id", F.col("top.depth").alias("own"), F.col("top.before").alias("own_before"), "top.pa", "top.pb", "leaf"), "owners")
    above = nodes.select((F.col("depth") + 1).alias("own"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    above = owners.where("own > 0").join(above, ["own", "pa", "pb"]).select("conv_id", "above")
    ends = rows.where("depth = length").select(*key, "conv_id", F.col("upto").alias("total"))
    marks = ends.select("conv_id", "total").join(owners.drop("pa", "pb"), "conv_id", "left").join(above, "conv_id", "left")
    marks = written(marks.select("conv_id", "own", F.coalesce("own_before", "total").alias("own_before"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "above"), "marks")

    marked = rows.join(marks, "conv_id")
    parent = F.when(F.col("own") < F.col("depth"), F.col("conv_id")).when(F.col("own") == F.col("depth"), F.col("above"))
    child = ((F.coalesce(F.col("own"), F.col("length") + 1) <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))).cast("long")
    saved = F.greatest(F.col("own_before") - F.col("upto") + F.col("words"), F.lit(0).cast("long"))
    out = marked.groupBy(*key).agg(
        F.min(F.struct("conv_id", parent.alias("parent"))).alias("own"), F.count("*").alias("n_convs"), F.sum(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens")
    )
    out = out.join(member_digests(ends), key, "left")
    return out.select(
        "own.conv_id", F.col("depth").cast("long").alias("depth"), F.col("own.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "a", "b",
    )


SQL = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as position
  from conversations where conv_id is not null
), steps as (
  select conv_id, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])) as s from (select distinct conv_id from turns)
), heads as (
  select conv_id, conv_id - conv_id % 20 as host,
         xor(list_reduce(list_prepend(4294967295::bigint, s::bigint[]), lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295) % 4 as h from steps
), taken as (
  select c.conv_id, c.h, coalesce(count(t.position), 0) as k from heads c left join turns t on t.conv_id = c.host and t.position <= c.h group by all
), rebuilt as (
  select c.conv_id, t.position as depth, t.role, t.text from heads c join turns t on t.conv_id = c.host and t.position <= c.h
  union all select t.conv_id, t.position - c.h + c.k, t.role, t.text from turns t join taken c on c.conv_id = t.conv_id where t.position > c.h
), paths as (
  select conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words, string_agg(md5(role) || md5(text), '') over w as k
  from rebuilt window w as (partition by conv_id order by depth)
  union all select conv_id, 0, 0, '' from heads
), lengths as (select conv_id, max(depth) as length from paths group by 1),
nodes as (
  select k, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from paths group by all
), parents as (
  select n.*, p.conv_id as parent_conv_id, left(n.k, 64 * (n.depth::bigint - 1)) as pk from nodes n left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.k = left(n.k, 64 * (n.depth::bigint - 1))
), children as (select pk as k, depth - 1 as depth, count(*) as n_children from parents where depth > 0 group by all),
below as (
  select p.k, p.depth, sum((n.n_convs - 1) * n.words) as saved, sum(case when c.n_children is null then 1 else 0 end) as leaves
  from nodes n join paths p on p.conv_id = n.conv_id and p.depth <= n.depth left join children c on c.k = n.k and c.depth = n.depth group by all
), ends as (
  select k, depth, string_agg(conv_id::varchar, ',' order by conv_id) as ids from paths join lengths using (conv_id) where depth = length group by all
)
select n.conv_id, n.depth::bigint as depth, n.parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from parents n join below using (k, depth) left join children using (k, depth) left join ends using (k, depth)
"""
