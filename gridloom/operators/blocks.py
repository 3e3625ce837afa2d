"""Cut nodes by joins alone: a spanning forest, its Euler tour, subtree ranges, and components of an auxiliary graph.

The forest is grown by Boruvka's rounds; arcs of its Euler tour are ranked by pointer jumping, which gives every node its
parent, its place in preorder and the size of its subtree.  What a subtree is adjacent to is the least and greatest place
over a range of preorder: values are kept for dyadic stretches, and a range is a few of these.  Tree edges that lie on a
common cycle are linked as in the parallel algorithm of Tarjan and Vishkin, and the components are the blocks.  A node of
two blocks or more is a cut node.  Every round is stored; rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import ordered_total
from ..storage import discard, stored
from .graph import components


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Of distinct undirected edges (u < v) those of a spanning forest: in every round each tree takes its first edge out."""
    open_ = stored(edges.select("u", "v", F.col("u").alias("a"), F.col("v").alias("b")), "open")
    forest = None
    while not open_.isEmpty():
        ways = open_.select("u", "v", "a", "b").union(open_.select("u", "v", F.col("b"), F.col("a")))
        first = stored(ways.groupBy("a").agg(F.min(F.struct("u", "v", "b")).alias("m")).select("m.u", "m.v", "a", "m.b"), "first")
        chosen = first.select("u", "v").distinct()
        forest = chosen if forest is None else forest.union(chosen)
        label = stored(components(first.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "labels")
        to = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        left = open_.join(to("a"), "a").join(to("b"), "b").where("_a <> _b").select("u", "v", F.col("_a").alias("a"), F.col("_b").alias("b"))
        left = stored(left, "open")
        discard(open_)
        open_ = left
    return forest if forest is not None else edges.limit(0)


def preorder(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """node, parent (NULL for a root), pre (place in preorder, from 1) and size (of the subtree) of a forest's nodes.

    roots: node, component, of every node; a tree's root is its component.
    """
    arcs = forest.select(F.col("u").alias("a"), F.col("v").alias("b")).union(forest.select("v", "u"))
    around = Window.partitionBy("a").orderBy("b")
    lists = arcs.withColumn("after", F.lead("b").over(around)).withColumn("first", F.min("b").over(Window.partitionBy("a")))
    # after (x -> y) the tour leaves y by the arc that follows (y -> x) around y
    follow = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), F.coalesce("after", "first").alias("to"), F.col("after").isNull().alias("around"))
    ends = roots.where("node = component").select(F.col("node").alias("b"), F.lit(True).alias("top"))
    tour = follow.join(ends, "b", "left").select("a", "b", F.when(F.col("top") & F.col("around"), None).otherwise(F.col("to")).alias("to"))
    at = stored(tour.select("a", "b", F.when(F.col("to").isNotNull(), F.struct(F.col("b").alias("a"), F.col("to").alias("b"))).alias("next"), F.lit(1).cast("long").alias("left")), "tour")
    while not at.where("next is not null").isEmpty():
        ahead = at.select(F.struct("a", "b").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        jumped = stored(at.join(ahead, "next", "left").select("a", "b", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), "tour")
        discard(at)
        at = jumped
    # left: arcs from here to the end of the tour; the way down comes first
    back = at.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("left").alias("_back"))
    both = at.join(back, ["a", "b"]).where(F.col("left") > F.col("_back")).select(F.col("b").alias("node"), F.col("a").alias("parent"), F.col("left"), ((F.col("left") - F.col("_back") + 1) / 2).cast("long").alias("size"))
    sizes = roots.groupBy("component").agg(F.count("*").alias("size"))
    tops = sizes.select(F.col("component").alias("node"), F.lit(None).cast("long").alias("parent"), (2 * F.col("size")).alias("left"), "size")
    rows = both.select("node", "parent", "left", "size").union(tops).join(roots, "node")
    return stored(ordered_total(rows, [], [F.col("component"), F.col("left").desc()], F.lit(1).cast("long"), "pre").select("node", "parent", "pre", "size"), "preorder")


def _over_ranges(values: DataFrame, ranges: DataFrame, depth: int) -> DataFrame:
    """node, low and high: the least low and greatest high of values (pre, low, high) within each range (node, a, z)."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    blocks = values.select("low", "high", "pre", levels).groupBy("level", F.expr("shiftright(pre, level)").alias("block")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    part = "array<struct<level:int,block:bigint>>"
    start = F.struct(F.col("a").alias("a"), F.col("z").alias("z"), F.array().cast(part).alias("parts"))

    def step(s, level):
        one = lambda when, n: F.when(when, F.array(F.struct(level.cast("int").alias("level"), n.alias("block")))).otherwise(F.array().cast(part))
        odd, even, some = s["a"] % 2 == 1, s["z"] % 2 == 0, s["a"] <= s["z"]
        parts = F.concat(s["parts"], one(some & odd, s["a"]), one(some & even & ((s["z"] > s["a"]) | ~odd), s["z"]))
        return F.struct(F.shiftright(s["a"] + F.when(odd, 1).otherwise(0), 1).alias("a"), F.shiftright(s["z"] - F.when(even, 1).otherwise(0), 1).alias("z"), parts.alias("parts"))

    asked = ranges.select("node", F.inline(F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step)["parts"]))
    return asked.join(blocks, ["level", "block"]).groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def blocks(edges: DataFrame) -> DataFrame:
    """node, parent and block of every tree edge (by its lower node) of undirected edges (src, dst); loops do not count."""
    simple = stored(edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("u"), F.greatest("src", "dst").cast("long").alias("v")).distinct(), "simple")
    of = stored(components(simple.select(F.col("u").alias("src"), F.col("v").alias("dst"))), "components")
    forest = stored(spanning_forest(simple), "forest")
    placed = preorder(forest, of)
    n = placed.count()
    if not n:
        return placed.select("node", "parent", F.col("node").alias("block"))
    place = lambda c: placed.select(F.col("node").alias(c), F.col("pre").alias(f"{c}_pre"), F.col("size").alias(f"{c}_size"))
    rest = stored(simple.join(forest, ["u", "v"], "left_anti").join(place("u"), "u").join(place("v"), "v"), "others")
    near = rest.select(F.col("u_pre").alias("pre"), F.col("v_pre").alias("other")).union(rest.select("v_pre", "u_pre"))
    near = near.groupBy("pre").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    spans = placed.select("node", F.col("pre").alias("a"), (F.col("pre") + F.col("size") - 1).alias("z"))
    reach = stored(_over_ranges(near, spans, n.bit_length()), "reach")
    above = placed.select(F.col("node").alias("parent"), F.col("pre").alias("p_pre"), F.col("size").alias("p_size"), F.col("parent").alias("p_parent"))
    up = placed.join(above, "parent").join(reach, "node").where("p_parent is not null and (low < p_pre or high >= p_pre + p_size)")
    links = up.select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    # edges between subtrees that do not hold each other put both their tree edges on a cycle
    apart = rest.where("u_pre + u_size <= v_pre or v_pre + v_size <= u_pre").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    joined = components(stored(links.union(apart).distinct(), "cycles"))
    return placed.where("parent is not null").join(joined, "node", "left").select("node", "parent", F.coalesce("component", "node").alias("block"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """Nodes whose removal splits their component: those of two blocks or more."""
    of = blocks(edges)
    ends = of.select("node", "block").union(of.select("parent", "block")).distinct()
    return ends.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
