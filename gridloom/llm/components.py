"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written_with


def _marked(links: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """Links stored, and what tells them from another round's; the writing job gathers it."""
    return written_with(links, name, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hangs the neighbours of every node on the least of them; small looks at lesser neighbours, large at greater.

    Least neighbours are counted before rows move; a node with very many neighbours is a skewed key of a plain join.
    """
    both = edges if small else edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    else:
        out = joined.where("b > a").select(F.col("b").alias("x"), "m")
    return out.where("x <> m").distinct().select(F.col("x").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node), a row for each node that has a link.  Nodes may be of any type with an order."""
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges, mark = _marked(edges, "links")
    before = None
    while mark["n"] and mark != before:
        old, before = edges, mark
        edges, mark = _marked(_star(_star(old, small=False), small=True), "stars")
        discard(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
