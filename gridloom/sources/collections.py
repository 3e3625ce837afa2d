"""Feature collections of any size: a file, also of one line only, is read by as many tasks as it has splits.

Spark's text source cuts a file at closing braces instead of line ends.  Whether a split begins inside a string, and how
deep in braces, follows from all splits before it, so the file is read twice: first each split is summed up in one row, as
seen from outside and from inside a string; then it is read with its beginning known.  A feature over the border of splits
comes as pieces that are put together by the split in which it began.  A row is never more than a feature and its commas.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ESCAPED = re.compile(rb"\\.", re.DOTALL)
SPLIT = ["file", "block"]


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """file, block (first byte of its split) and value: what lies between closing braces, in order within a split."""
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batch: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of a batch by split; a split's rows follow one another."""
    turn = (batch["file"].ne(batch["file"].shift()) | batch["block"].ne(batch["block"].shift())).cumsum()
    for _, rows in batch.groupby(turn, sort=False):
        yield (rows["file"].iloc[0], int(rows["block"].iloc[0])), rows


def _joined(rows: pd.DataFrame) -> bytes:
    return "".join(v + "}" for v in rows["value"]).encode()


def _steps(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all braces, +1 or -1 for each, and how many quotes stand before it; the last of these counts all quotes."""
    if b"\\" in data:
        data = ESCAPED.sub(b"__", data)
    codes = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(codes == ord('"'))
    at = np.flatnonzero((codes == ord("{")) | (codes == ord("}")))
    before = np.append(np.searchsorted(quotes, at), len(quotes))
    return at, np.where(codes[at] == ord("{"), 1, -1), before


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a split: quotes (odd or not), and from outside and from inside a string the change of depth and its least value."""
    now, odd, depth, least = None, 0, [0, 0], [0, 0]
    row = lambda: pd.DataFrame([(*now, odd, *depth, *least)], columns=[*SPLIT, "odd", "outer", "inner", "outer_least", "inner_least"])
    for batch in batches:
        for split, rows in _runs(batch):
            if split != now:
                if now is not None:
                    yield row()
                now, odd, depth, least = split, 0, [0, 0], [0, 0]
            _, step, before = _steps(_joined(rows))
            for inside in (0, 1):
                moved = depth[inside] + np.cumsum(step[(before[:-1] + odd + inside) % 2 == 0])
                if len(moved):
                    depth[inside], least[inside] = int(moved[-1]), min(least[inside], int(moved.min()))
            odd = (odd + int(before[-1])) % 2
    if now is not None:
        yield row()


def _beginnings(texts: DataFrame, level: int) -> DataFrame:
    """file, block, inside (a string or not), depth and began: the split in which the feature open at its beginning began."""
    sums = texts.mapInPandas(_summed, "file string, block long, odd int, outer int, inner int, outer_least int, inner_least int")
    # a row a split here, so these windows hold a row for each split of a file
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    pick = lambda name: F.when(F.col("inside") == 1, F.col(f"inner{name}")).otherwise(F.col(f"outer{name}"))
    known = known.select(*SPLIT, "inside", pick("").alias("change"), pick("_least").alias("least"))
    known = known.withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    begins = (F.col("depth") + F.col("least") < level) & (F.col("depth") + F.col("change") >= level)
    return known.withColumn("began", F.last(F.when(begins, F.col("block")), ignorenulls=True).over(earlier)).select(*SPLIT, F.col("inside").cast("int").alias("inside"), F.col("depth").cast("int").alias("depth"), F.coalesce("began", F.lit(-1)).alias("began"))


def _cut(level: int):
    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*SPLIT, "began", "text"])
        return out.assign(began=out["began"].astype("Int64"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """began is NULL for whole objects, else the split in which the object of a piece began."""
        now, inside, depth, since, rest = None, 0, 0, -1, b""
        for batch in batches:
            out: list[tuple] = []
            for split, rows in _runs(batch):
                if split != now:
                    if depth >= level:
                        out.append((*now, since, rest.decode()))
                    now, rest = split, b""
                    inside, depth, since = (int(rows[c].iloc[0]) for c in ("inside", "depth", "began"))
                data = _joined(rows)
                at, step, before = _steps(data)
                outside = (before[:-1] + inside) % 2 == 0
                at, step = at[outside], step[outside]
                deep = depth + np.cumsum(step)
                starts, ends = at[(step > 0) & (deep == level)], at[(step < 0) & (deep == level - 1)]
                carried = depth >= level  # an object is open since an earlier batch or split
                if carried:
                    starts = np.append(0, starts)
                for i, end in enumerate(ends[: len(starts)]):
                    text = data[starts[i] : end + 1]
                    if i == 0 and carried:
                        out.append((*split, None if since == split[1] else since, (rest + text).decode()))
                    else:
                        out.append((*split, None, text.decode()))
                if len(starts) > len(ends):
                    if carried and len(ends) == 0:
                        rest += data
                    else:
                        rest, since = data[starts[-1] :], split[1]
                inside = (inside + int(before[-1])) % 2
                depth = int(deep[-1]) if len(deep) else depth
            yield frame(out)
        if depth >= level:
            yield frame([(*now, since, rest.decode())])

    return cut


def objects(spark: SparkSession, path: str, level: int = 2) -> DataFrame:
    """file and text of every JSON object that lies ``level`` braces deep: 2 in a collection, 1 where documents follow one another.

    Braces and quotes inside strings, escaped ones too, do not count.  An object that the file's end cuts off comes as far as
    it goes, and a brace.  Empty files have none.
    """
    texts = _texts(spark, path)
    # bounded: one row of five numbers for each split of the input
    placed = texts.join(F.broadcast(_beginnings(texts, level)), SPLIT)
    cut = placed.select(*SPLIT, "inside", "depth", "began", "value").mapInPandas(_cut(level), "file string, block long, began long, text string")
    whole = cut.where("began is null").select("file", "text")
    pieces = cut.where("began is not null").groupBy("file", "began").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    return whole.unionByName(pieces.select("file", F.array_join("p.text", "").alias("text")))


def features(spark: SparkSession, path: str, fields: str, geometry: str = "type string, coordinates string") -> DataFrame:
    """file, properties, geometry and good of each feature of collections; other objects, such as a reference system, are left out.

    A feature is good where it is read in full and has a geometry.  Coordinates come as text unless ``geometry`` says more.
    """
    kind = f"type string, properties struct<{fields}>, geometry struct<{geometry}>, _corrupt_record string"
    read = objects(spark, path).select("file", "text", F.from_json("text", kind, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("f"))
    is_feature: Column = F.coalesce(F.col("f.type") == "Feature", F.lit(False)) | F.col("f._corrupt_record").isNotNull()
    good = F.col("f._corrupt_record").isNull() & F.coalesce(F.col("f.geometry.coordinates").isNotNull(), F.lit(False))
    return read.where(is_feature).select("file", F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"), good.alias("good"))


def status(read: DataFrame) -> DataFrame:
    """file, features and bad ones of each file of ``features``."""
    return read.groupBy("file").agg(F.count("*").alias("features"), F.count_if(~F.col("good")).alias("bad"))
