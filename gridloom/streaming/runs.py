"""Tables that streams write to: runs of rows by key bucket, merged by key where they are read.

Every batch appends a run, in the folders of its own keys' buckets only, so what it writes does not grow with the table; a
batch that runs again replaces its own run.  A bucket with over MOST_RUNS runs is merged into one; the runs before are kept
until the bucket is merged again, so readers can finish.  Runs of batches have odd numbers, merged ones the even number
after the last batch that they hold, and only runs whose writing job has ended are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import latest

BUCKETS, MOST_RUNS = 16, 8


def latest_state(path: str, keys: list[str], *order: Column, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps of each key the row of the last batch that had it; of that batch's the first in order."""
    return _sink(path, keys, order or (F.lit(1),), True, buckets)


def history(path: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the row of the first batch that had the key."""
    return _sink(path, keys, (F.lit(1),), False, buckets)


def _sink(path: str, keys: list[str], order: tuple[Column, ...], newest: bool, buckets: int) -> Callable[[DataFrame, int], None]:
    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = latest(batch, keys, *order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/run={2 * number + 1}")
        if number == 0:
            spark.createDataFrame([(keys, newest)], "keys array<string>, newest boolean").coalesce(1).write.mode("overwrite").json(f"{path}/table")
        _merge(spark, path, keys, newest, 2 * number)

    return sink


def _runs(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Ended runs of each bucket, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), {}
    for run in fs.listStatus(hadoop) if fs.exists(hadoop) else []:
        name = run.getPath().getName()
        if name.startswith("run=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(run.getPath(), "_SUCCESS")):
            for part in fs.listStatus(run.getPath()):
                if part.getPath().getName().startswith("bucket="):
                    out.setdefault(int(part.getPath().getName()[7:]), []).append(int(name[4:]))
    return {bucket: sorted(runs) for bucket, runs in out.items()}


def _live(runs: list[int]) -> list[int]:
    """The last merged run and those after it."""
    merged = max((r for r in runs if r % 2 == 0), default=-1)
    return [r for r in runs if r >= merged]


def _read(spark: SparkSession, path: str, parts: list[tuple[int, int]], keys: list[str], newest: bool) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(*(f"{path}/run={r}/bucket={b}" for b, r in parts))
    best = rows.groupBy(*keys).agg((F.max if newest else F.min)("run").alias("run"))
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(best[k])
    return rows.join(best, same & (rows["run"] == best["run"]), "left_semi").drop("run")


def _merge(spark: SparkSession, path: str, keys: list[str], newest: bool, upto: int) -> None:
    """Merges what has become too many runs, up to but without the batch that may still run again."""
    runs = _runs(spark, path)
    full = {b: [r for r in _live(of) if r <= upto] for b, of in runs.items()}
    full = {b: of for b, of in full.items() if len(of) > MOST_RUNS}
    if not full:
        return
    rows = _read(spark, path, [(b, r) for b, of in full.items() for r in of], keys, newest)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/run={upto}")
    for b in full:
        before = max((r for r in runs[b] if r % 2 == 0 and r < upto), default=0)
        for r in runs[b]:
            if r < before:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={r}/bucket={b}")
                folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the table as of its last ended batch."""
    parts = [(b, r) for b, of in _runs(spark, path).items() for r in _live(of)]
    if not parts:
        return None
    table = spark.read.json(f"{path}/table").first()
    return _read(spark, path, parts, list(table.keys), table.newest).drop("bucket")
