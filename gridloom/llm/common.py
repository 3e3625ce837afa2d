"""Helpers shared by the training-data operators: the shared folder, written tables, sessions' text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (a local session, as in tests) a local folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: computed once, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def written_with(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """The same as ``written``, and aggregates over the rows (by alias) that the writing job itself gathers."""
    seen = Observation()
    back = written(df.observe(seen, *measures), name)
    return back, seen.get


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    back, seen = written_with(df, name, F.count(F.lit(1)).alias("n"))
    return back, seen["n"]


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``written`` once everything made from it is itself written."""
    path = _paths.pop(df, None)
    if path:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


_held: dict[str, Callable[[], None]] = {}
_used: list[str] = []


def holds(name: str, drop: Callable[[], None]) -> None:
    """Says how to drop what an operator keeps in a Python worker between tasks."""
    _held[name] = drop


def using(name: str) -> None:
    """Called where a task begins: a worker that comes from another operator's task drops what that one kept.

    Workers live through all jobs of a session, so without this a chain of operators would add up their caches.
    """
    if _used == [name]:
        return
    for other, drop in _held.items():
        if other != name:
            drop()
    _used[:] = [name]
    gc.collect()
    _trim()


def _trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task for mapInArrow, whose worker keeps nothing that it freed while it waits for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        _trim()

    return run
