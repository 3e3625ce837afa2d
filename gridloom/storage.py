"""Tables in the folder that driver and executors share: results of iterations, computed once and safe from lost executors."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``stored`` once everything made from it is itself stored."""
    path = _paths.pop(df, None)
    if path:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)
