"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where it is unset, a folder of our own."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="genoloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the folder that nothing else uses; what is there goes when the driver exits."""
    path = f"{folder(spark)}/genoloom-{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_forget)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _forget() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _MADE.get(spark.sparkContext.applicationId, []):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: its lineage is cut, its size known, and lost executors lose nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
