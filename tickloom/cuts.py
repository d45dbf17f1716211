"""Cut points: DataFrames written to the shared folder of spark.checkpoint.dir and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder, set once, where it is unset and the master is local."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return sc.getCheckpointDir().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df written as Parquet and read again: what reads it reads these columns only, and the lineage ends there."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cuts(*cuts: DataFrame) -> None:
    for df in cuts:
        drop_path(df.sparkSession, df._cut_path)
