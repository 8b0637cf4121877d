"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder; a temporary one only where all runs in one process.

    On a cluster without such a folder there is none that all machines see, so this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="attestry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def made(spark: SparkSession, path: str) -> None:
    """Make a folder, unless it is there."""
    fs, p = _filesystem(spark, path)
    fs.mkdirs(p)


def mark() -> int:
    """A place in the list of intermediate tables, for release."""
    return len(_written)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables written since mark(), once nothing reads them any more."""
    for path in _written[since:]:
        fs, p = _filesystem(spark, path)
        fs.delete(p, True)
    del _written[since:]
