"""Cutting lineage: tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local() -> str:
    found = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"file://{found}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's folder; a temporary one on a local master only (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local()
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: computed once, and safe from lost executors. It goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at yet; what is written there goes when the driver's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    system = folder.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return f"{folder.toString()}/rows"
