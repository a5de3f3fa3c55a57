"""Helpers the training-data operators share: reading tables, cutting lineage, held-out rows."""

from __future__ import annotations

import atexit
import ctypes
import gc
import operator
import shutil
import sys
import tempfile
import uuid
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    found = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"file://{found}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's; a temporary one only on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dir()
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, at most: a row is a whole document.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session have at most ARROW_ROWS rows, as a batch of documents is held by the JVM and by Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def give_back() -> None:
    """At the end of a task: what it freed goes back to the system, as Python workers live on for tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def held_out(doc_id: Column | str) -> Column:
    """Rows whose crc32 of the id's text leaves 2 when divided by 4; a null id counts as not held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_order(*cols: str) -> Column:
    """A fixed pseudo-random order of rows, from 0 to 2**32 - 1."""
    return F.xxhash64(F.lit(20240229), *[F.col(c) for c in cols]).bitwiseAND(F.lit(0xFFFFFFFF))


#: Rows and bytes up to which few() has a table broadcast.
FEW, FEW_BYTES = 500_000, 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""

    def size(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            flat = 8 * (len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1) + 8
            if isinstance(kind.elementType, (T.StringType, T.BinaryType)):
                return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0)) + 16
            return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * flat + 16
        if isinstance(kind, T.StructType):
            return reduce(operator.add, [size(c[f.name], f.dataType) for f in kind.fields], F.lit(16))
        return F.lit(8)

    return reduce(operator.add, [size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16)).cast("long")


def few(df: DataFrame, most: int = FEW, most_bytes: int = FEW_BYTES) -> DataFrame:
    """df, to be broadcast if it has at most so many rows and bytes; beyond either the join shuffles."""
    got = df.select(row_bytes(df).alias("b")).limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got.n <= most and got.b <= most_bytes else df
