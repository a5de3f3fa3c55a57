"""Append-only ledgers as file streams, windowed counts with late data, counters with rollback."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.order import with_position
from quillspark.sources.store import shared_folder


def run_ledger(spark: SparkSession, source: str, folder: str | None = None) -> DataFrame:
    """Append everything new in source to a ledger and return it. A second run with the same folder takes only what is new.

    The stream's checkpoint remembers finished files, and the Parquet sink commits each batch once, so a restart after a
    crash neither loses nor repeats rows.
    """
    folder = folder or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    static = spark.read.parquet(source)
    *head, name = source.rstrip("/").split("/")
    rows = spark.readStream.schema(static.schema).option("pathGlobFilter", name if name.endswith(".parquet") and not _is_folder(spark, source) else "*.parquet")
    stream = rows.parquet("/".join(head) if not _is_folder(spark, source) else source)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(static.schema).parquet(f"{folder}/rows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling window and type; on a stream, late bounds how long a window's state is kept."""
    df = events.withWatermark("ts", late) if late and events.isStreaming else events
    return df.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def signed_counts(deltas: DataFrame, pos: str = "pos") -> DataFrame:
    """value, n: counters from rows of +w and -w in the order of pos, floored at 0 at every step.

    The last value of a counter that starts at 0 and never goes below is its sum less its least prefix sum (or 0): ranges of
    rows give their sum and least prefix, and ranges are put together in order, so no task gets all rows of a value.
    """
    placed = with_position(deltas.select("value", "delta", pos), [F.col("value"), F.col(pos)], "__place").withColumn("__c", F.floor(F.col("__place") / 4096))
    inner = Window.partitionBy("value", "__c").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.withColumn("__s", F.sum("delta").over(inner)).groupBy("value", "__c").agg(F.sum("delta").alias("total"), F.min("__s").alias("low"))
    state = F.aggregate(
        F.array_sort(F.collect_list(F.struct("__c", "total", "low"))),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("low")),
        lambda a, x: F.struct((a["sum"] + x["total"]).cast("long").alias("sum"), F.least(a["low"], a["sum"] + x["low"]).cast("long").alias("low")),
    )
    return parts.groupBy("value").agg(state.alias("__e")).select("value", (F.col("__e.sum") - F.col("__e.low")).alias("n"))
