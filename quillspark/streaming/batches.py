"""Staged processing batch by batch: a sample's state is a row, a failure stays with its row, and a batch's output counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.store import cut


def run_stages(batch: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame], Column]]) -> DataFrame:
    """batch with stage (the last one a row came through), status (done or failed) and failed_at.

    stages: (name, what it makes of the rows that still run, whether a row of its result passes). Stages add columns and
    keep rows; a row that doesn't pass takes no part in later ones, and keeps what it had.
    """
    state = batch.withColumns({"stage": F.lit(None).cast("string"), "failed_at": F.lit(None).cast("string")})
    for name, step, passes in stages:
        running, out = state.where("failed_at is null"), state.where("failed_at is not null")
        made = step(running)
        ok = F.coalesce(passes, F.lit(False))
        made = made.withColumn("__ok", ok).withColumn("stage", F.when(F.col("__ok"), F.lit(name)).otherwise(F.col("stage"))).withColumn("failed_at", F.when(~F.col("__ok"), F.lit(name))).drop("__ok")
        state = cut(made.unionByName(out, allowMissingColumns=True), "state")
    return state.withColumn("status", F.when(F.col("failed_at").isNull(), "done").otherwise("failed"))


def generate(spark: SparkSession, source: str, folder: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame], Column]], files: int = 1) -> DataFrame:
    """All files of source through the stages, some files a batch, and the rows of all batches so far.

    A batch's rows go to a folder of its number, written over if the batch runs again, so a restart neither loses nor repeats rows.
    """
    schema = spark.read.parquet(source).schema

    def one(batch: DataFrame, number: int) -> None:
        run_stages(batch, stages).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("mergeSchema", True).parquet(f"{folder}/rows").drop("batch")
