"""Append-only result ledgers: latest rows, attempts, pending work, summaries, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The last row of each key in file order, not by time."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("m")).select(*keys, "m.*").select(*df.columns)


def attempts(df: DataFrame, keys: list[str], pos: str = "pos") -> Column:
    """Number of the attempt that each row is, among rows of its key in file order."""
    return F.count("*").over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))


def should_run(cases: DataFrame, ledger: DataFrame, keys: list[str], retry_errors: bool, max_attempts: int, retryable: list[str]) -> DataFrame:
    """cases with n_attempts, latest_status and should_run: without a row yes; latest ok no; else while retries are left."""
    state = ledger.groupBy(*keys).agg(F.count("*").alias("n_attempts"), F.max_by("status", "pos").alias("latest_status"))
    out = cases.join(state, keys, "left")
    again = F.lit(retry_errors) & F.col("latest_status").isin(retryable) & (F.col("n_attempts") < max_attempts)
    run = F.when(F.col("n_attempts").isNull(), True).when(F.col("latest_status") == "ok", False).otherwise(again)
    return out.withColumn("should_run", run).withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))


def status_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def judgment_summary(df: DataFrame) -> DataFrame:
    """Per judge: rows, ok rows, and true and false leak and omit labels of ok rows."""
    ok = F.col("status") == "ok"
    flags = [F.count_if(ok & (F.col(c) == v)).alias(f"{c}_{str(v).lower()}") for c in ("leaks", "omits") for v in (True, False)]
    return df.groupBy("judge").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), *flags)


def pointwise_rates(df: DataFrame, failed: Column, leaks: Column, omits: Column, by: list[str]) -> DataFrame:
    """valid, invalid and leak, omit and clean rates: rows that failed count as valid, leaking and omitting; unparsed rows as invalid."""
    flat = df.withColumn("__f", F.coalesce(failed, F.lit(False))).withColumn("__l", leaks).withColumn("__o", omits)
    parsed = F.col("__l").isNotNull() & F.col("__o").isNotNull()
    valid = F.col("__f") | parsed
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count_if(valid)), F.lit(0.0)), 6)
    return flat.groupBy(*by).agg(
        F.count("*").alias("num_examples"), F.count_if(valid).alias("valid_judgments"), F.count_if(~valid).alias("invalid_judgments"),
        rate(F.col("__f") | (parsed & F.col("__l"))).alias("leak_rate"), rate(F.col("__f") | (parsed & F.col("__o"))).alias("omit_rate"),
        rate(~F.col("__f") & parsed & ~F.col("__l") & ~F.col("__o")).alias("clean_rate"),
    )


def route(results: DataFrame, samples: DataFrame, metadata: DataFrame, done: DataFrame) -> DataFrame:
    """results (sample, status) with a route: no metadata, judged already, response not ok, sample missing, or pending."""
    out = results.join(metadata.select("sample", F.lit(True).alias("__m")).distinct(), "sample", "left")
    out = out.join(done.select("sample", F.lit(True).alias("__d")).distinct(), "sample", "left").join(samples.select("sample", F.lit(True).alias("__s")).distinct(), "sample", "left")
    to = F.when(F.col("__m").isNull(), "missing_metadata").when(F.col("__d"), "already_judged").when(F.coalesce("status", F.lit("")) != "ok", "skipped_responding_not_ok").when(F.col("__s").isNull(), "missing_sample").otherwise("pending")
    return out.withColumn("route", to).drop("__m", "__d", "__s")
