"""Human preferences: targets, both orderings, soft labels, hash split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ["agent_a", "agent_a_slightly", "tie", "agent_b_slightly", "agent_b", "unsure"]


def preference_counts(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(F.col("preference") == c).alias(c) for c in CLASSES])


def with_target(counts: DataFrame) -> DataFrame:
    """target_score in -2..2, raw vote sum, vote_count, and the rounded margin (halves away from zero); unsure votes don't count."""
    raw = (2.0 * F.col("agent_b") + F.col("agent_b_slightly")) - (2.0 * F.col("agent_a") + F.col("agent_a_slightly"))
    n = F.col("agent_a") + F.col("agent_a_slightly") + F.col("agent_b") + F.col("agent_b_slightly") + F.col("tie")
    target = F.when(n > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), raw / n))).otherwise(F.lit(0.0)) + F.lit(0.0)
    return counts.withColumn("raw", raw + F.lit(0.0)).withColumn("vote_count", n).withColumn("target_score", target).withColumn("target_signed_margin", F.round("target_score").cast("int"))


def soft_label(flag: str) -> Column:
    """Mean of the labels that are there; null without one."""
    return F.avg(F.col(flag).cast("int"))


def both_orderings(df: DataFrame) -> DataFrame:
    """Each row as it is (ab) and with responses swapped (ba): targets negated, leak labels exchanged; a zero target prefers slot 1."""
    side = lambda name, sign, one, two: F.struct(
        F.lit(name).alias("ordering"), (sign * F.col("target_score") + F.lit(0.0)).alias("target_score"), (sign * F.col("target_signed_margin")).cast("int").alias("target_signed_margin"),
        (sign * F.col("raw") + F.lit(0.0)).alias("raw_margin"), F.col(one).alias("gold_leak_response1"), F.col(two).alias("gold_leak_response2"),
    )
    out = df.select("id", "vote_count", F.explode(F.array(side("ab", 1, "gold_leak_a", "gold_leak_b"), side("ba", -1, "gold_leak_b", "gold_leak_a"))).alias("s")).select("id", "vote_count", "s.*")
    return out.withColumn("preferred_slot", F.when(F.col("target_score") > 0, 2).otherwise(1))


def bucket(value: Column, buckets: int = 20) -> Column:
    """Bucket of an id by the first 32 bits of the sha256 of its text; a null id hashes the text None."""
    text = F.coalesce(value.cast("string"), F.lit("None"))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def belongs_to(value: Column, split: str) -> Column:
    """Buckets 0 and 1 of 20 are validation, the rest train; test takes all."""
    held = bucket(value).isin(0, 1)
    return {"validation": held, "train": ~held}.get(split, F.lit(True))


def histogram(df: DataFrame, value: str, bins: list[int]) -> DataFrame:
    """bin, n of fixed bins, with zeros."""
    bins_df = df.sparkSession.createDataFrame([(b,) for b in bins], "bin int")
    return bins_df.join(df.groupBy(F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
