"""Category contributions, frequency reports, caps, shares, novelty: all long-form aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contributions(value: Column) -> Column:
    """Each distinct element of a list column counts once; an empty or null list is "unknown"."""
    distinct = F.array_distinct(F.filter(value, lambda x: x.isNotNull() & (x != "")))
    return F.when(F.coalesce(F.size(distinct), F.lit(0)) > 0, distinct).otherwise(F.array(F.lit("unknown")))


def scalar_contribution(value: Column) -> Column:
    """A scalar counts once, trimmed and lower-cased; blank or null is "unknown"."""
    plain = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.array(F.when(plain == "", "unknown").otherwise(plain))


def pairs_of(values: Column) -> Column:
    """All pairs of a sorted list, joined with |."""
    return F.flatten(F.transform(values, lambda x, i: F.transform(F.slice(values, i + 2, F.size(values)), lambda y: F.concat(x, F.lit("|"), y))))


def signature(values: Column) -> Column:
    """Sorted elements joined with |; "unknown" for none."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(F.array_sort(values), "|")).otherwise("unknown")


def long_counts(df: DataFrame, dims: dict[str, Column], pos: str) -> DataFrame:
    """dim, value, n, first_pos of every category of every dimension in one pass: one explode, one aggregate."""
    entries = [F.transform(values, lambda v, d=dim: v) for dim, values in dims.items()]
    structs = F.array(*[F.struct(F.lit(d).alias("dim"), e.alias("values")) for d, e in zip(dims, entries, strict=True)])
    flat = df.select(F.col(pos).alias("pos"), F.explode(structs).alias("s")).select("pos", F.col("s.dim").alias("dim"), F.explode("s.values").alias("value"))
    return flat.groupBy("dim", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def top_with_others(counts: DataFrame, k: int, total: int) -> DataFrame:
    """dim, rank, value, n, pct: the k most frequent values of each dimension, ties by first position, and "(others)"."""
    order = Window.partitionBy("dim").orderBy(F.desc("n"), F.asc("first_pos"))
    ranked = counts.withColumn("rank", F.row_number().over(order))
    bucket = F.when(F.col("rank") <= k, F.col("rank")).otherwise(k + 1)
    label = F.when(F.col("rank") <= k, F.col("value")).otherwise("(others)")
    return ranked.groupBy("dim", bucket.alias("rank"), label.alias("value")).agg(F.sum("n").alias("n")).withColumn("pct", F.round(100 * F.col("n") / F.lit(total), 6))


def cap_of(total: Column, pct: float) -> Column:
    """Most samples of a category: total * pct / 100, cut off, one at least."""
    return F.greatest(F.floor(total * F.lit(pct) / 100), F.lit(1)).cast("long")


def cap_excess(counts: DataFrame, total: int, caps: dict[str, float]) -> DataFrame:
    """dim, cap, excess: what categories of each capped dimension have beyond its cap."""
    rows = counts.where(F.col("dim").isin(list(caps)))
    cap = F.coalesce(*[F.when(F.col("dim") == d, cap_of(F.lit(total), p)) for d, p in caps.items()])
    return rows.withColumn("cap", cap).groupBy("dim", "cap").agg(F.sum(F.greatest(F.col("n") - F.col("cap"), F.lit(0))).alias("excess"))


def min_share_violations(counts: DataFrame, total: int, shares: list[tuple[str, str, float]]) -> DataFrame:
    """dim, value, missing: how many samples a category lacks to its least share, rounded up; only those that lack some."""
    want = counts.sparkSession.createDataFrame(shares, "dim string, value string, pct double")
    joined = want.join(counts, ["dim", "value"], "left").withColumn("missing", (F.ceil(F.lit(total) * F.col("pct") / 100) - F.coalesce("n", F.lit(0))).cast("long"))
    return joined.where("missing > 0").select("dim", "value", "missing")


def enforceable(df: DataFrame, dims: dict[str, Column], caps: dict[str, float]) -> DataFrame:
    """dim, categories, widest, enforceable: a single-valued dimension with categories * cap < 100 can't be met."""
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), v.alias("values")) for d, v in dims.items()])).alias("s")).select("s.dim", "s.values")
    stats = flat.select("dim", F.size("values").alias("width"), F.explode("values").alias("value")).groupBy("dim").agg(F.countDistinct("value").alias("categories"), F.max("width").alias("widest"))
    cap = F.coalesce(*[F.when(F.col("dim") == d, F.lit(p)) for d, p in caps.items()])
    return stats.select("dim", "categories", "widest", ((F.col("widest") > 1) | (F.col("categories") * cap >= 100)).alias("enforceable"))


def novelty(df: DataFrame, id_col: str, dims: dict[str, Column], weights: dict[str, float], fractional: set[str] = frozenset()) -> DataFrame:
    """id, score: the weighted sum over dimensions of 1 / (1 + count / mean count)**2, the mean of it in list dimensions.

    A fractional dimension counts one over the list's length for each element. Unseen values score 1.
    """
    flat = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), v.alias("values")) for d, v in dims.items()])).alias("s"))
    flat = flat.select("id", F.col("s.dim").alias("dim"), F.size("s.values").alias("width"), F.explode("s.values").alias("value"))
    mass = F.when(F.col("dim").isin(list(fractional)), 1.0 / F.col("width")).otherwise(1.0)
    counts = flat.groupBy("dim", "value").agg(F.sum(mass).alias("n"))
    means = counts.groupBy("dim").agg(F.avg("n").alias("mean"))
    scored = counts.join(F.broadcast(means), "dim").select("dim", "value", (1 / F.pow(1 + F.col("n") / F.col("mean"), F.lit(2))).alias("s"))
    weight = F.coalesce(*[F.when(F.col("dim") == d, F.lit(float(w))) for d, w in weights.items()])
    return flat.join(scored, ["dim", "value"]).groupBy("id").agg(F.round(F.sum(F.col("s") * weight / F.col("width")), 6).alias("score"))
