"""Rewards, advantages and metrics over sampled responses, and packed or sharded layouts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.order import with_position


def peer_pairs(df: DataFrame, group: str = "prompt", member: str = "generation", extra: list[str] = ()) -> DataFrame:
    """All pairs i < j of a prompt's responses. Prompts have a small, fixed number of responses, so the join stays linear."""
    a = df.select(group, *[F.col(c).alias(f"a_{c}") for c in (member, *extra)])
    b = df.select(F.col(group).alias("__g"), *[F.col(c).alias(f"b_{c}") for c in (member, *extra)])
    return a.join(b, (F.col(group) == F.col("__g")) & (F.col(f"a_{member}") < F.col(f"b_{member}"))).drop("__g")


def peer_scores(df: DataFrame, pairs: DataFrame, score: Column) -> DataFrame:
    """Mean margin of each response over its valid comparisons: a pair's score counts for its second, negated for its first.

    A response without a valid comparison has a null score and is invalid.
    """
    s = pairs.withColumn("s", score).where("s is not null")
    both = s.select("prompt", F.explode(F.array(F.struct(F.col("a_generation").alias("g"), (-F.col("s")).alias("s")), F.struct(F.col("b_generation").alias("g"), F.col("s").alias("s")))).alias("x"))
    sums = both.groupBy("prompt", F.col("x.g").alias("generation")).agg(F.round(F.avg("x.s"), 6).alias("peer_score"), F.count("*").alias("comparisons"))
    out = df.select("prompt", "generation").join(sums, ["prompt", "generation"], "left")
    return out.withColumn("comparisons", F.coalesce("comparisons", F.lit(0))).withColumn("invalid", F.col("peer_score").isNull())


def dual_order(reference_first: Column, candidate_first: Column, require_both: bool = False) -> Column:
    """Candidate's score of two judgments in both orders: the mean of what there is, the second negated."""
    n = reference_first.isNotNull().cast("int") + candidate_first.isNotNull().cast("int")
    mean = (F.coalesce(reference_first, F.lit(0.0)) - F.coalesce(candidate_first, F.lit(0.0))) / n
    return F.when(n >= (2 if require_both else 1), mean + F.lit(0.0))


def advantages(df: DataFrame, low: float, high: float) -> DataFrame:
    """df with clipped and advantage: clipped first, then centred on the mean of the prompt's valid rows; invalid rows get 0."""
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col("score")))
    mean = F.avg(F.when(~F.col("invalid"), F.col("clipped"))).over(Window.partitionBy("prompt"))
    return df.withColumn("clipped", clipped).withColumn("advantage", F.when(F.col("invalid"), 0.0).otherwise(F.round(F.col("clipped") - mean, 6) + F.lit(0.0)))


def require_groups(df: DataFrame) -> DataFrame:
    """df, or an error at run time if a prompt has one response only: its baseline would be its own score."""
    n = F.count("*").over(Window.partitionBy("prompt"))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, True).otherwise(F.raise_error(F.lit("a prompt has fewer than two responses")).cast("boolean"))).drop("__n")


def token_advantages(mask: Column, advantage: Column) -> Column:
    return F.transform(mask, lambda m: F.when(m, advantage).otherwise(0.0))


def length_penalty(words: Column, longest: int, per_word: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(per_word) * F.greatest(F.lit(0), words - longest))


def undershort_penalty(words: Column, reference: Column, ratio: float, most: float, valid: Column) -> Column:
    """Up to most for valid responses shorter than a share of the reference's mean words."""
    floor = ratio * reference
    return F.when(valid & (floor > 0), most * F.least(F.lit(1.0), F.greatest(F.lit(0.0), floor - words) / floor)).otherwise(0.0)


def margin_reward(predicted: Column, target: Column, violation: Column, leak_reward: Column, penalty: Column, c1: float = 1.0, c2: float = 1.0, w: float = 1.0) -> Column:
    """Minus c1 for a format violation, plus c2 times how near the margin is to its target, plus leaks, minus the length penalty."""
    near = F.when(predicted.isNotNull(), 2.0 - F.abs(predicted - target)).otherwise(0.0)
    return -c1 * violation.cast("double") + c2 * near + w * leak_reward - penalty


def margin_metrics(df: DataFrame) -> DataFrame:
    """Metrics of predicted margins against targets. Accuracies divide by all rows of their kind, errors by valid rows only."""
    p, t = F.col("predicted"), F.col("target")
    right = F.when(p.isNull(), False).when(t == 0, p == 0).otherwise((p > 0) == (t > 0))
    share = lambda c, of: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count_if(of)), F.lit(0.0)), 6)
    every = F.lit(True)
    return df.agg(
        F.count("*").alias("n"), F.count_if(p.isNull()).alias("invalid"), share(right, every).alias("pair_accuracy"), share(right & (t != 0), t != 0).alias("non_tie_accuracy"), share(right & (t == 0), t == 0).alias("tie_accuracy"),
        share(F.coalesce(p == F.round(t), F.lit(False)), every).alias("exact_match"), F.round(F.coalesce(F.avg(F.abs(p - t)), F.lit(0.0)), 6).alias("abs_error_mean"), share(p.isNull(), every).alias("invalid_rate"),
    )


def pairwise_metrics(df: DataFrame, score: str, shorter: Column) -> DataFrame:
    """Counts, mean, win, tie and loss rates over valid rows, and the slice where the candidate has fewer words; 0 without a valid row."""
    s = F.col(score)
    rate = lambda c: F.round(F.coalesce(F.avg(F.when(s.isNotNull(), c.cast("int"))), F.lit(0.0)), 6)
    return df.agg(
        F.count("*").alias("num_examples"), F.count(score).alias("valid_judgments"), F.count_if(s.isNull()).alias("invalid_judgments"), F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias("mean_score"),
        rate(s > 0).alias("win_rate"), rate(s == 0).alias("tie_rate"), rate(s < 0).alias("reference_win_rate"), F.count_if(shorter).alias("shorter_count"), F.round(F.coalesce(F.avg(F.when(shorter, s)), F.lit(0.0)), 6).alias("shorter_mean_score"),
    )


def batch_summary(df: DataFrame, by: list[str] = ()) -> DataFrame:
    valid = F.when(~F.col("invalid"), F.col("score"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(valid), 6).alias("masked_mean"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.max("score").alias("max"), F.round(F.avg((F.col("score") != 0).cast("int")), 6).alias("nonzero_rate"), F.count_if("invalid").alias("invalid"))


def usable_groups(df: DataFrame, usable: Column, world: int) -> DataFrame:
    """Rows of prompts with a usable response, of as many prompts, in order, as are a multiple of world."""
    keep = df.groupBy("prompt").agg(F.bool_or(usable).alias("u")).where("u").select("prompt")
    n = keep.count() // world * world
    return df.join(with_position(keep, [F.col("prompt")], "place").where(F.col("place") < n), "prompt")


def offsets(df: DataFrame, size: Column, pos: list[str]) -> DataFrame:
    """df with place, start and stop of each row in one flat array: sums in ranges, then offsets of the ranges before."""
    placed = with_position(df.withColumn("__size", size), [F.col(c) for c in pos], "place")
    chunk = placed.withColumn("__c", F.floor(F.col("place") / 4096))
    inner = F.sum("__size").over(Window.partitionBy("__c").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    before = chunk.groupBy("__c").agg(F.sum("__size").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    out = chunk.withColumn("__in", inner).join(before, "__c")
    return out.withColumn("stop", (F.col("__before") + F.col("__in")).cast("long")).withColumn("start", F.col("stop") - F.col("__size")).drop("__c", "__in", "__before", "__size")


def unpack(flat: Column, start: Column, stop: Column, width: Column) -> Column:
    """A row's slice of a flat array, padded with zeros on the right to width."""
    n = (stop - start).cast("int")
    return F.concat(F.slice(flat, (start + 1).cast("int"), n), F.array_repeat(F.lit(0.0), width - n))


def pad(tokens: Column, width: int, left: bool = False, value: int = 0) -> Column:
    """Tokens cut to width (the last ones on the left side, else the first) and padded there."""
    cut = F.when(F.size(tokens) > width, F.slice(tokens, F.size(tokens) - width + 1, width) if left else F.slice(tokens, 1, width)).otherwise(tokens)
    fill = F.array_repeat(F.lit(value), width - F.size(cut))
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def chunk_of(place: Column, total: int, parts: int) -> Column:
    """Which of parts contiguous chunks of equal size (the last may be shorter) a place is in."""
    return F.floor(place / (-(-total // parts))).cast("int")


def shard_of(place: Column, per_worker: int, prompts: int, sequences: int, group: int) -> tuple[Column, Column]:
    """Worker and micro-batch of a prompt: at most so many prompts and sequences per micro-batch, none across workers."""
    own = place % per_worker
    size = max(1, min(prompts, sequences // group))
    return F.floor(place / per_worker).cast("int"), F.floor(own / size).cast("int")


def surrogate(ratio: Column, advantage: Column, tau_pos: float = 1.0, tau_neg: float = 1.05) -> Column:
    """Soft-gated policy loss of a token: -sigmoid(tau (r - 1)) 4 / tau A, tau by the sign of the advantage."""
    tau = F.when(advantage > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
    return -(1 / (1 + F.exp(-tau * (ratio - 1)))) * 4 / tau * advantage


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def kl(student: Column, teacher: Column) -> Column:
    """Sum of p_s (log p_s - log p_t) over a vocabulary of logits."""
    ls, lt = logsumexp(student), logsumexp(teacher)
    gap = F.aggregate(F.zip_with(student, teacher, lambda s, t: F.exp(s - ls) * (s - t)), F.lit(0.0), lambda a, x: a + x)
    return gap + lt - ls
