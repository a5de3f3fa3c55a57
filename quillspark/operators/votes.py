"""Votes of several judges: majorities, unanimity, modal outcomes, pair analysis and pair selection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(yes: Column, no: Column, threshold: int) -> Column:
    return F.when(yes >= threshold, True).when(no >= threshold, False)


def vote_stats(votes: DataFrame, keys: list[str], field: str, threshold: int) -> DataFrame:
    """yes_judges, no_judges (sorted), their numbers and the majority; nulls don't vote."""
    yes, no = (F.array_sort(F.collect_set(F.when(F.col(field) == v, F.col("judge")))) for v in (True, False))
    out = votes.groupBy(*keys).agg(yes.alias("yes_judges"), no.alias("no_judges"))
    out = out.withColumn("yes_count", F.size("yes_judges")).withColumn("no_count", F.size("no_judges"))
    return out.withColumn("majority", majority(F.col("yes_count"), F.col("no_count"), threshold))


def refresh_sensibility(stats: DataFrame, final: bool) -> DataFrame:
    """stats with sensibility_passed and error: before the end only approval is known; at the end all else is rejected."""
    m = F.col("majority")
    passed = F.when(m, True) if not final else F.coalesce(m, F.lit(False))
    error = F.when(F.coalesce(m, F.lit(False)), F.lit(None)).when(F.lit(final) & m.isNotNull(), "sensibility majority rejection").when(F.lit(final), "sensibility lacked majority approval")
    return stats.withColumn("sensibility_passed", passed).withColumn("error", error)


def pair_leaks(comparative: DataFrame) -> DataFrame:
    """Per name and pair: how many judges say that response a (b) leaks, or doesn't."""
    sums = [F.count_if(F.col(f"response_{r}_leaks") == v).alias(f"{r}_{w}") for r in "ab" for w, v in (("yes", True), ("no", False))]
    return comparative.groupBy("name", "pair_family").agg(*sums)


def unanimous_better(comparative: DataFrame, judges: int) -> DataFrame:
    """Pairs on which all judges see a difference and all name the same better model: name, pair_family, majority_better_model."""
    differ = F.col("differ") == True  # noqa: E712
    out = comparative.groupBy("name", "pair_family").agg(
        F.count_if(differ).alias("differ_count"), F.count_if(F.col("differ") == False).alias("same_count"),  # noqa: E712
        F.count_if(differ & (F.col("better_model") == "model0")).alias("better_a_count"), F.count_if(differ & (F.col("better_model") == "model1")).alias("better_b_count"),
    )
    better = F.when(F.col("better_a_count") >= judges, "model0").when(F.col("better_b_count") >= judges, "model1")
    return out.withColumn("majority_better_model", F.when(F.col("differ_count") >= judges, better))


def modal_outcome(comparative: DataFrame, judges: int) -> DataFrame:
    """The outcome (tie, or a winner) that most judges support, half of them and one at least; ties go to the first judge's.

    agreement_kind, majority_better_model, support_count, and judge_model: the first judge that supports it.
    """
    kind = F.when(F.col("differ") == False, "tie").when((F.col("differ") == True) & F.col("better_model").isin("model0", "model1"), "winner")  # noqa: E712
    flat = comparative.withColumn("kind", kind).where("kind is not null").withColumn("won", F.when(F.col("kind") == "winner", F.col("better_model")))
    sums = flat.groupBy("name", "pair_family", "kind", "won").agg(F.count("*").alias("n"), F.min("judge").alias("judge"))
    best = sums.where(F.col("n") >= judges // 2 + 1).groupBy("name", "pair_family").agg(F.min_by(F.struct("kind", "won", "n", "judge"), F.struct(-F.col("n"), F.col("judge"))).alias("m"))
    return best.select("name", "pair_family", F.col("m.kind").alias("agreement_kind"), F.col("m.won").alias("majority_better_model"), F.col("m.n").alias("support_count"), F.col("m.judge").alias("judge_model"))


def pair_analysis(sensible: DataFrame, comparative: DataFrame, judges: int) -> DataFrame:
    """Per name and pair: the votes side by side, and the reasons for which the pair can't be selected."""
    own = vote_stats(sensible, ["name", "model"], "sensible", judges // 2 + 1).select("name", "model", "yes_count", "majority")
    a = own.where("model = 'model0'").select("name", F.col("yes_count").alias("sensibility_a_yes_count"), F.col("majority").alias("sensibility_a"))
    b = own.where("model = 'model1'").select("name", F.col("yes_count").alias("sensibility_b_yes_count"), F.col("majority").alias("sensibility_b"))
    out = pair_leaks(comparative).join(unanimous_better(comparative, judges), ["name", "pair_family"]).join(a, "name", "left").join(b, "name", "left")
    reasons = [
        (~F.coalesce("sensibility_a", F.lit(False)), "response_a_not_sensible"), (~F.coalesce("sensibility_b", F.lit(False)), "response_b_not_sensible"),
        (F.greatest("a_yes", "b_yes") < judges, "no_unanimous_leak"), (F.col("majority_better_model").isNull(), "no_unanimous_better"),
    ]
    out = out.withColumn("filter_reasons", F.array_compact(F.array(*[F.when(c, r) for c, r in reasons])))
    for c in ("sensibility_a_yes_count", "sensibility_b_yes_count"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out.withColumn("selectable", F.size("filter_reasons") == 0)


def selection_options(analysis: DataFrame, comparative: DataFrame, judges: int) -> DataFrame:
    """One row for each judge of a selectable pair that agrees with its better model, with the static part of its rank."""
    own = analysis.where("selectable").join(comparative.where("differ").select("name", "pair_family", "judge", "better_model", "verdict"), ["name", "pair_family"]).where(F.col("better_model") == F.col("majority_better_model"))
    low, both = F.least("sensibility_a_yes_count", "sensibility_b_yes_count"), F.col("sensibility_a_yes_count") + F.col("sensibility_b_yes_count")
    support = own.groupBy("name", "pair_family").agg(F.count("*").alias("pair_support"))
    return own.join(support, ["name", "pair_family"]).select(
        "name", "pair_family", "judge", "better_model", "verdict", F.when(low == judges, 0).otherwise(1).alias("r0"), (-low).alias("r1"), (-both).alias("r2"),
        (-F.greatest("better_a_count", "better_b_count")).alias("r5"), (-F.col("pair_support")).alias("r6"),
    )


def select_pairs(options: DataFrame, seed: int = 42) -> DataFrame:
    """One option per name, in the order of (number of options, seeded token): the least rank given what was chosen before.

    Each choice depends on all before it through the counts of judges and pairs. What it needs of a name, its options'
    ranks, is reduced to a few columns first; then one task reads the names as a sorted stream and keeps two counters.
    """
    sizes = options.groupBy("name").agg(F.count("*").alias("k"), F.collect_list(F.struct("r0", "r1", "r2", "r5", "r6", "judge", "pair_family")).alias("own"))
    ordered = sizes.withColumn("token", F.sha1(F.concat(F.lit(f"{seed}:"), F.col("name").cast("string")))).coalesce(1).sortWithinPartitions("k", "token")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judges, pairs, place = Counter(), Counter(), 0
        for batch in batches:
            rows = []
            for name, own in zip(batch["name"], batch["own"], strict=True):
                best = min(own, key=lambda o: (o["r0"], o["r1"], o["r2"], judges[o["judge"]], pairs[o["pair_family"]], o["r5"], o["r6"], o["judge"], o["pair_family"]))
                judges[best["judge"]] += 1
                pairs[best["pair_family"]] += 1
                rows.append((name, best["pair_family"], best["judge"], place))
                place += 1
            yield pd.DataFrame(rows, columns=["name", "pair_family", "judge", "place"])

    return ordered.select("name", "own").mapInPandas(choose, f"name {options.schema['name'].dataType.simpleString()}, pair_family string, judge string, place long")


def prune(selected: DataFrame, sensible: DataFrame, judges: int, kept: DataFrame | None = None) -> DataFrame:
    """selected with prune_reason: not all judges find both responses sensible, or the caps dropped the name; null: it stays."""
    yes = sensible.where("sensible").groupBy("name", "model").agg(F.countDistinct("judge").alias("yes"))
    unanimous = yes.where(F.col("yes") == judges).groupBy("name").agg(F.countDistinct("model").alias("m")).where("m = 2").select("name", F.lit(True).alias("__u"))
    out = selected.join(unanimous, "name", "left")
    if kept is not None:
        out = out.join(kept.select("name", F.lit(True).alias("__k")), "name", "left")
    dropped = F.lit(False) if kept is None else F.col("__k").isNull()
    return out.withColumn("prune_reason", F.when(F.col("__u").isNull(), "not_unanimously_sensible").when(dropped, "diversity_cap_trim")).drop("__u", "__k")
