"""Batches for training: layouts of columns, scorers, objectives as aggregates, and the builder that puts them together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import rewards as R


@dataclass(frozen=True)
class Layout:
    """Which columns of a batch belong to prompts, to sampled sequences, and to packed tokens (offsets and the values they cut)."""

    prompt: tuple[str, ...] = ()
    sequence: tuple[str, ...] = ()
    packed: tuple[tuple[str, ...], ...] = ()
    host: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        names = self.columns
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"columns named twice: {twice}")
        if unknown := sorted(set(self.host) - set(names)):
            raise ValueError(f"host columns that aren't registered: {unknown}")

    @property
    def columns(self) -> list[str]:
        return [*self.prompt, *self.sequence, *(n for group in self.packed for n in group)]

    def extended(self, prompt: tuple[str, ...] = (), sequence: tuple[str, ...] = (), packed: tuple[tuple[str, ...], ...] = (), host: tuple[str, ...] = ()) -> Layout:
        """A layout with more columns; those that are there already stay where they are."""
        merged = lambda a, b: tuple(dict.fromkeys((*a, *b)))
        return replace(self, prompt=merged(self.prompt, prompt), sequence=merged(self.sequence, sequence), packed=self.packed + packed, host=merged(self.host, host))

    def check(self, df: DataFrame) -> DataFrame:
        """df with just the registered columns; a column that isn't registered, or is registered and missing, fails."""
        own = self.columns
        if unknown := sorted(set(df.columns) - set(own)):
            raise ValueError(f"columns that aren't registered: {unknown}")
        if missing := [n for n in own if n not in df.columns]:
            raise ValueError(f"missing columns: {missing}")
        return df.select(*own)


def hook(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of one text over a column, batch by batch; nulls stay null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: f(x) if isinstance(x, str) else None)

    return run


def scored(batch: DataFrame, scorer: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """batch with the scorer's columns (score at least); fails unless there is exactly one score for each row of batch."""
    got = scorer(batch)
    if "score" not in got.columns:
        raise ValueError("a scorer returns a column score")
    own, n = got.select(*keys).distinct(), batch.count()
    if got.count() != n or batch.select(*keys).join(own, keys, "left_semi").count() != n:
        raise ValueError("scores don't match the sequences one to one")
    return batch.join(got.select(*keys, *[c for c in got.columns if c not in batch.columns]), keys)


class Objective(Protocol):
    """A training objective as a distributed aggregate: items to normalize by, sums of a part, metrics of all parts."""

    name: str

    def layout(self) -> Layout: ...

    def items(self) -> Column: ...

    def sums(self) -> dict[str, Column]: ...

    def finish(self, totals: dict[str, Column], items: Column) -> dict[str, Column]: ...


@dataclass(frozen=True)
class SurrogateObjective:
    """The soft-gated policy loss per token, over columns ratio (per token), advantage, action_mask."""

    name: str = "surrogate"
    tau_pos: float = 1.0
    tau_neg: float = 1.05

    def layout(self) -> Layout:
        return Layout(sequence=("ratio", "advantage", "action_mask"))

    def items(self) -> Column:
        return F.aggregate("action_mask", F.lit(0).cast("long"), lambda a, m: a + m.cast("int"))

    def sums(self) -> dict[str, Column]:
        loss = F.zip_with("ratio", "action_mask", lambda r, m: F.when(m, R.surrogate(r, F.col("advantage"), self.tau_pos, self.tau_neg)).otherwise(F.lit(0.0)))
        return {"loss": F.aggregate(loss, F.lit(0.0), lambda a, x: a + x), "positive": (F.col("advantage") > 0).cast("int")}

    def finish(self, totals: dict[str, Column], items: Column) -> dict[str, Column]:
        return {"loss": F.coalesce(totals["loss"] / F.nullif(items, F.lit(0)), F.lit(0.0)), "tokens": items, "positive_sequences": totals["positive"]}


def objective_metrics(batch: DataFrame, objective: Objective, by: list[str] = ()) -> DataFrame:
    """The objective's metrics by group: partial sums on each task, merged, then finished."""
    sums = objective.sums()
    parts = batch.groupBy(*by).agg(F.sum(objective.items()).alias("__items"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    done = objective.finish({n: F.col(f"__{n}") for n in sums}, F.col("__items"))
    return parts.select(*by, *[c.alias(n) for n, c in done.items()])


def policy_batch(batch: DataFrame, scorer: Callable[[DataFrame], DataFrame], keys: list[str], prompt: str = "prompt", clip: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the batch with score, valid and advantage of each sequence, its summary).

    Scores come from the scorer; null ones are invalid. Valid scores are clipped, and an advantage is the score less the
    mean of the prompt's valid scores; invalid sequences have advantage 0.
    """
    df = scored(batch, scorer, keys).withColumn("valid", F.col("score").isNotNull())
    if clip is not None:
        df = df.withColumn("score", F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), F.col("score"))))
        df = df.withColumn("score", F.when(F.col("valid"), F.col("score")))
    mean = df.groupBy(prompt).agg(F.avg("score").alias("__mean"))
    df = df.join(mean, prompt).withColumn("advantage", F.when(F.col("valid"), F.col("score") - F.col("__mean")).otherwise(F.lit(0.0))).drop("__mean")
    summary = df.agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean_score"), F.round(F.coalesce(F.avg(F.abs("advantage")), F.lit(0.0)), 6).alias("mean_abs_advantage"))
    return df, summary
