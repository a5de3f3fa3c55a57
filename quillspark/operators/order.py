"""Order-dependent operators: positions, interleaving, first-wins, suffix names, seeded orders.

A total order over all rows is a range-partitioned sort with per-partition offsets, so no task gets all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.store import cut


def with_position(df: DataFrame, keys: list[Column], out: str) -> DataFrame:
    """df with each row's place (from 0) in the order of keys: sort by range, number rows in partitions, add the offsets before.

    The sorted rows are written once, so that sizes and rows can't come from two different sorts (a retry, a coalesced shuffle).
    """
    placed = cut(df.orderBy(*keys).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "sorted")
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.drop("__n")), "__p").withColumn(out, F.col("__before") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__before", "__first")


def rank_within(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """df with each row's rank (from 1) within by: its place in the order of all rows less the first place of its group, so that no task gets a group."""
    placed = cut(with_position(df, [F.col(c) for c in (*by, *order)], "__place"), "placed")
    first = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("__place").alias("__start"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return placed.join(first, same).withColumn(out, F.col("__place") - F.col("__start") + 1).drop("__place", "__start", *[f"__{c}" for c in by])


def place_in(col: str, values: list[str]) -> Column:
    """Place of a value in a fixed list, from 0; null if it isn't listed."""
    return F.coalesce(*[F.when(F.col(col) == v, k) for k, v in enumerate(values)])


def order_index(df: DataFrame, family: str, families: list[str], then: list[str]) -> DataFrame:
    """combined_order_index over listed families in list order, then by the given columns; others are dropped."""
    return with_position(df.where(F.col(family).isin(families)), [place_in(family, families), *map(F.col, then)], "combined_order_index")


def unique_names(df: DataFrame, name: str, pos: str, out: str) -> DataFrame:
    """df with names made unique: the first of equal names stays, the n-th becomes name__dup{n}."""
    n = F.col("__nth")
    return rank_within(df, [name], [pos], "__nth").withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__dup"), n.cast("string")))).drop("__nth")


def keep_first(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each key by position: an aggregate with partial minima, not a window, so hot keys don't gather."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("m")).select(*keys, "m.*").select(*df.columns)


def round_robin(df: DataFrame, family: str, families: list[str], pos: str) -> DataFrame:
    """turn: one row of each listed family per round, in list order; others are dropped."""
    own = rank_within(df.where(F.col(family).isin(families)), [family], [pos], "__rn")
    return with_position(own, [F.col("__rn"), place_in(family, families)], "turn").drop("__rn")


def protected_order(df: DataFrame, family: str, families: list[str], pos: str) -> DataFrame:
    """Round robin, but a family that alone is the largest comes after all others."""
    own = df.where(F.col(family).isin(families))
    sizes = own.groupBy(family).count()
    largest = sizes.groupBy("count").agg(F.min(family).alias(family), F.count("*").alias("__k")).orderBy(F.desc("count")).limit(1).where("__k = 1").select(family, F.lit(True).alias("__last"))
    own = own.join(F.broadcast(largest), family, "left").withColumn("__last", F.coalesce("__last", F.lit(False)))
    own = rank_within(own, [family], [pos], "__rn")
    return with_position(own, [F.col("__last"), F.col("__rn"), place_in(family, families)], "turn").drop("__rn", "__last")


def order_token(seed: int, name: Column) -> Column:
    """A stable pseudo-random order token: sha1 of seed:name."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), name))
