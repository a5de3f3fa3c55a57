"""Which file to read, and sinks with one file a split: dataset splits, lineage of mined files, name banks, aliases, summaries, snapshots."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.ledger import latest
from quillspark.operators.order import with_position
from quillspark.sources.files import exists

#: Splits that are read from another split's file, and those that are put together.
SPLIT_FILES = {"validation": ["train"], "all": ["train", "test"]}


def split_paths(spark: SparkSession, source: str, split: str, cache: str | None = None, fetch: Callable[[str, str], None] | None = None) -> list[str]:
    """Paths of a split's JSON lines: source itself if it is a file, else data/{part}.jsonl or {part}.jsonl under source, else under cache.

    What is nowhere is fetched to the cache by fetch(part, path), or fails with the places that were tried.
    """
    if source.endswith((".jsonl", ".json")):
        return [source]
    out = []
    for part in SPLIT_FILES.get(split, [split]):
        tried = [f"{source}/data/{part}.jsonl", f"{source}/{part}.jsonl", *([f"{cache}/{part}.jsonl"] if cache else [])]
        found = next((p for p in tried if exists(spark, p)), None)
        if found is None and fetch is not None and cache:
            fetch(part, tried[-1])
            found = tried[-1] if exists(spark, tried[-1]) else None
        if found is None:
            raise FileNotFoundError(f"no file of split {part}; tried {tried}")
        out.append(found)
    return out


def read_split(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of a split's files, one file after the other, with pos."""
    parts = [spark.read.schema(schema).option("mode", "FAILFAST").json(p).withColumns({"__f": F.lit(k), "__i": F.monotonically_increasing_id()}) for k, p in enumerate(paths)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return with_position(rows, [F.col("__f"), F.col("__i")], "pos").drop("__f", "__i")


def source_of(spark: SparkSession, mined: str, metadata: dict, explicit: str | None, base: str) -> str:
    """The input that a mined file came from: the explicit path, else metadata.input_path, tried under base, beside the mined file, and above base."""
    if explicit:
        return explicit
    found = metadata.get("input_path")
    if not found:
        raise ValueError("the mined file names no input_path; give the source's path")
    if found.startswith("/") or "://" in found:
        return found
    for folder in (base, mined.rsplit("/", 1)[0], base.rstrip("/").rsplit("/", 1)[0]):
        if exists(spark, f"{folder}/{found}"):
            return f"{folder}/{found}"
    raise FileNotFoundError(f"can't resolve {found!r}")


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON file that holds one object: a small dimension."""
    got = json.loads(spark.read.text(path, wholetext=True).first().value)
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no object")
    return got


def domain_aliases(spark: SparkSession, path: str) -> DataFrame:
    """variant, canonical of a JSON object that maps one to the other; any number of entries."""
    return spark.createDataFrame([(k, str(v)) for k, v in read_json(spark, path).items()], "variant string, canonical string")


def name_bank(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A name bank's tables: last (name, origin), first (name, gender), placeholders (name), forced (name); names lower-cased.

    The file has first_names (origin -> gender -> names), last_names (origin -> names), extras that win over these, and lists
    of placeholder names and of surnames to replace in any case. Of equal names the one listed last wins.
    """
    bank = read_json(spark, path)
    last = {n.lower(): origin for origin, names in bank.get("last_names", {}).items() for n in names}
    last.update({k.lower(): v for k, v in bank.get("extra_last_name_ethnicities", {}).items()})
    first = {n.lower(): g for by in bank.get("first_names", {}).values() for g in ("male", "female") for n in by.get(g, [])}
    first.update({k.lower(): v for k, v in bank.get("extra_first_name_genders", {}).items()})
    lower = lambda key: [(n.lower(),) for n in bank.get(key, [])]
    return {
        "last": spark.createDataFrame(list(last.items()), "name string, origin string"), "first": spark.createDataFrame(list(first.items()), "name string, gender string"),
        "placeholders": spark.createDataFrame(lower("placeholder_names"), "name string"), "forced": spark.createDataFrame(lower("forced_last_names"), "name string"),
    }


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON lines in a folder that appears as a whole or not at all (Spark's commit protocol)."""
    df.write.mode("overwrite").json(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """Rows as JSON lines, a folder for each split; a second run replaces them."""
    rows.write.mode("overwrite").partitionBy(split).json(path)


def ledger_summary(ledger: DataFrame, cases: int, keys: tuple[str, ...] = ("sample", "model"), extra: dict[str, Column] | None = None) -> DataFrame:
    """One row: num_cases, num_rows, models, and status counts by model, of all rows and of the latest of each key (model -> status -> n)."""

    def counts(df: DataFrame, out: str) -> DataFrame:
        by = df.groupBy("model", "status").count().groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("m"))
        return by.agg(F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias(out))

    head = ledger.agg(F.count("*").alias("num_rows"), F.array_sort(F.collect_set("model")).alias("models")).withColumn("num_cases", F.lit(cases))
    out = head.crossJoin(counts(ledger, "status_counts_by_model")).crossJoin(counts(latest(ledger, list(keys)), "latest_status_counts_by_model"))
    return out.withColumns(extra or {})


def write_summary(ledger: DataFrame, path: str, cases: int, keys: tuple[str, ...] = ("sample", "model"), extra: dict[str, Column] | None = None) -> None:
    """The summary of a ledger as one JSON row beside it."""
    ledger_summary(ledger, cases, keys, extra).write.mode("overwrite").json(path)


def write_snapshot(tables: dict[str, DataFrame], done: dict[str, list[str]], path: str) -> None:
    """All tables of a mining run after a pass, each in a folder of its own, then the list of finished passes, which makes it count."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/pass={len(done.get('passes', []))}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(done),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/done")


def read_snapshot(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """Tables and finished passes of the last snapshot that was completed; nothing without one."""
    if not exists(spark, f"{path}/done/_SUCCESS"):
        return {}, {}
    done = json.loads(spark.read.text(f"{path}/done").first().value)
    return {n: spark.read.parquet(f"{path}/pass={len(done.get('passes', []))}/{n}") for n in names}, done
