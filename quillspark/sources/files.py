"""Sources and sinks: JSON arrays, JSON lines in three degrees of strictness, catalogues, logs, ledgers, rejects, caches."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.order import with_position
from quillspark.sources.store import cut


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one JSON array; any other shape fails."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Columns that order the lines of text_lines(): file, block of the file, line in the block.
LINE = ("f", "b", "i")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and LINE for each line; blocks are read in any order, so the place in the file comes from where a block starts."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with pos, the place in the file; blank and broken lines are skipped, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"pos long, {schema}")
    good = text_lines(spark, path).where((F.trim("value") != "") & F.try_parse_json("value").isNotNull())
    placed = with_position(good.select(*LINE, F.from_json("value", schema).alias("r")), [F.col(c) for c in LINE], "pos")
    return placed.where("r is not null").select("pos", "r.*")


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a broken line fails, blank ones don't count. Batches of a ledger (see append) are read together."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.drop("batch") if "batch" not in schema else rows


def jsonl_counting(spark: SparkSession, path: str, schema: str, usable: Column, held_out: Column) -> tuple[DataFrame, dict[str, int]]:
    """Usable rows, and how many lines were broken, unusable or held out; raises if none is left."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows, bad = cut(rows, "lines"), F.col("_corrupt").isNotNull()
    counts = rows.agg(F.count_if(bad | ~F.coalesce(usable, F.lit(False))).alias("skipped_rows"), F.count_if(~bad & F.coalesce(usable, F.lit(False)) & held_out).alias("held_out_rows"), F.count("*").alias("n")).first().asDict()
    kept = rows.where(~bad & F.coalesce(usable, F.lit(False)) & ~held_out).drop("_corrupt")
    if counts["n"] == counts["skipped_rows"] + counts["held_out_rows"]:
        raise ValueError("no usable rows")
    return kept, counts


def by_name(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Samples by name: the first of name, sample_name, id that isn't blank, else the first in source, else a hash of the row; the last of equal names wins."""
    there = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("name", "sample_name", "id") if c in df.columns]
    if "source" in df.columns and isinstance(df.schema["source"].dataType, T.StructType):
        there += [F.nullif(F.trim(F.col(f"source.{c}").cast("string")), F.lit("")) for c in ("name", "sample_name", "id") if c in df.schema["source"].dataType.names]
    rest = F.substring(F.sha1(F.to_json(F.struct(*sorted(c for c in df.columns if c != pos)))), 1, 12)
    keyed = df.withColumn("key", F.coalesce(*there, rest))
    return keyed.groupBy("key").agg(F.max_by(F.struct(*df.columns), F.col(pos)).alias("r")).select("key", "r.*")


def manifest(samples: DataFrame, names: list[str], limit: int | None = None) -> DataFrame:
    """Samples of a list of names in its order; fails with a preview of the names that are missing."""
    wanted = samples.sparkSession.createDataFrame(list(enumerate(names)), "place int, name string")
    missing = [r.name for r in wanted.join(samples.select("name"), "name", "left_anti").orderBy("place").limit(5).collect()]
    if missing:
        raise ValueError(f"missing samples: {', '.join(missing)}")
    out = wanted.join(samples, "name").orderBy("place")
    return out.limit(limit) if limit is not None else out


def require_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to right; fails with a preview of keys that right lacks."""
    missing = [r[0] for r in left.select(key).join(right.select(key), key, "left_anti").distinct().limit(5).collect()]
    if missing:
        raise ValueError(f"missing {key}: {missing}")
    return left.join(right, key)


#: Parts of names of derived files.
DERIVED = ("combined", "diversity_filtered", "postprocessed", "mined")


def discover(names: list[str], prefix: str = "main_data_generated") -> list[str]:
    """Generated inputs among file names, without derived ones; a second part (…_2) comes before its base."""
    own = [n for n in names if n.startswith(prefix) and n.endswith(".json") and not any(m in n for m in DERIVED)]
    return sorted(own, key=lambda n: (re.sub(r"_2$", "", n[:-5]), not n[:-5].endswith("_2")))


def weighted_names(spark: SparkSession, path: str) -> DataFrame:
    """name, frequency of a JSON-lines list: blank names dropped, frequencies one at least."""
    rows = jsonl_strict(spark, path, "name string, frequency int")
    return rows.where(F.trim("name") != "").select(F.trim("name").alias("name"), F.greatest(F.lit(1), F.coalesce("frequency", F.lit(1))).alias("frequency"))


def option_pools(pools: dict[str, list[str]], required: list[str]) -> dict[str, list[str]]:
    """Pools of normalized distinct options in order; fails for one that is missing or empty."""
    out = {k: list(dict.fromkeys(x for x in (re.sub(r"\s+", " ", str(v or "").strip()) for v in pools.get(k) or []) if x)) for k in required}
    if empty := [k for k, v in out.items() if not v]:
        raise ValueError(f"empty option pools: {empty}")
    return out


def training_log(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """line, step, value of a metric's lines in a log: each takes the last step named before it, 0 before the first.

    Ranges of lines carry the step inside, and the last step of the ranges before comes from a table of one row a range.
    """
    lines = with_position(text_lines(spark, path), [F.col(c) for c in LINE], "line")
    step = F.nullif(F.regexp_extract("value", r"\bstep[ =:]+(\d+)", 1), F.lit("")).cast("long")
    value = F.nullif(F.regexp_extract("value", rf"{re.escape(metric)}[ =:]+(-?[\d.]+)", 1), F.lit("")).cast("double")
    marked = lines.select("line", step.alias("s"), value.alias("v"), F.floor(F.col("line") / 4096).alias("c")).where("s is not null or v is not null")
    ends = marked.where("s is not null").groupBy("c").agg(F.max_by("s", "line").alias("e"))
    before = marked.select("c").distinct().join(ends, "c", "left").select("c", F.last("e", ignorenulls=True).over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inner = F.last("s", ignorenulls=True).over(Window.partitionBy("c").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    carried = marked.withColumn("own", inner).join(before, "c").withColumn("step", F.coalesce("own", "before", F.lit(0)))
    return carried.where("v is not null").select("line", "step", F.col("v").alias("value"))


def append(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Rows to a ledger's end, by Spark's commit protocol. With a batch's name a repeated append replaces what it wrote before."""
    if batch is None:
        df.write.mode("append").json(path)
    else:
        df.write.mode("overwrite").json(f"{path}/batch={batch}")


def write_split(df: DataFrame, path: str, accepted: Column) -> None:
    """Accepted rows and rejected ones, with their stage and reason, in two folders."""
    df.where(accepted).drop("stage", "reason").write.mode("overwrite").parquet(f"{path}/accepted")
    df.where(~F.coalesce(accepted, F.lit(False))).write.mode("overwrite").parquet(f"{path}/rejected")


def cached(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Rows of wanted keys from a cache table; what it lacks is made and added, or fails where make is None. Repeated keys fail."""
    old = spark.read.parquet(path) if exists(spark, path) else None
    if old is not None and not old.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the cache has repeated keys")
    missing = wanted if old is None else wanted.join(old.select(*keys), keys, "left_anti")
    if not missing.isEmpty():
        if make is None:
            raise ValueError("the cache lacks keys and is read-only")
        make(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted, keys, "left_semi")


def recorded_completions(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """prompts with their completions from a table by the hash of the prompt; an empty text where there is none."""
    keyed = prompts.withColumn("prompt_sha1", F.substring(F.sha1("prompt"), 1, 12))
    return keyed.join(recorded.select("prompt_sha1", "completion"), "prompt_sha1", "left").withColumn("completion", F.coalesce("completion", F.lit("")))


class Registry:
    """Named DataFrame factories, scorers and hooks."""

    def __init__(self) -> None:
        self.made: dict[str, Callable] = {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self.made[name] = f
            return f

        return add

    def get(self, name: str) -> Callable:
        if name not in self.made:
            raise KeyError(f"unknown name {name!r}; known: {sorted(self.made)}")
        return self.made[name]


DATASETS = Registry()
SCORERS = Registry()
