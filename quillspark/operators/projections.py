"""Projections over scenario, preference and result records, small order rules, configuration and schedule helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X


def domains_of(*paths: Column) -> Column:
    """The first list of domains that isn't empty, sorted and distinct; legacy scalars come as one-element arrays."""
    clean = [F.array_sort(X.normalize_list(F.filter(p, lambda x: x.isNotNull()))) for p in paths]
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in clean], F.array().cast("array<string>"))


def canonical_domain(label: Column) -> Column:
    """Lower-cased, dashes and underscores of any kind as blanks, one blank between words."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(label)), X.DASHES + "_-", " " * (len(X.DASHES) + 2)), r"\s+", " "))


def canonical_domains(df: DataFrame, key: str, domains: str, aliases: DataFrame) -> DataFrame:
    """key, domains, signature: labels through an alias table (variant, canonical), then sorted and distinct."""
    table = aliases.select(canonical_domain(F.col("variant")).alias("label"), canonical_domain(F.col("canonical")).alias("to")).dropDuplicates(["label"])
    flat = df.select(key, F.explode_outer(domains).alias("d")).select(key, canonical_domain(F.coalesce("d", F.lit(""))).alias("label"))
    found = flat.join(table, "label", "left").groupBy(key).agg(F.array_sort(F.collect_set(F.nullif(F.coalesce("to", "label"), F.lit("")))).alias("domains"))
    return found.withColumn("signature", F.when(F.size("domains") > 0, F.array_join("domains", "|")).otherwise("unknown"))


def first_text(*values: Column) -> Column:
    """The first value that isn't blank, trimmed; empty if all are."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values], F.lit(""))


def final_action(expected: Column, a: Column, b: Column, training: bool) -> Column:
    """Expected action, else the responses' tool names or JSON names: b before a in training, a before b in evaluation."""
    one = lambda r: first_text(r["tool_name"], F.get_json_object(r["action_raw"], "$.name"))
    order = (b, a) if training else (a, b)
    return first_text(expected, *map(one, order))


def option_match(df: DataFrame, value: str, options: list[str]) -> DataFrame:
    """df with the option that equals a value but for case, in the option's spelling; fails at run time for others."""
    known = F.coalesce(*[F.when(F.lower(F.trim(value)) == o.lower(), o) for o in options])
    return df.withColumn(value, F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit(f"{value}: unknown option "), F.coalesce(value, F.lit("null")))).cast("string")))


def not_tied(preference: str) -> Column:
    """Rows whose preference isn't 0; those without one stay."""
    return F.col(preference).isNull() | (F.col(preference) != 0)


def drop_weak(df: DataFrame, drop_near_ties: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows with both responses and, if asked, a clear target; and counts of what was dropped for which reason."""
    blank = (F.trim(F.coalesce("response_a", F.lit(""))) == "") | (F.trim(F.coalesce("response_b", F.lit(""))) == "")
    near = F.lit(drop_near_ties) & F.coalesce(F.col("majority_bucket").isin("tie", "n"), F.lit(False)) & (F.abs("target_score") < 1)
    marked = df.withColumn("dropped", F.when(blank, "empty_response").when(near, "near_tie"))
    return marked.where("dropped is null").drop("dropped"), marked.where("dropped is not null").groupBy("dropped").agg(F.count("*").alias("n"))


def repeat(df: DataFrame, n: int, out: str = "generation") -> DataFrame:
    """Each row n times, numbered from 0."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def best_candidate(df: DataFrame, key: str, score: str, k: str) -> DataFrame:
    """The candidate of each key with the highest score, the first of equal ones."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(k))).alias("m")).select(key, "m.*")


def reuse_or_pending(cases: DataFrame, stored: DataFrame, valid: Column) -> DataFrame:
    """cases (name, model) with the stored action of the same model where it is valid, and reused; others are pending."""
    out = cases.join(stored.select("name", "model", "action"), ["name", "model"], "left")
    ok = F.coalesce(F.col("action").isNotNull() & valid, F.lit(False))
    return out.withColumn("reused", ok).withColumn("action", F.when(ok, F.col("action")))


def zip_outputs(prompts: DataFrame, outputs: DataFrame, masked: Column, sentinel: str = "") -> DataFrame:
    """Prompts with their outputs by place; masked rows get a sentinel, and other rows without an output fail at run time."""
    out = prompts.join(outputs, "place", "left")
    return out.withColumn("output", F.when(masked, F.lit(sentinel)).when(F.col("output").isNull(), F.raise_error(F.lit("fewer outputs than prompts")).cast("string")).otherwise(F.col("output")))


def normalize_annotations(annotations: Column) -> Column:
    """Annotations with their defaults: no preference is unsure, blank explanations are empty; missing entries go."""
    return F.transform(F.filter(annotations, lambda a: a.isNotNull()), lambda a: F.struct(first_text(a["preference"], F.lit("unsure")).alias("preference"), F.coalesce(F.trim(a["explanation"]), F.lit("")).alias("explanation"), F.coalesce(a["gold"], F.lit(False)).alias("gold")))


def tool_names(trajectory: Column) -> Column:
    """Distinct tool names of JSON lines, in order."""
    names = F.transform(F.split(F.coalesce(trajectory, F.lit("")), "\n"), lambda x: F.when(F.get_json_object(x, "$.type") == "tool_use", F.nullif(F.trim(F.get_json_object(x, "$.name")), F.lit(""))))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))


def argument_types(a: Column, b: Column) -> Column:
    """Map of the argument names of two JSON objects to their types; the first type of a name counts."""
    keys = lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))
    kind = lambda x, k: F.call_function("get_json_object", x, F.concat(F.lit("$['"), k, F.lit("']")))
    name = lambda v: F.when(v.rlike(r"^\["), "array").when(v.rlike(r"^\{"), "object").when(v.rlike("^(true|false)$"), "boolean").when(v.rlike(r"^-?\d+$"), "integer").when(v.rlike(r"^-?\d+\.\d+$"), "number").otherwise("string")
    first = F.transform(keys(a), lambda k: F.struct(k.alias("k"), name(kind(a, k)).alias("t")))
    second = F.transform(F.array_except(keys(b), keys(a)), lambda k: F.struct(k.alias("k"), name(kind(b, k)).alias("t")))
    return F.map_from_entries(F.concat(first, second))


def bullet_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.concat(F.lit("- "), x)), "\n")


def embedding_text(parts: dict[str, Column]) -> Column:
    """Labelled lines of the parts that aren't blank."""
    return F.concat_ws("\n", *[F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"{k}: "), X.normalize_text(v))) for k, v in parts.items()])


def short_hash(x: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(F.coalesce(x, F.lit(""))), 1, n)


def metric_order(names: Iterable[str], priority: list[str], prefixes: list[str]) -> list[str]:
    """Names by explicit priority, then by the first prefix that fits, then by name."""
    place = {n: k for k, n in enumerate(priority)}
    return sorted(names, key=lambda n: (place.get(n, len(place)), next((k for k, p in enumerate(prefixes) if n.startswith(p)), len(prefixes)), n))


def merge_sampling(base: dict, extra: dict | None, reserved: frozenset[str] = frozenset({"n", "seed", "max_tokens"})) -> dict:
    """Sampling parameters with extra ones over them; reserved names fail."""
    if bad := reserved & set(extra or {}):
        raise ValueError(f"reserved sampling parameters: {sorted(bad)}")
    return {**base, **(extra or {})}


def resume_position(step: int, per_epoch: int) -> tuple[int, int]:
    """Epoch and step in it."""
    return divmod(step, max(per_epoch, 1))


def is_due(step: int, every: int) -> bool:
    return every > 0 and step % every == 0


def resolve_families(counts: dict[str, int], requested: list[str] | None, primary: list[str], step: str = "step") -> list[str]:
    """Requested families, else the primary ones that are there, else step, else all by frequency."""
    if requested:
        return list(dict.fromkeys(f.strip().lower() for f in requested if f.strip()))
    there = [f for f in primary if counts.get(f)]
    return there or ([step] if counts.get(step) else sorted(counts, key=lambda f: (-counts[f], f)))


def cap_config(pairs: Iterable[tuple[str, float]], default: dict[str, float]) -> dict[str, float]:
    """Caps by field: given ones over the defaults; those of 0 or less turn a field off."""
    merged = {**default, **dict(pairs)}
    return {f: p for f, p in merged.items() if p > 0}


def row_digest(df: DataFrame, *cols: str) -> Column:
    """A key of a row's content, independent of the order of columns."""
    return F.sha2(F.to_json(F.struct(*sorted(cols or df.columns))), 256)


def loader_batches(df: DataFrame, seed: int, epoch: int, size: int, id_col: str) -> DataFrame:
    """Rows in a seeded order with their batch; the last batch goes if it isn't full."""
    from quillspark.operators.order import with_position

    placed = with_position(df.withColumn("__o", F.xxhash64(F.lit(seed + epoch), F.col(id_col))), [F.col("__o"), F.col(id_col)], "place")
    full = F.count("*").over(Window.partitionBy("batch")) == size
    return placed.drop("__o").withColumn("batch", F.floor(F.col("place") / size)).withColumn("__full", full).where("__full").drop("__full")
