"""Scenario records: validation by rule tables, staged filters, toolkit dimensions, token masks, merge of generated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.order import order_index, unique_names


def errors(rules: list[tuple[Column, str]]) -> Column:
    """Messages of the rules that a record breaks, in the order of the table; a rule that can't be told is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in rules]))


#: Names that stand for no one.
PLACEHOLDERS = ["john doe", "jane doe", "john smith", "jane smith", "bob smith", "alice smith", "test user", "example user"]


def scenario_rules(min_steps: int = 3, max_steps: int = 8, max_chars: int = 65_536, min_memories: int = 5) -> list[tuple[Column, str]]:
    """Rules of a parsed scenario: subject, recipient, domains (array), toolkits, steps (array of action, observation), memories, trajectory."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    kits = F.transform("steps", lambda s: F.regexp_extract(s["action"], r"^([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)*)", 1))
    return [
        (filled("subject"), "subject is empty"), (filled("recipient"), "recipient is empty"), (F.lower("subject") != F.lower("recipient"), "subject is the recipient"),
        (~F.lower(F.split("subject", ",").getItem(0)).isin(PLACEHOLDERS), "subject is a placeholder"), (size("domains").between(1, 3), "one to three domains are needed"), (size("toolkits") > 0, "toolkits are empty"),
        (size("steps").between(min_steps, max_steps), "too few or too many steps"), (F.length("trajectory") <= max_chars, "trajectory is too long"),
        (F.forall("steps", lambda s: F.trim(F.coalesce(s["observation"], F.lit(""))) != ""), "an observation is empty"), (F.size(F.array_except("toolkits", kits)) == 0, "a toolkit is not used"), (size("memories") >= min_memories, "too few memories"),
    ]


def staged(df: DataFrame, stages: list[tuple[str, Column, Column]]) -> DataFrame:
    """df with stage and reason of the first stage that a row fails (passed is not true); null for rows that pass all."""
    failed = [F.when(~F.coalesce(passed, F.lit(False)), F.struct(F.lit(name).alias("stage"), reason.alias("reason"))) for name, passed, reason in stages]
    return df.withColumn("__f", F.coalesce(*failed)).withColumns({"stage": F.col("__f.stage"), "reason": F.col("__f.reason")}).drop("__f")


def toolkit_tools(catalogue: DataFrame) -> DataFrame:
    """action, toolkit, summary, required of nested toolkit rows (toolkit, tools: array of name, summary, parameters)."""
    flat = catalogue.select("toolkit", F.explode("tools").alias("t"))
    required = F.transform(F.filter("t.parameters", lambda p: p["required"]), lambda p: p["name"])
    return flat.select(F.concat("toolkit", "t.name").alias("action"), "toolkit", F.col("t.summary").alias("summary"), required.alias("required"))


def toolkit_aliases(catalogue: DataFrame) -> DataFrame:
    """alias, toolkit: normalized names, and those without a Manager at the end."""
    plain = F.regexp_replace(F.lower("toolkit"), r"[^a-z0-9]", "")
    return catalogue.select("toolkit", F.explode(F.array_distinct(F.array(plain, F.regexp_replace(plain, "manager$", "")))).alias("alias"))


def toolkit_of(actions: DataFrame, tools: DataFrame) -> DataFrame:
    """actions (action) with their toolkit: of the action itself, else the longest toolkit whose name it starts with.

    The catalogue is a small dimension; prefixes are joined by equality, after cutting each action at every length.
    """
    exact = actions.join(tools.select("action", "toolkit"), "action", "left")
    names = tools.select(F.col("toolkit").alias("prefix")).distinct()
    cuts = actions.select("action", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("action"), F.lit(1))), lambda n: F.substring("action", 1, n))).alias("prefix"))
    best = cuts.join(names, "prefix").groupBy("action").agg(F.max_by("prefix", F.length("prefix")).alias("by_prefix"))
    return exact.join(best, "action", "left").select("action", F.coalesce("toolkit", "by_prefix").alias("toolkit"))


def missing_parameters(steps: DataFrame, tools: DataFrame) -> DataFrame:
    """steps (action, action_input: JSON) with the required parameters that the input lacks."""
    keys = F.coalesce(F.json_object_keys("action_input"), F.array().cast("array<string>"))
    return steps.join(tools.select("action", "required"), "action", "left").withColumn("missing", F.array_except(F.coalesce("required", F.array().cast("array<string>")), keys)).drop("required")


def first_match(tokens: Column, needle: list[int]) -> Column:
    """Place (from 0) of the first occurrence of a token sequence; -1 without one."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - len(needle) + 1, F.lit(1)))
    found = F.filter(starts, lambda i: F.slice(tokens, i, len(needle)) == F.array(*map(F.lit, needle)))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(0)) - 1


def response_mask(tokens: Column, closes: list[list[int]]) -> Column:
    """True for tokens behind the earliest close sequence; all true without one."""
    ends = [F.when(first_match(tokens, c) >= 0, first_match(tokens, c) + len(c)) for c in closes]
    start = F.coalesce(F.least(*ends) if len(ends) > 1 else ends[0], F.lit(0))
    return F.transform(tokens, lambda t, i: i >= start)


def merge(files: list[tuple[str, str, DataFrame]], families: list[str]) -> DataFrame:
    """Samples of several files (family, path, rows with pos and name) in family order, with provenance and unique names."""
    parts = [df.withColumns({"combined_source_family": F.lit(f), "combined_source_file": F.lit(p)}) for f, p, df in files]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    placed = order_index(out, "combined_source_family", families, ["combined_source_file", "pos"])
    return unique_names(placed.withColumn("combined_original_name", F.col("name")), "name", "combined_order_index", "name")


def finite(df: DataFrame, *cols: str) -> DataFrame:
    """df, or an error at run time for a value that is no finite number."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"not finite: {', '.join(cols)}")).cast("boolean")).otherwise(True))
