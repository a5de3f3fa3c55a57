"""Names, scopes and families as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Titles before names.
TITLES = ["dr", "mr", "mrs", "ms", "prof", "professor", "rev", "sir", "miss"]


def strip_title(name: Column) -> Column:
    return F.regexp_replace(name, rf"(?i)^\s*(?:{'|'.join(TITLES)})\.*\s+(?=\S)", "")


def lead_name(value: Column) -> Column:
    """Lower-cased name before the first comma, without a title."""
    first = F.trim(F.split(F.coalesce(value, F.lit("")), ",").getItem(0))
    return F.lower(F.regexp_replace(F.trim(strip_title(first)), r"\s+", " "))


def subject_scope(subject: Column, sender: Column) -> Column:
    """Whom data are about, for balancing: unknown if either is blank, several subjects, the sender, or a third party."""
    s = F.lower(F.trim(F.coalesce(subject, F.lit(""))))
    name = lead_name(sender)
    return F.when((s == "") | (name == ""), "unknown").when(s.contains(" and "), "multi_subject").when(s.contains(name), "self").otherwise("third_party")


def tracker_scope(subject: Column, sender: Column) -> Column:
    """The tracker's rule differs: a blank sender makes a third party, and titles stay."""
    s = F.lower(F.trim(F.coalesce(subject, F.lit(""))))
    name = F.lower(F.trim(F.split(F.coalesce(sender, F.lit("")), ",").getItem(0)))
    return F.when(s == "", "unknown").when(s.contains(" and "), "multi_subject").when((name != "") & s.contains(name), "self").otherwise("third_party")


def bucket_count(n: Column) -> Column:
    """0 to 4 as they are, more as 5+."""
    return F.when(n >= 5, "5+").otherwise(n.cast("string"))


def model_family(probe: Column) -> Column:
    """nvidia, gpt, step or qwen, in this order of precedence; other labels as they are; blank is unknown."""
    p = F.lower(F.trim(F.coalesce(probe, F.lit(""))))
    word = lambda w: p.rlike(rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)")
    return (
        F.when(p == "", "unknown").when(p.contains("nvidia") | p.contains("nemotron"), "nvidia")
        .when(p.contains("gpt-oss") | p.contains("gpt_oss") | word("gpt"), "gpt").when(p.contains("stepfun") | word("step"), "step").when(p.contains("qwen"), "qwen").otherwise(p)
    )


def person_names(value: Column) -> Column:
    """Distinct names of two capitalised words or more, from segments joined by the word and; each up to its comma, without a title."""
    cut = F.transform(F.split(F.coalesce(value, F.lit("")), r"\band\b"), lambda s: F.regexp_replace(F.trim(strip_title(F.trim(F.split(s, ",").getItem(0)))), r"\s+", " "))
    return F.array_distinct(F.filter(cut, lambda n: n.rlike(r"^\p{Lu}\S*(?: \p{Lu}\S*)+$")))


def abs_threshold(total: int, pct: float) -> int:
    """Least number of samples from which a name is over-represented: a share, rounded up, one at least."""
    return max(math.ceil(total * pct / 100.0), 1) if total > 0 else 1


def frequent_names(df: DataFrame, names: Column, least: int) -> DataFrame:
    """name, n of the names that at least so many rows have; a row counts a name once."""
    return df.select(F.explode(F.array_distinct(names)).alias("name")).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def first_last(name: Column) -> tuple[Column, Column]:
    """Lower-cased first and last word of a name without its title; a single word is a first name."""
    parts = F.split(lead_name(name), " ")
    return F.nullif(parts.getItem(0), F.lit("")), F.when(F.size(parts) > 1, F.element_at(parts, -1))


def origin_and_gender(df: DataFrame, name: str, last: DataFrame, first: DataFrame) -> DataFrame:
    """df with origin by last name and gender by first name from a name bank's tables (last: name, origin; first: name, gender); anglo and male if unknown."""
    f, s = first_last(F.col(name))
    own = df.withColumns({"__first": f, "__last": s})
    own = own.join(last.select(F.col("name").alias("__last"), "origin"), "__last", "left").join(first.select(F.col("name").alias("__first"), "gender"), "__first", "left")
    return own.select(*df.columns, F.coalesce("origin", F.lit("anglo")).alias("origin"), F.coalesce("gender", F.lit("male")).alias("gender"))


def placeholders_in(text: Column, placeholders: list[str]) -> Column:
    """The placeholder names that a text has as whole words, in any case, in the order of the list."""
    x = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(x.rlike(rf"(?i)(?<!\w){re.escape(p)}(?!\w)"), p) for p in placeholders]))


def forced_names(names: Column, surnames: list[str]) -> Column:
    """The names whose surname is on a list, in any case."""
    return F.filter(names, lambda n: F.lower(F.element_at(F.split(F.trim(n), r"\s+"), -1)).isin([s.lower() for s in surnames]) & F.trim(n).rlike(r"\s"))
