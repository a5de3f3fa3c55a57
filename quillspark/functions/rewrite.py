"""Rewriting of names and identifiers in texts: kernels over one row's plan, and their Arrow UDFs over DataFrames."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cased(old: str, new: str) -> str:
    """new in the case pattern of old: all upper, all lower, or as given."""
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new.lower() if old.islower() else new


def handles(full: str) -> list[str]:
    """Forms that handles and addresses take from a name: parts joined by ., _, - or nothing, and initial with surname."""
    first, last = full.split()[0].lower(), re.sub(r"\s+", "", " ".join(full.split()[1:])).lower()
    return [f"{first}{sep}{last}" for sep in (".", "_", "-", "")] + [f"{first[0]}{sep}{last}" for sep in (".", "_", "-", "")] if last else []


def name_rules(plan: dict[str, str]) -> list[tuple[re.Pattern[str], str]]:
    """Patterns and replacements of a row's plan (old full name -> new), longest first.

    A first name alone is replaced only if one name of the row has it.
    """
    firsts = [n.split()[0].lower() for n in plan]
    rules: dict[str, str] = {}
    for old, new in plan.items():
        rules[old] = new
        rules |= dict(zip(handles(old), handles(new), strict=False))
        if firsts.count(old.split()[0].lower()) == 1:
            rules.setdefault(old.split()[0], new.split()[0])
    spaced = lambda x: r"\s+".join(map(re.escape, x.split()))
    return [(re.compile(rf"(?<![A-Za-z0-9]){spaced(old)}(?![A-Za-z])", re.IGNORECASE), new) for old, new in sorted(rules.items(), key=lambda r: (-len(r[0]), r[0]))]


def _plain(text: str, rules: list[tuple[re.Pattern[str], str]]) -> str:
    """One pass for all rules, so that no replacement is replaced again."""
    spans: list[tuple[int, int, str]] = []
    for pattern, new in rules:
        for m in pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b, _ in spans):
                spans.append((m.start(), m.end(), cased(m.group(), new)))
    out, at = [], 0
    for a, b, new in sorted(spans):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def _walk(value: Any, rules: list[tuple[re.Pattern[str], str]]) -> Any:
    if isinstance(value, str):
        return rewrite(value, rules)
    if isinstance(value, list):
        return [_walk(x, rules) for x in value]
    return {k: _walk(x, rules) for k, x in value.items()} if isinstance(value, dict) else value


def rewrite(text: str, rules: list[tuple[re.Pattern[str], str]]) -> str:
    """Names in a text replaced. JSON, and JSON line by line, is parsed and rewritten inside its strings."""
    lines = text.split("\n")
    if any(x.lstrip()[:1] in ("{", "[") for x in lines):
        out = []
        for line in lines:
            try:
                out.append(json.dumps(_walk(json.loads(line), rules), ensure_ascii=False) if line.strip()[:1] in ("{", "[") else _plain(line, rules))
            except ValueError:
                out.append(_plain(line, rules))
        return "\n".join(out)
    return _plain(text, rules)


def replace_names(text: str | None, plan: dict[str, str]) -> str | None:
    return rewrite(text, name_rules(plan)) if text and plan else text


def shape(value: str) -> str:
    """A pattern of values of the same format: digits by digits, letters by letters."""
    parts = ((r"\d" if c.isdigit() else "[A-Za-z]" if c.isalpha() else re.escape(c)) for c in value)
    return r"(?<![A-Za-z0-9])" + "".join(parts) + r"(?![A-Za-z0-9])"


def reconcile(canonical: list[str], sources: list[str], text: str, reach: int = 300) -> str:
    """Strays of a missing canonical identifier's format replaced by it: pairs with most context words in common first, each used once."""
    words = lambda t: {w.lower() for w in re.findall(r"[A-Za-z]{4,}", t)}
    near = lambda t, a, b: words(t[max(0, a - reach) : a] + " " + t[b : b + reach])
    known = set(canonical)
    pairs = []
    for k, (value, source) in enumerate(zip(canonical, sources, strict=True)):
        if value in text:
            continue
        own = words(source)
        for m in re.finditer(shape(value), text):
            if m.group() not in known:
                pairs.append((-len(own & near(text, m.start(), m.end())), m.start(), k, m.group()))
    used, gone, plan = set(), set(), {}
    for _, _, k, stray in sorted(pairs):
        if k not in used and stray not in gone:
            used.add(k)
            gone.add(stray)
            plan[stray] = canonical[k]
    for stray in sorted(plan, key=len, reverse=True):
        text = re.sub(r"(?<![A-Za-z0-9])" + re.escape(stray) + r"(?![A-Za-z0-9])", plan[stray], text)
    return text


def rewrite_names(df: DataFrame, plan: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with names replaced in text columns, row by row: plan has (key, name, replacement). Rows without a plan stay as they are."""
    plans = plan.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("name", "replacement"))).alias("__plan"))

    @F.pandas_udf("string")
    def run(texts: pd.Series, plans: pd.Series) -> pd.Series:
        return pd.Series([replace_names(t, dict(p)) if p is not None and isinstance(t, str) else t for t, p in zip(texts, plans, strict=True)], dtype=object)

    out = df.join(plans, key, "left")
    return out.withColumns({c: F.when(F.col("__plan").isNull(), F.col(c)).otherwise(run(F.col(c), F.col("__plan"))) for c in columns}).select(*df.columns)


def reconciled(df: DataFrame, canonical: str, sources: str, text: str, out: str) -> DataFrame:
    """df with out: the text with strays of missing canonical identifiers replaced. canonical, sources: arrays side by side; text null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series, origins: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([reconcile(list(v), list(o), t) if isinstance(t, str) and v is not None and len(v) else t for v, o, t in zip(values, origins, texts, strict=True)], dtype=object)

    return df.withColumn(out, run(F.col(canonical), F.col(sources), F.col(text)))
