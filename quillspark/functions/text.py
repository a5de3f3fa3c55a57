"""Text functions as column expressions. White space and word classes are the ASCII ones unless a function says otherwise."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode dashes that become "-".
DASHES = "‐‑‒–—−"
#: URLs, and what may stand behind one in prose without being part of it.
URL = r"https?://[^\s\"\\)>,]+"
URL_TAIL = ".,:;)>]}"
#: Verdict patterns from strict to permissive; the last match of the first that matches counts.
YES_NO = [
    r"(?im)^\s*\*{0,2}\s*(?:Final\s+)?Answer\s*:?\s*\*{0,2}\s*(Yes|No)\b",
    r"(?im)^\s*\*{0,2}\s*(Yes|No)\s*\*{0,2}\s*\.?\s*$",
    r"(?i)(?:answer|verdict|judgment|conclusion|decision)\s*(?:is|:)\s*\*{0,2}\s*(Yes|No)\b",
    r"(?i)\b(Yes|No)\b",
]
#: A score line of its own, and a score anywhere.
SCORE_LINE = r"(?im)^\s*score\s*[:=]\s*(-?[0-2])\s*$"
SIGNED_SCORE = r"(?i)\bscore\b\s*[:=]\s*([-+]?\d+)\b"
#: The border of an ASCII word.
BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Words of a payload.
PAYLOAD_WORD = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"


def normalize_text(x: Column) -> Column:
    """Null as empty, trimmed, one blank for white space."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def normalize_key(x: Column) -> Column:
    """snake_case of a key in any case."""
    split = F.regexp_replace(normalize_text(x), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.translate(F.lower(split), "- ", "__"), r"[^a-z0-9_]", "")


def normalize_list(xs: Column) -> Column:
    """Normalized, non-empty, distinct in order of appearance."""
    return F.array_distinct(F.filter(F.transform(xs, normalize_text), lambda x: x != ""))


def slug(x: Column, default: str = "model") -> Column:
    out = F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.when(out == "", default).otherwise(out)


def words(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def truncate_words(x: Column, most: int) -> Column:
    """The first words and a note of how many were left out; shorter texts as they are."""
    own = words(x)
    cut = F.concat(F.array_join(F.slice(own, 1, most), " "), F.lit(" [... "), (F.size(own) - most).cast("string"), F.lit(" words omitted]"))
    return F.when(F.size(own) > most, cut).otherwise(x)


def hyphens(x: Column) -> Column:
    return F.translate(x, DASHES, "-" * len(DASHES))


def ascii_fold(x: Column) -> Column:
    """Characters by their compatible decomposition, and of that what is ASCII: letters lose their marks. An Arrow function."""

    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")

    return F.pandas_udf(fold, "string")(x)


def payload_words(x: Column) -> Column:
    """Words of a plain text; parsers.payload_words walks completions that are JSON."""
    return F.size(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(PAYLOAD_WORD), F.lit(0)))


def urls(x: Column) -> Column:
    """Distinct URLs of a text without punctuation behind them."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(URL_TAIL))))


def ascii_rules(pattern: str) -> str:
    """A pattern for Java by the rules of SQL: borders are those of ASCII words (Java's \\b counts letters of any script), white space has no vertical tab, and "ſ" and the Kelvin sign are an s and a k in any case."""
    other = {r"\b": BORDER, r"\s": r"[\t\n\f\r ]"} | ({"s": "[sſ]", "S": "[Sſ]", "k": "[k\u212a]", "K": "[K\u212a]"} if pattern.startswith("(?i)") else {})
    return re.sub(r"\(\?i\)|\\.|[sSkK]", lambda m: other.get(m[0], m[0]), pattern)


def beginnings(pattern: str) -> list[str]:
    """Strings in small letters, one of which starts any match of a pattern; none if that can't be told."""
    body = pattern.removeprefix("(?i)").removeprefix(r"\b")
    m = re.fullmatch(r"\(\?:((?:[^()]|\(\?:[^()]*\)\??)*)\)(?:\\b)?", body)
    parts = re.split(r"\|(?![^()]*\))", m[1] if m else body)
    if re.search(r"\\[()]|\[", body) or (len(parts) > 1 and not m):
        return []
    heads = [re.match(r"(?:[a-z ](?![?*+{]))*", p)[0] for p in parts]
    return heads if all(heads) else []


def signals(x: Column, patterns: dict[str, str]) -> Column:
    """Labels of the patterns that a text matches anywhere, in the order of the table, by ascii_rules; none for null.

    A pattern is tried only on texts that have one of its beginnings, in any case; a lambda holds the folded text, so that it
    is made once and not for each pattern.
    """

    def labels(t: Column) -> Column:
        found = []
        for label, pattern in patterns.items():
            fits = t["text"].rlike(ascii_rules(pattern))
            if heads := beginnings(pattern):
                fits = reduce(or_, [t["small"].contains(h) for h in heads]) & fits
            found.append(F.when(fits, label))
        return F.array_compact(F.array(*found))

    small = F.lower(F.replace(x, F.lit("ſ"), F.lit("s")))
    return F.transform(F.array(F.struct(x.alias("text"), small.alias("small"))), labels).getItem(0)


def strip_reasoning(x: Column) -> Column:
    """Text without think blocks and code fences."""
    out = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?s)<think>.*?</think>\s*", "")
    return F.regexp_replace(F.regexp_replace(out, r"```json\s*", ""), r"```\s*", "")


def last_match(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's last match, by ascii_rules for borders."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern.replace(r"\b", BORDER)), F.lit(group)), F.lit(-1))


def yes_no(x: Column) -> Column:
    plain = strip_reasoning(x)
    return F.lower(F.coalesce(*[last_match(plain, p) for p in YES_NO])) == "yes"


def json_score(x: Column) -> Column:
    """The score field of the first braces in a text, if it is a whole number from -2 to 2."""
    value = F.get_json_object(F.regexp_extract(x, r"(?s)(\{.*?\})", 1), "$.score")
    return F.when(value.rlike(r"^-?[0-2]$"), value.cast("int"))


def pairwise_score(x: Column) -> Column:
    """Score -2 to 2 of a judge's text: the last score line, else a JSON object's field, else the last line of the raw text."""
    plain = strip_reasoning(x)
    return F.coalesce(last_match(plain, SCORE_LINE).cast("int"), json_score(plain), last_match(F.coalesce(x, F.lit("")), SCORE_LINE).cast("int"))


def signed_score(x: Column, low: int = -2, high: int = 2) -> Column:
    """The last score of the stripped text, else of the raw text, that is in range."""
    found = [F.when((v.cast("bigint") >= low) & (v.cast("bigint") <= high), v.cast("int")) for v in (last_match(strip_reasoning(x), SIGNED_SCORE), last_match(F.coalesce(x, F.lit("")), SIGNED_SCORE))]
    return F.coalesce(*found)


def pass_flag(x: Column) -> Column:
    """Whether a flag in words means yes; anything else is no."""
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("true", "yes", "y", "1", "pass", "passed")


def strict_flag(x: Column) -> Column:
    """yes, true, 1 or no, false, 0; null otherwise."""
    plain = F.lower(F.trim(x))
    return F.when(plain.isin("yes", "true", "1"), True).when(plain.isin("no", "false", "0"), False)


def email_parts(name: Column, email: Column) -> Column:
    """prefix, surname token, digits, rest and domain of an address that starts with the first name or its initial; else null.

    Names are compared without marks on their letters. The domain starts behind the first @.
    """
    n = F.split(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), " ")
    fold = lambda x: F.regexp_replace(F.lower(ascii_fold(x)), r"[^a-z0-9]+", "")
    first, last = fold(n.getItem(0)), fold(F.element_at(n, -1))
    mail = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    local = F.substring_index(mail, "@", 1)
    domain = F.substr(mail, F.length(local) + 2)
    pattern = r"^([a-z0-9]+)([._-])([a-z]+)(\d*)((?:[._-][a-z0-9]+)*)$"
    part = lambda k: F.regexp_extract(local, pattern, k)
    ok = mail.contains("@") & (F.size(n) >= 2) & (F.length(first) >= 2) & (F.length(last) >= 3) & (F.length(part(3)) >= 3) & ((part(1) == first) | (part(1) == F.substring(first, 1, 1)))
    return F.when(ok, F.struct(part(1).alias("prefix"), part(2).alias("sep"), part(3).alias("surname"), part(4).alias("digits"), part(5).alias("rest"), domain.alias("domain"), last.alias("last")))


def append_once(text: Column, suffix: str) -> Column:
    """Text with a suffix on a paragraph of its own, unless it is there."""
    return F.when(text.contains(suffix), text).otherwise(F.concat(text, F.lit("\n\n" + suffix)))


def chat_parts(prompt: Column) -> Column:
    """System and user part of a prompt around the first line of ===; without one all is the user's."""
    parts = F.split(prompt, "\n===\n", 2)
    return F.when(F.size(parts) == 2, F.struct(F.trim(parts.getItem(0)).alias("system"), F.trim(parts.getItem(1)).alias("user"))).otherwise(F.struct(F.lit(None).cast("string").alias("system"), F.trim(prompt).alias("user")))


def render(template: str, values: dict[str, Column]) -> Column:
    """$name placeholders replaced (unknown ones stay), three line ends or more cut to two."""
    out = F.lit(template)
    for name in sorted(values, key=len, reverse=True):
        out = F.replace(out, F.lit("$" + name), F.coalesce(values[name], F.lit("")))
    return F.regexp_replace(out, r"\n{3,}", "\n\n")
