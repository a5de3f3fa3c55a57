"""Identifiers across samples: scan, first owner of each value, replacement of lazy or reused values; URL and link predicates."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.patterns import ATTACHMENT_PHRASES, IDENTIFIERS, INSTRUCTION_DOC_WORDS, JUDGE_LINK_WORDS, LAZY_DIGITS


def scan(df: DataFrame, pos: str, text: str) -> DataFrame:
    """pos, kind, value: each distinct identifier of each row."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0))).alias("values")) for k, p in IDENTIFIERS])
    return df.select(F.col(pos).alias("pos"), F.explode(kinds).alias("s")).select("pos", "s.kind", F.explode("s.values").alias("value"))


def owners(found: DataFrame, across: bool = True) -> DataFrame:
    """kind, value, owner (the first position that has it), samples. Values with the same digits are one, whatever their kind and format, unless across is false."""
    if not across:
        return found.groupBy("kind", "value").agg(F.min("pos").alias("owner"), F.countDistinct("pos").alias("samples"))
    keyed = found.withColumn("digits", same_digits(F.col("value")))
    first = keyed.groupBy("digits").agg(F.min("pos").alias("owner"), F.countDistinct("pos").alias("samples"))
    return keyed.select("kind", "value", "digits").distinct().join(first, "digits").select("kind", "value", "owner", "samples")


def same_digits(value: Column) -> Column:
    """What makes two identifiers the same: their digits, or the whole value if it has none."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(digits == "", value).otherwise(digits)


def replacements(found: DataFrame, owned: DataFrame, seed: int = 7) -> DataFrame:
    """pos, value, replacement: for lazy digits, and for values that an earlier position owns. Same format, digits by hash."""
    digits = F.regexp_replace("value", r"\D", "")
    lazy = digits.isin(LAZY_DIGITS)
    own = found.join(owned.drop("samples"), ["kind", "value"]).where(lazy | (F.col("pos") != F.col("owner")))
    code = F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col("pos").cast("string"), F.col("value")), 256)
    fresh = F.translate(code, "abcdef", "123456")
    parts = F.split("value", "")
    chars = F.transform(F.filter(parts, lambda c: c != ""), lambda c, i: F.when(c.rlike(r"\d"), F.substring(fresh, i % 64 + 1, F.lit(1))).otherwise(c))
    return own.select("pos", "kind", "value", F.array_join(chars, "").alias("replacement"))


def apply_replacements(df: DataFrame, plan: DataFrame, pos: str, text: str) -> DataFrame:
    """df with each planned value of a row's text replaced, longest first so that no value cuts into another."""
    size = F.struct((-F.length("value")).alias("n"), "value", "replacement")
    maps = plan.groupBy(F.col("pos").alias(pos)).agg(F.array_sort(F.collect_set(size)).alias("__plan"))
    out = F.aggregate(F.coalesce("__plan", F.array().cast("array<struct<n:int,value:string,replacement:string>>")), F.col(text), lambda a, r: F.replace(a, r["value"], r["replacement"]))
    return df.join(maps, pos, "left").withColumn(text, out).drop("__plan")


def any_word(x: Column, values: list[str]) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.coalesce(*[F.when(low.contains(w), True) for w in values], F.lit(False))


def attachment_language(x: Column) -> Column:
    """Whether an action claims to attach something."""
    file = r"(?i)\battached\b[^.\n]{0,80}\b(?:file|document|pdf|spreadsheet|sheet|deck|slide(?:\s+deck)?|presentation|contract|invoice|report|screenshot|image|[\w./-]+\.(?:pdf|docx?|xlsx?|pptx?|zip|png|jpe?g|gif))\b"
    return any_word(x, ATTACHMENT_PHRASES) | F.coalesce(x, F.lit("")).rlike(file)


#: Requests to share a file or a link, judges that blame a file or a linked resource, links without a scheme.
FILE_REQUEST = [
    r"(?i)\b(?:attach|attached|attaching|attachment|share|shared|sharing|forward|forwarded|forwarding|upload|uploaded|uploading|enclose|enclosed|enclosing)\b",
    r"(?i)\b(?:send|email|forward)\b.{0,60}\b[\w./-]+\.(?:pdf|docx?|xlsx?|pptx?|zip)\b",
]
LINK_REQUEST = [
    r"(?i)\b(?:include|including|add|adding|share|sharing|post|posting|publish|publishing|provide|providing|send|sending|pull|pulling|get|getting|retrieve|retrieving)\b[^.?!;\n]{0,80}\b(?:a|the|this|that)?\s*(?:public|direct|sharepoint|google\s+drive|jira)?\s*(?:link|url)\b",
    r"(?i)\b(?:link|url)\s+to\b",
]
JUDGE_FILE = r"(?i)(?:the\s+)?(?:attached|attachment|shared file|shared document|shared folder|forwarded file|forwarded document|attached screenshot|attached pdf|attached spreadsheet|attached file)|(?:attachment|attached\s+\w+|shared\s+\w+|linked\s+\w+)\s+(?:contains?|includes?|reveals?|shows?|exposes?)"
JUDGE_LINK_ACCESS = r"(?i)\bby\s+(?:providing|sharing|posting)\s+(?:a|an|that|the)?\s*(?:public|direct)?\s*(?:link|url)\b[^.\n]{0,120}\b(?:access|accessible|exposes?|discloses?|leaks?)\b"
JUDGE_LINK_SHARE = r"(?i)\b(?:includes?|shares?|shared|posts?|posted|provid(?:e|es|ing)|adding|added)\b[^.\n]{0,100}\b(?:public|direct|internal|shared)?\s*(?:link|url)\b"
JUDGE_RESOURCE = r"(?i)\b(?:pdf|spreadsheet|sheet|report|document|file|folder|resume|bio(?:graphy)?|press kit|release notes|incident report|crash(?:-| )dump|milestone doc|google sheet)\b[^.\n]{0,140}\b(?:contains?|includes?|reveals?|exposes?|discloses?|gives access|becomes accessible|accessible to|allows?(?:[^.\n]{0,40})(?:access|view)|enables?(?:[^.\n]{0,40})access)\b"
BARE_LINK = r"(?i)\b(?:drive\.google\.com|docs\.google\.com|dropbox\.com|sharepoint\.[^\s\"'<>/]+|jira\.[^\s\"'<>/]+/browse/)[^\s\"'<>)]*"
RESOURCE_AT_URL = r"(?i)\b(?:review|see|check|refer(?:\s+to)?|look\s+at|access)\b[^.?!;\n]{0,120}\b(?:sheet|spreadsheet|doc(?:ument)?|file|folder|portal|page|bio|biography|press kit|case study|plan|rollout plan|report)\b[^.?!;\n]{0,80}\b(?:located at|at|via)\s*(?:https?://|drive\.google\.com|docs\.google\.com|dropbox\.com|sharepoint\.|jira\.)"
INCLUDE_FILE = r"(?i)\binclud(?:e|ed|ing)\b[^.?!;\n]{0,40}\b(?:the|this|that)?\s*(?:attached\s+)?(?:file|document|pdf|spreadsheet|sheet|deck|slide(?:\s+deck)?|presentation|media kit|attachment|[\w./-]+\.(?:pdf|docx?|xlsx?|pptx?|zip))\b"
SEND_FILE = r"(?i)\b(?:send|email|forward)\b.{0,60}\b(?:(?:latest|finalized|signed|updated|executed|enclosed)\s+(?:file|document|pdf|spreadsheet|sheet|deck|slide(?:\s+deck)?|presentation|contract|invoice|media kit|form|attachment)|(?:the|this|that)\s+(?:attached\s+)?(?:file|document|pdf|spreadsheet|sheet|deck|slide(?:\s+deck)?|presentation|media kit|attachment))\b"
FILE_REQUESTS, LINK_REQUESTS = [*FILE_REQUEST, INCLUDE_FILE, SEND_FILE], [*LINK_REQUEST, RESOURCE_AT_URL]
#: Keys of structured file references, how other such keys end, and references inside texts.
FILE_KEYS = [
    "attachment", "attachments", "attachment_id", "attachment_ids", "file", "files", "file_id", "file_ids", "document", "documents", "document_id", "document_ids",
    "report_id", "report_ids", "contract_id", "contract_ids", "invoice_id", "invoice_ids", "media_kit_id", "media_kit_ids",
]
FILE_KEY_END = r"(?:^|_)(?:attachment|file|document|report|contract|invoice|pdf|deck|slide)s?(?:_id|_ids)?$"
INLINE_FILE = r"(?i)!?\[[^\]]*\]\((?:/tmp/|/var/tmp/|[\w./-]+\.(?:png|jpe?g|gif|pdf|docx?|xlsx?|pptx?|zip))[^)]*\)|(?:^|[\s(])/(?:tmp|var/tmp)/[^\s\"')]+"


def file_references(x: Column) -> Column:
    """Whether a JSON text refers to files anywhere inside: a key of file references with a value that isn't empty, or such a reference in a string.

    Texts that are no JSON don't. The walk goes level by level over whatever is nested, Arrow batch by batch.
    """

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        key_end, inline, keys = re.compile(FILE_KEY_END), re.compile(INLINE_FILE), set(FILE_KEYS)

        def filled(value: object) -> bool:
            parts = [value]
            while parts:
                v = parts.pop()
                if isinstance(v, (list, dict)):
                    parts += v.values() if isinstance(v, dict) else v
                elif v.strip() if isinstance(v, str) else v:
                    return True
            return False

        def refers(text: object) -> bool:
            try:
                level = [json.loads(text)]
            except (TypeError, ValueError, RecursionError):
                return False
            while level:
                node = level.pop()
                if isinstance(node, str):
                    if inline.search(node):
                        return True
                elif isinstance(node, list):
                    level += node
                elif isinstance(node, dict):
                    if any((k.lower() in keys or key_end.search(k.lower())) and filled(v) for k, v in node.items()):
                        return True
                    level += node.values()
            return False

        return texts.map(refers).astype(bool)

    return run(x)


def matches(x: Column, patterns: list[str]) -> Column:
    plain = F.coalesce(x, F.lit(""))
    return F.coalesce(*[F.when(plain.rlike(p), True) for p in patterns], F.lit(False))


def link_passthrough(instruction: Column, action: Column, judge: Column, context: Column, sensitive: Column) -> Column:
    """Which of the paths A to D apply: a passed-on URL, a claimed attachment, a structured file reference, a requested link."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    about_doc = any_word(instruction, INSTRUCTION_DOC_WORDS) | (F.size(X.urls(instruction)) > 0)
    blames = any_word(judge, JUDGE_LINK_WORDS) | (F.size(X.urls(judge)) > 0)
    known = X.urls(F.concat_ws(" ", empty(context), empty(instruction), empty(sensitive)))
    shared = F.array_intersect(X.urls(action), known)
    a = (F.size(shared) > 0) & ((about_doc & blames) | F.arrays_overlap(shared, X.urls(sensitive)))
    b = attachment_language(action) & about_doc & blames
    c = file_references(action) & matches(judge, [JUDGE_FILE]) & matches(instruction, FILE_REQUESTS)
    judged = matches(judge, [JUDGE_LINK_ACCESS]) | (matches(judge, [JUDGE_LINK_SHARE]) & matches(judge, [JUDGE_RESOURCE]))
    d = ((F.size(X.urls(action)) > 0) | matches(action, [BARE_LINK])) & judged & matches(instruction, LINK_REQUESTS)
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in zip("ABCD", (a, b, c, d), strict=True)]))
