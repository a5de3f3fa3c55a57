"""Token counts without ids: pieces once per distinct pre-token, joined to the documents' pre-token frequencies.

A sample of documents gives the head, the pre-tokens that are likely to be frequent; its table has at most HEAD rows
and HEAD_TOTAL bytes and is broadcast. Frequencies of all other pre-tokens are dealt by pre-token to the table
of their counts, made once per distinct pre-token. Which pre-tokens are in the head moves work, never results.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quillspark.llm.bpe import Memo, byte_alphabet
from quillspark.llm.common import bounded_batches, give_back, materialise, sample_order

#: Most rows of the broadcast table, their bytes together, and the longest pre-token in it.
HEAD, HEAD_TOTAL, HEAD_BYTES = 150_000, 8 << 20, 4096
#: Documents that are looked at to choose the head, about.
HEAD_SAMPLE = 12_000
#: How byte-level tokenizers part texts (a fixed pattern of the file format); letters first, which changes nothing, as no other branch starts with one.
PRETOKEN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cuts a task remembers.
MEMO = 100_000


class Splitter:
    """Cuts a text before each single blank that a pre-token starts with, and knows the pre-tokens of each cut."""

    def __init__(self, special: list[str]):
        self.find = regex.compile(PRETOKEN).findall
        self.cut = re.compile(r" (?=\S)").split
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def parts(self, text: str) -> tuple[int, Counter]:
        """Special tokens in the text, and how often each cut occurs; all but a text's first start with a blank."""
        n, found = 0, Counter()
        for k, plain in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                n += 1
            elif plain:
                first, *rest = plain.split(" ") if "  " not in plain else self.cut(plain)
                found.update([" " + x for x in rest] if len(rest) < 8 else map(" ".__add__, rest))
                if first:
                    found[first] += 1
        return n, found

    def pretokens(self, text: str) -> tuple[int, Counter]:
        n, parts = self.parts(text)
        found = Counter()
        for part, k in parts.items():
            for x in self.find(part):
                found[x] += k
        return n, found


class PieceCounter:
    """Pieces of single pre-tokens, by the file's own model."""

    def __init__(self, spec: str):
        self.model = Tokenizer.from_str(spec).model
        self.alphabet = byte_alphabet()

    def count(self, pretoken: str) -> int:
        return len(self.model.tokenize("".join([self.alphabet[b] for b in pretoken.encode()])))


@lru_cache(maxsize=2)
def counter(spec: str) -> PieceCounter:
    return PieceCounter(spec)


def specials(spec: str) -> list[str]:
    return sorted((t["content"] for t in json.loads(spec)["added_tokens"]), key=len, reverse=True)


def head_table(docs: DataFrame, spec: str, text_col: str, names: list[str]) -> dict[str, int]:
    """Piece counts of the pre-tokens that are frequent in a sample of documents: a bounded table."""
    n = docs.count()
    share = docs if n <= HEAD_SAMPLE else docs.where(sample_order(*names) < int(2**32 * HEAD_SAMPLE / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = Splitter(specials(spec)), Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(split.pretokens(text.as_py() or "")[1])
        got = [(x, k) for x, k in found.items() if len(x.encode()) <= HEAD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([k for _, k in got], pa.int64())], names=["pretoken", "k"])
        del found, got
        give_back()

    rows = share.select(text_col).mapInArrow(run, "pretoken string, k long").groupBy("pretoken").agg(F.sum("k").alias("k")).where("k > 1")
    count, left, out = PieceCounter(spec).count, HEAD_TOTAL, {}
    for r in rows.orderBy(F.desc("k"), "pretoken").limit(HEAD).select("pretoken").toLocalIterator():
        left -= len(r.pretoken.encode())
        if left >= 0:
            out[r.pretoken] = count(r.pretoken)
    return out


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens above limit). No ids are made.

    A null or empty text has 0 bytes and 0 tokens. Equal rows are counted one by one. Ids may be null or repeat.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    flat = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = spark.sparkContext.broadcast((spec, head_table(flat, spec, "text", ["doc_id"])))
    schema = T.StructType([flat.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_head long, rest array<struct<pretoken: string, k: long>>").fields])
    pair = pa.struct([("pretoken", pa.string()), ("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, head = shared.value
        split = Splitter(specials(spec))
        memo = Memo(MEMO)
        for batch in batches:
            n_bytes, n_head, rest = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n, parts = split.parts(text)
                tail: dict[str, int] = {}
                for part, k in parts.items():
                    if (known := memo.get(part)) is None:
                        found = split.find(part)
                        known = sum(head.get(x, 0) for x in found), tuple(x for x in found if x not in head)
                        if len(part) <= 64:
                            memo.put(part, known)
                    n += k * known[0]
                    for x in known[1]:
                        tail[x] = tail.get(x, 0) + k
                n_bytes.append(len(text.encode()))
                n_head.append(n)
                rest.append([{"pretoken": x, "k": k} for x, k in tail.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_head, pa.int64()), pa.array(rest, pa.list_(pair))], names=schema.names)
        del memo
        give_back()

    base = materialise(flat.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "pretokens")
    tail = base.select("row", F.explode("rest").alias("x")).select("row", "x.pretoken", "x.k")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value[0]).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(x.as_py()) for x in batch.column(0)], pa.int64())], names=["pretoken", "n"])
        counter.cache_clear()
        del count
        give_back()

    known = tail.select("pretoken").distinct().mapInArrow(pieces, "pretoken string, n long")
    sums = tail.join(known, "pretoken").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("n_tail"))
    total = F.col("n_head") + F.coalesce("n_tail", F.lit(0))
    return base.drop("rest").join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
