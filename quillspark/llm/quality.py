"""Quality rules: exact counts per text, and a hashed n-gram log-likelihood ratio of trusted texts against the corpus.

Both multinomials count hashed words and word pairs, the one over trusted documents, the other over all documents. A
document's ratio is the mean over its n-grams of log(p_trusted / p_corpus), so length does not matter; each document is
compared with one fixed threshold. All of it is DataFrame functions: the counts meet in BUCKETS rows, and scoring needs
no shuffle. A window of three words is known by a 64-bit hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import few, read_table

#: Hash buckets of the multinomials, and what is added to each count, as a share of the mean count.
BUCKETS, SMOOTHING = 10_000, 0.01
#: The least mean log-likelihood ratio of a text that is kept.
THRESHOLD = -0.1
#: Trusted ids up to this number, and few()'s bytes, are broadcast; beyond either the join shuffles.
BROADCAST_IDS = 500_000
#: Positions of longer texts don't fit beside a hash in 64 bits.
PACKED = 1 << 16
BLANKS = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"


def with_words(docs: DataFrame, text: str = "text", words: str = "words") -> DataFrame:
    """docs with the array of a text's words; explode() of the one array keeps Spark from computing it anew inside lambdas."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    found = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, SPLIT))
    return docs.withColumn(words, F.explode(F.array(found)))


def bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def ngram_buckets(words: str = "words") -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    w = F.col(words)
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: bucket(x, F.get(w, i + 1)))
    return F.concat(F.transform(w, lambda x: bucket(x)), pairs)


def fit_ratio(docs: DataFrame, trusted: DataFrame, text: str = "text", id_col: str = "doc_id") -> list[float]:
    """log(p_trusted / p_corpus) of each bucket, from one pass over all documents. trusted: ids, one column.

    Without a trusted document, or without a word in one, every ratio is 0, and so is every document's.
    """
    ids = trusted.select(trusted[trusted.columns[0]].alias("__id")).where("__id is not null").distinct()
    flat = docs.select(docs[id_col].alias("__id"), docs[text].alias("text"))
    known = flat.join(few(ids, BROADCAST_IDS).withColumn("t", F.lit(1)), "__id", "left")
    grams = with_words(known).select(F.coalesce("t", F.lit(0)).alias("t"), F.explode(ngram_buckets()).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("t")).collect()
    n, t = sum(r.n for r in rows), sum(r.t for r in rows)
    out = [0.0] * BUCKETS
    if t:
        for r in rows:
            a = SMOOTHING * t / BUCKETS
            b = SMOOTHING * n / BUCKETS
            out[r.b] = math.log((r.t + a) / (t * (1 + SMOOTHING))) - math.log((r.n + b) / (n * (1 + SMOOTHING)))
    return out


def mean_ratio(ratios: list[float], words: str = "words") -> Column:
    """The mean of the ratios of a text's n-grams; 0 without a word. The table, of fixed size, is a literal."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    w = F.col(words)
    n = 2 * F.size(w) - 1
    first = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.get(table, bucket(x)))
    pairs = F.aggregate(
        F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.get(table, bucket(x, F.get(w, i + 1)))),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return F.when(F.size(w) > 0, (first + pairs) / n).otherwise(F.lit(0.0))


def with_repeats(docs: DataFrame, words: str = "words") -> DataFrame:
    """docs with n_repeat_words: words in windows of three words that occur twice or more in the text.

    Windows are hashed; only texts with an equal pair of hashes go on. There the hashes are sorted together with their
    positions, neighbours of equal hash are repeated windows, and a pass over their positions counts covered words once.
    """
    w = F.col(words)
    hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    df = docs.withColumn("__h", F.explode(F.array(hashes)))
    h = F.col("__h")
    some = F.size(F.array_distinct(h)) < F.size(h)
    high = lambda x: F.shiftleft(F.shiftright(x, 16), 16)
    packed = F.sort_array(F.transform(h, lambda x, i: high(x).bitwiseOR(i.cast("long"))))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__s", F.explode(F.array(F.when(some & (F.size(h) < PACKED), packed).otherwise(none))))
    s = F.col("__s")
    at = lambda x: x.bitwiseAND(F.lit(PACKED - 1)).cast("int")
    same = lambda x, y: F.coalesce(F.get(h, at(x)) == F.get(h, at(y)), F.lit(False))
    found = F.filter(F.transform(s, lambda x, i: F.when(F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(False) | same(x, F.get(s, i + 1)), at(x))), lambda x: x.isNotNull())
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    nothing = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.withColumn("__l", F.explode(F.array(F.when(some & (F.size(h) >= PACKED), pairs).otherwise(nothing))))
    p = F.col("__l")
    long = F.filter(F.transform(p, lambda x, i: F.when(F.coalesce(F.when(i > 0, x["h"] == F.get(p, i - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False)), x["p"])), lambda x: x.isNotNull())
    positions = F.sort_array(F.concat(F.when(F.size(s) > 0, found).otherwise(F.array().cast("array<int>")), F.when(F.size(p) > 0, long).otherwise(F.array().cast("array<int>"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(positions, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")))
    return df.withColumn("n_repeat_words", F.when(some, covered["n"]).otherwise(F.lit(0).cast("long"))).drop("__h", "__s", "__l")


def quality_rules(docs: DataFrame, ratios: list[float], text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: the columns in keep (doc_id), the counts, base_failed, llr and kept.

    A null text has no word and no line. A text fails the base rules with fewer than 50 words, or if more than half of
    its words are in repeated windows; kept texts pass these and have a mean log-likelihood ratio of at least threshold.
    """
    keep = ["doc_id"] if keep is None else keep
    own = [f"__k{i}" for i in range(len(keep))]
    df = with_words(docs.select(*[docs[c].alias(k) for c, k in zip(keep, own, strict=True)], docs[text].alias("__text")), "__text", "__words")
    df = with_repeats(df, "__words")
    t, w = F.coalesce("__text", F.lit("")), F.col("__words")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    n = F.size(w).cast("long")
    df = df.withColumn("__lines", F.explode(F.array(lines))).select(
        *[F.col(k).alias(c) for c, k in zip(keep, own, strict=True)],
        n.alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        mean_ratio(ratios, "__words").alias("llr"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules of all documents, trusted ones by labels.quality: one row each, repeated rows included. Null and empty texts have
    no word, fail the base rules and have ratio 0; a ratio equal to the threshold is kept; an empty table gives no row."""
    docs = read_table(spark, sf_dir, "documents")
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(docs, fit_ratio(docs, trusted))
