"""A corpus pipeline of five stages: toxicity, language, near duplicates, benchmark decontamination, BPE.

Each stage takes all rows that its predecessor kept; all but the last return the columns of documents. run() applies
them to a folder's documents, each stage written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, language, neardup, toxicity
from quillspark.llm.common import few, held_out, materialise, read_table

#: Scores from which a document is toxic, and below which its language is uncertain.
TOXIC, UNCERTAIN = 0.3, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC; learns from labelled documents that aren't held out.

    Null and empty texts have the score of a text without toxic tokens; repeated rows stay or go together.
    """
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    model = toxicity.fit(docs, labels)
    return toxicity.score_toxicity(docs, model, score="__score").where(F.col("__score") < TOXIC).drop("__score")


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows: neither without a letter (null and empty texts go) nor with a score below UNCERTAIN."""
    found = language.identify(docs, docs.where(~held_out("doc_id")), label="__lang", score="__score")
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= UNCERTAIN)).drop("__lang", "__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity of 0.8 or more.

    Texts without a word stay. Rows that repeat an id and text leave one row; of ties the least id stays.
    """
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaking window of any benchmark item. Rows without an id are judged by their texts alone.

    Null, empty and short texts stay; repeated rows stay or go together.
    """
    keyed = docs.withColumn("__key", neardup.row_id(docs["doc_id"], docs["text"]))
    leaks = materialise(decontaminate.find_leaks(keyed, read_table(spark, sf_dir, "benchmark"), id_col="__key").select(F.col("doc_id").alias("__key")).distinct(), "leaks")
    return keyed.join(few(leaks), "__key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and digests of ids and decoded text of each document. Null and empty texts have no token."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: None of the stages can be told in SQL as a whole; tests hold them against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
