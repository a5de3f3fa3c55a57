"""Language identification in two steps: the family first, then one-versus-one linear SVMs among its languages.

Features are hashed byte n-grams of length 1 to 3 over the lower-cased letters of the whole text, with square-rooted
counts and unit length. Families part languages that are far from each other; within a family each pair of languages
has its own machine, trained on those two alone, so that close relatives are told apart by what separates just them.

Training takes a sample of labelled rows, PER_LANGUAGE of each language at most and SAMPLE in all, dealt evenly to all
languages that occur, however many; prediction covers every row in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import bounded_batches, give_back, held_out, read_table, sample_order

#: Bounds of the training sample.
PER_LANGUAGE, SAMPLE = 400, 12_800
#: Hash buckets of n-grams.
BUCKETS = 1 << 13
#: Language code -> family. A code that isn't listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "da": "germanic", "sv": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}
NOT_LETTERS = re.compile(r"[\W\d_]+")


def features(text: str) -> np.ndarray:
    """A unit vector of hashed n-gram counts over the text's words, each between blanks; zero without a letter."""
    plain = f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "
    b = np.frombuffer(plain.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if b.size < 3:
        return np.zeros(BUCKETS, dtype=np.float32)
    two = b[:-1] * 257 + b[1:] + 7919
    three = two[:-1] * 263 + b[2:] + 104_729
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for grams in (b, two, three):
        counts += np.bincount(((grams * np.uint32(2_654_435_761)) >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    v = np.sqrt(counts.astype(np.float32))
    return v / np.float32(np.linalg.norm(v))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """A linear SVM with squared hinge loss and a bias as last weight, by accelerated gradient steps. Deterministic.

    y is 1 or -1.
    """
    weight = np.select([y > 0, y < 0], [0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())]).astype(np.float32) * np.float32(c)
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    v, step = w.copy(), np.float32(1 / (1 + 4 * c))
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        grad = np.append(v[:-1] - 2 * (gap @ x), -2 * gap.sum()).astype(np.float32)
        new = v - step * grad
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


class LanguageModel:
    """Weights for families (one against the rest) and, inside each, for pairs of languages."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, families: dict[str, str] = FAMILIES):
        self.languages = languages
        family = [families.get(c, c) for c in languages]
        self.families = sorted(set(family))
        self.members = [[k for k, f in enumerate(family) if f == name] for name in self.families]
        of = np.array([self.families.index(f) for f in family])[y] if len(y) else y
        rows = [train_svm(x, np.where(of == f, 1, -1).astype(np.float32)) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        for a, b in self.pairs:
            own = np.flatnonzero((y == a) | (y == b))
            rows.append(train_svm(x[own], np.where(y[own] == a, 1, -1).astype(np.float32)))
        self.weights = np.array(rows, dtype=np.float32).reshape(len(rows), BUCKETS + 1)

    def predict(self, x: np.ndarray) -> tuple[int, float]:
        """The language's place in the list, and a score: the product of how sure the family and its language are."""
        s = self.weights[:, :-1] @ x + self.weights[:, -1]
        n = len(self.families) if len(self.families) > 1 else 0
        f = int(s[:n].argmax()) if n else 0
        sure = 1 / (1 + np.exp(-3 * s[f])) if n else 1.0
        members = self.members[f]
        votes = dict.fromkeys(members, 0.0)
        for (a, b), m in zip(self.pairs, s[n:], strict=True):
            if a in votes and b in votes:
                p = 1 / (1 + np.exp(-3 * m))
                votes[a] += p + (m >= 0)
                votes[b] += 1 - p + (m < 0)
        best = max(members, key=votes.__getitem__)
        if len(members) > 1:
            sure *= votes[best] / (2 * (len(members) - 1))
        return best, float(min(1.0, max(0.0, sure)))


def fit(docs: DataFrame, text_col: str, lang_col: str, order: list[str], per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Train on at most per_language rows of each language and SAMPLE rows in all; only sparse features reach the driver."""
    sizes = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}
    per_language = max(1, min(per_language, SAMPLE // max(1, len(sizes))))
    cuts = [(lang, 1 << 32 if n <= per_language else int(2**32 * per_language / n) + 1) for lang, n in sizes.items()]
    cut = F.broadcast(docs.sparkSession.createDataFrame(cuts, "__lang string, __cut long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column(2)]
            at = [np.flatnonzero(v) for v in found]
            arrays = [pa.array([k.astype(np.int16).tobytes() for k in at], pa.binary()), pa.array([v[k].tobytes() for v, k in zip(found, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["o", "lang", "at", "v"])

    ordered = docs.withColumn("__order", sample_order(*order))
    chosen = ordered.join(cut, (F.col(lang_col) == F.col("__lang")) & (F.col("__order") < F.col("__cut"))).select("__order", lang_col, text_col)
    found = chosen.mapInArrow(run, "o long, lang string, at binary, v binary").toArrow()
    languages, kept, seen = sorted(sizes), [], {}
    for lang, o, at, v in sorted(zip(*[found.column(c).to_pylist() for c in ("lang", "o", "at", "v")], strict=True)):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= per_language and at:
            kept.append((lang, at, v))
    x = np.zeros((len(kept), BUCKETS), dtype=np.float32)
    for k, (_, at, v) in enumerate(kept):
        x[k, np.frombuffer(at, dtype=np.int16)] = np.frombuffer(v, dtype=np.float32)
    model = LanguageModel(languages, x, np.array([languages.index(lang) for lang, _, _ in kept], dtype=np.int64))
    del found, kept, x
    give_back()
    return model


def identify(docs: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "lang", order: list[str] | None = None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the language and a score from 0 to 1.

    train: rows to learn from; those without a text or a language don't count, and order names the columns that fix the
    sample (doc_id). A null text, or one without a letter, is `und` with score 0. With no row to learn from, every row
    is `und`. docs must not have columns named label or score. Equal texts get equal answers; no shuffle of docs.
    """
    bounded_batches(docs.sparkSession)
    known = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    model = fit(known, text_col, lang_col, order or ["doc_id"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(place):
                text = text.as_py()
                x = features(text) if text and model.languages and any(map(str.isalpha, text)) else None
                k, s = model.predict(x) if x is not None else (-1, 0.0)
                langs.append(model.languages[k] if k >= 0 else "und")
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from the rows that aren't held out."""
    flat = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    train = docs.where(~held_out("doc_id")).select("doc_id", "text", "lang")
    return identify(flat, train).drop("text")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language_query over documents: every row, whole texts. Null texts and those without a letter are `und` with score 0; equal
    texts get equal answers, also among repeated rows; of languages with equal votes the first by code is taken."""
    return language_query(read_table(spark, sf_dir, "documents"))
