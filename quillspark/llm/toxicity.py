"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, so the tokens to learn from are labelled first: a token of a toxic document is toxic if one of
its features (the word, its prefixes and suffixes) is in far more toxic than clean documents, by a log-likelihood ratio
test. The chain has two states; a token's features give the score of the toxic one, four transition weights tie
neighbours. Forward and backward passes give each token's marginal. A document's score is a logistic function of the
expected number of toxic tokens, the largest marginal and the share of toxic tokens. Spans are runs of tokens with a marginal of at least one half.

Learning takes a sample of labelled documents, short or long: TOXIC + CLEAN of them at most, in a fixed order until they
have SAMPLE_CHARS characters, and of their segments SEGMENTS at most. Every document is scored over its whole text, in
one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.bpe import Memo
from quillspark.llm.common import bounded_batches, give_back, held_out, materialise, read_table, sample_order

#: Bounds of the sample to learn from.
TOXIC, CLEAN, SAMPLE_CHARS = 2000, 4000, 24_000_000
BUCKETS = 1 << 18
#: A feature's log-likelihood ratio from which its tokens count as toxic (about one false feature in 10,000).
EVIDENCE = 16.0
SEGMENT, SEGMENTS = 32, 24_000
#: Cuts a task remembers; documents and places (documents times the longest one's tokens) per block of the two passes.
MEMO, BLOCK, CELLS = 100_000, 256, 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hash buckets of a lower-cased word, its prefixes of 2 to 8 letters and its suffixes of 2 to 4."""
    raw = [f"w{word}", *[f"p{word[:k]}" for k in range(2, 9) if k <= len(word)], *[f"s{word[-k:]}" for k in range(2, 5) if k <= len(word)]]
    return [1 + crc32(x.encode("utf-8", "replace")) % (BUCKETS - 1) for x in raw]


WIDTH = 11
#: Hashes of the letters that stand before words, prefixes and suffixes, from which theirs go on.
WORD_SEED, PREFIX_SEED, SUFFIX_SEED, MOD = crc32(b"w"), crc32(b"p"), crc32(b"s"), BUCKETS - 1


class ChainModel:
    def __init__(self) -> None:
        self.w = np.zeros(BUCKETS, dtype=np.float64)
        self.flat: list[float] | None = None
        self.bias = -3.0
        self.trans = np.zeros((2, 2))
        self.doc = np.array([-3.0, 0.0, 0.0, 0.0])

    def emission(self, word: str) -> float:
        """The sum of the weights of word_features(word); an ASCII word's prefixes are hashed one letter after the other."""
        if self.flat is None:
            self.flat = self.w.tolist()
        w, raw = self.flat, word.encode("utf-8", "replace")
        n = len(raw)
        if n != len(word):
            return float(self.bias + sum([w[k] for k in word_features(word)]))
        total = w[1 + crc32(raw, WORD_SEED) % MOD]
        if n > 1:
            c = crc32(raw[:2], PREFIX_SEED)
            total += w[1 + c % MOD]
            for k in range(2, min(n, 8)):
                c = crc32(raw[k : k + 1], c)
                total += w[1 + c % MOD]
            for k in range(2, min(n, 4) + 1):
                total += w[1 + crc32(raw[-k:], SUFFIX_SEED) % MOD]
        return float(self.bias + total)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "flat": None}

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of each token of each document: documents side by side, longest first, one step of all at a time.

        A block has at most CELLS places, or is one document.
        """
        (t00, t01), (t10, t11) = np.exp(self.trans)
        out: list[np.ndarray] = [np.zeros(0)] * len(emissions)
        order = [k for k in sorted(range(len(emissions)), key=lambda k: -len(emissions[k])) if len(emissions[k])]
        at = 0
        while at < len(order):
            own = order[at : at + max(1, min(BLOCK, CELLS // len(emissions[order[at]])))]
            at += len(own)
            sizes = np.array([len(emissions[k]) for k in own])
            x = np.zeros((sizes[0], len(own)))
            for j, k in enumerate(own):
                x[: sizes[j], j] = np.exp(np.clip(emissions[k], -30, 30))
            active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
            ahead = np.zeros_like(x)
            r = x[0]
            ahead[0] = r
            for t in range(1, sizes[0]):
                n = active[t]
                r = r[:n]
                r = x[t, :n] * (t01 + r * t11) / (t00 + r * t10)
                ahead[t, :n] = r
            q = np.ones(len(own))
            for t in range(sizes[0] - 2, -1, -1):
                n = active[t + 1]
                z = x[t + 1, :n] * q[:n]
                q[:n] = (t10 + z * t11) / (t00 + z * t01)
                ahead[t, : active[t]] *= q[: active[t]]
            p = np.divide(ahead, 1 + ahead, out=ahead)
            for j, k in enumerate(own):
                out[k] = p[: sizes[j], j].copy()
        return out

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.doc @ summary(p), -30, 30))))


def summary(p: np.ndarray) -> np.ndarray:
    """1, log of one plus the expected number of toxic tokens, the largest marginal, and the share of toxic tokens."""
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    strong = p[p >= 0.1]  # what thousands of tokens with a marginal near zero add up to says nothing
    total = float(strong.sum())
    return np.array([1.0, np.log1p(total), float(p.max()), min(1.0, 10 * total / len(p))])


def label_tokens(docs: list[np.ndarray], toxic: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Which words are toxic, by the documents that have their features. docs: word numbers; features: of each word, padded with bucket 0."""
    seen = np.zeros((2, BUCKETS))
    for words, y in zip(docs, toxic, strict=True):
        seen[int(y), np.unique(features[np.unique(words)])] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], dtype=float)[:, None]

    def part(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9))

    total = seen.sum(axis=0)
    ratio = 2 * (part(seen, n * total / n.sum()) + part(n - seen, n * (n.sum() - total) / n.sum())).sum(axis=0)
    much = seen[1] / n[1] > 8 * (seen[0] + 0.5) / n[0]
    strong = (ratio >= EVIDENCE) & much & (seen[1] >= 2)
    strong[0] = False
    return strong[features].any(axis=1)


def train_chain(model: ChainModel, docs: list[np.ndarray], toxic: np.ndarray, features: np.ndarray, bad: np.ndarray) -> None:
    """Maximum likelihood with a quadratic penalty over segments of SEGMENT tokens, by Adam in fixed order."""
    hot, cold = [], []
    for words, y in zip(docs, toxic, strict=True):
        for at in range(0, len(words), SEGMENT):
            part = words[at : at + SEGMENT]
            (hot if y and bad[part].any() else cold).append((part, bool(y)))
    hot = hot[:: max(1, -(-len(hot) * 2 // SEGMENTS))]
    cold = cold[:: max(1, -(-len(cold) // max(1, SEGMENTS - len(hot))))]
    parts = [*hot, *cold]
    if not hot:
        return
    order = np.argsort([crc32(str(k).encode()) for k in range(len(parts))], kind="stable")
    x = np.zeros((len(parts), SEGMENT), dtype=np.int64)
    size = np.array([len(p) for p, _ in parts])
    y = np.zeros((len(parts), SEGMENT), dtype=np.int64)
    for k, (p, t) in enumerate(parts):
        x[k, : len(p)] = p
        y[k, : len(p)] = bad[p] if t else 0
    m1, m2 = np.zeros(BUCKETS + 5), np.zeros(BUCKETS + 5)
    step = 0
    epochs = max(6, 240 // max(1, len(parts) // 512))
    for _ in range(min(epochs, 60)):
        for at in range(0, len(order), 512):
            own = order[at : at + 512]
            f, yy, n = features[x[own]], y[own], size[own]
            live = np.arange(SEGMENT)[None, :] < n[:, None]
            e = np.where(live, model.bias + model.w[f].sum(axis=2), 0.0)
            p, pair = expectations(e, model.trans, live)
            gap = np.where(live, yy - p, 0.0)
            g = np.zeros(BUCKETS + 5)
            g[:BUCKETS] = np.bincount(f.ravel(), weights=np.repeat(gap.ravel(), f.shape[2]), minlength=BUCKETS)
            g[0] = 0
            g[BUCKETS] = gap.sum()
            both = live[:, 1:]
            for a in (0, 1):
                for b in (0, 1):
                    g[BUCKETS + 1 + 2 * a + b] = (((yy[:, :-1] == a) & (yy[:, 1:] == b) & both).sum() - pair[a][b]) * (a or b)
            flat = np.concatenate([model.w, [model.bias], model.trans.ravel()])
            g = g / len(own) - 1e-4 * flat
            step += 1
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.99 * m2 + 0.01 * g * g
            flat += 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            model.w, model.bias, model.trans = flat[:BUCKETS], float(flat[BUCKETS]), flat[BUCKETS + 1 :].reshape(2, 2)


def expectations(e: np.ndarray, trans: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
    """Marginals and expected transition counts of segments side by side; live marks the tokens that exist, a prefix of each."""
    k = np.exp(trans)
    n, size = e.shape
    x = np.exp(np.clip(e, -30, 30))
    ahead, behind = np.ones((n, size)), np.ones((n, size))
    r = x[:, 0]
    ahead[:, 0] = r
    for t in range(1, size):
        r = x[:, t] * (k[0, 1] + r * k[1, 1]) / (k[0, 0] + r * k[1, 0])
        ahead[:, t] = r
    q = np.ones(n)
    for t in range(size - 2, -1, -1):
        z = x[:, t + 1] * q
        q = np.where(live[:, t + 1], (k[1, 0] + z * k[1, 1]) / (k[0, 0] + z * k[0, 1]), 1.0)
        behind[:, t] = q
    both = ahead * behind
    p = both / (1 + both)
    a, z = ahead[:, :-1], x[:, 1:] * behind[:, 1:]
    cells = [[np.full(a.shape, k[0, 0]), z * k[0, 1]], [a * k[1, 0], a * z * k[1, 1]]]
    total = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
    return p, [[float((c / total)[live[:, 1:]].sum()) for c in row] for row in cells]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, *[0.1] * (x.shape[1] - 1)])
        w += np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, *[0.1] * (x.shape[1] - 1)]) * w)
    return w


def learn(rows: list[tuple[str, int]]) -> ChainModel:
    """From distinct (text, label) rows."""
    model = ChainModel()
    y = np.array([t for _, t in rows], dtype=np.int64)
    if not len(rows) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(rows) + 1) if len(rows) else 0.1
        model.doc = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])
        return model
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in WORD.findall(text.lower())], dtype=np.int64) for text, _ in rows]
    features = np.zeros((max(1, len(number)), WIDTH), dtype=np.int64)
    for w, k in number.items():
        f = word_features(w)
        features[k, : len(f)] = f
    bad = label_tokens(docs, y, features)
    train_chain(model, docs, y, features, bad)
    e = model.bias + model.w[features].sum(axis=1)
    x = np.array([summary(p) for p in model.marginals([e[d] if len(d) else np.zeros(0) for d in docs])])
    model.doc = fit_logistic(x, y.astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> ChainModel:
    """Learn from a sample: labels' ids in a fixed order, TOXIC and CLEAN of them at most, and their documents' texts.

    Labels other than 0 and 1 don't count; an id with both counts as toxic. The sampled ids, a bounded table, are
    broadcast, so documents are not shuffled.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)").withColumn("o", sample_order("id"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    most = {1: TOXIC, 0: CLEAN}
    cut = {y: int(2**32 * min(1.0, most[y] / n)) for y, n in sizes.items()}
    chosen = known.where(F.coalesce(*[F.when((F.col("y") == y) & (F.col("o") < c), True) for y, c in cut.items()], F.lit(False))) if cut else known.where("false")
    ids = chosen.groupBy("id").agg(F.max("y").alias("y"), F.min("o").alias("o"))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.length("text") > 0)
    sample = materialise(texts.join(F.broadcast(ids), "id").select("o", "y", "text").distinct(), "labelled")
    left, end = SAMPLE_CHARS, 1 << 32
    for r in sample.select("o", F.length("text").alias("n")).orderBy("o", "n").collect():
        left -= r.n
        if left < 0:
            end = r.o
            break
    rows = sample.where(F.col("o") < end).collect()
    rows.sort(key=lambda r: (r.o, r.text))
    model = learn(list({r.text: r.y for r in rows}.items()))
    del rows
    give_back()
    return model


def spans(model: ChainModel, text: str) -> list[tuple[int, int, float]]:
    """Runs of toxic tokens as offsets in characters, with their largest marginal."""
    tokens = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
    p = model.marginals([np.array([model.emission(w) for _, _, w in tokens])])[0]
    out: list[tuple[int, int, float]] = []
    last = -2
    for k in np.flatnonzero(p >= 0.5):
        if k == last + 1:
            out[-1] = out[-1][0], tokens[k][1], max(out[-1][2], float(p[k]))
        else:
            out.append((tokens[k][0], tokens[k][1], float(p[k])))
        last = k
    return out


def score_toxicity(docs: DataFrame, model: ChainModel, text_col: str = "text", score: str = "score", with_spans: bool = False) -> DataFrame:
    """docs with a column score from 0 to 1, and with_spans a column spans: array of (start, end, p) in characters.

    A null or empty text, or one without letters, has the score of a text without toxic tokens, and no span. Rows are
    scored one by one, equal rows equally. docs must not have columns of these names.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    fields = [*docs.schema.fields, T.StructField(score, T.DoubleType())]
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
    if with_spans:
        fields.append(T.StructField("spans", T._parse_datatype_string("array<struct<start: int, end: int, p: double>>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo, words = Memo(MEMO), Memo(MEMO)

        def of(word: str) -> float:
            if (known := words.get(word)) is None:
                known = model.emission(word)
                words.put(word, known)
            return known

        def cut(part: str) -> tuple[float, ...]:
            if (known := memo.get(part)) is None:
                known = tuple(map(of, WORD.findall(part.lower())))
                if len(part) <= 64:
                    memo.put(part, known)
            return known

        for whole in batches:
            for at in range(0, whole.num_rows, 4 * BLOCK):
                batch = whole.slice(at, 4 * BLOCK)
                texts = [t.as_py() or "" for t in batch.column(place)]
                found = model.marginals([np.fromiter(chain.from_iterable(map(cut, t.split())), dtype=np.float64) for t in texts])
                columns = [*batch.columns, pa.array([model.score(p) for p in found], pa.float64())]
                if with_spans:
                    columns.append(pa.array([[dict(zip(("start", "end", "p"), s, strict=True)) for s in spans(model, t)] if (p >= 0.5).any() else [] for t, p in zip(texts, found, strict=True)], pa.list_(pair)))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        del memo, words
        model.flat = None
        give_back()

    return docs.mapInArrow(run, T.StructType(fields))


def toxicity_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least threshold) of every row; learns from rows that aren't held out."""
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out("doc_id")))
    scored = score_toxicity(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model)
    return scored.drop("text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity_query over documents and labels: every row, whole texts. Null and empty texts have the score of a text without
    toxic tokens; equal rows give equal rows; without labels of both kinds every score is the share of toxic ones (0.1 without any)."""
    return toxicity_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
