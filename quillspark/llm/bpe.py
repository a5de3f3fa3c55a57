"""BPE encoding and decoding by dynamic programming over prefixes.

A merge-order BPE encoding has one property that removes the merge loop: each prefix of a symbol sequence has exactly
one possible last token, and a token t may follow a prefix that ends in token p if and only if the two stay apart when
BPE runs over p + t. So one pass suffices: an automaton over the vocabulary's suffix links reports all tokens that end at a position,
the pair test picks the only one that fits, and back-pointers give the ids. Work is linear in the length of the text,
however long a word is.

The automaton's state after a prefix is the longest suffix of it that starts a token, and its suffix links lead to all
shorter ones, so it reports exactly the tokens that are suffixes of the prefix: what the suffix automaton of the text
would, looked up from the other side, without one automaton for each word.

Texts are split into pre-tokens, a group of texts at a time. The distinct ones that the task doesn't know yet are encoded in
sorted order, so that those with a common beginning share its prefixes; what is known is kept in a bounded table that goes with the task.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm.common import bounded_batches, give_back

#: Stands for the end mark: no character of the byte alphabet.
END = "\ue000"
#: Entries of each half of a task's table of known pre-tokens and of its table of cuts with other characters; of its tables
#: of tested pairs and of steps; pre-tokens of a group of texts; flags of keys asked for (a power of 2).
KNOWN, MEMO, PAIRS, STEPS, GROUP, SEEN = 200_000, 60_000, 500_000, 500_000, 100_000, 1 << 22
#: Python's str.split() also parts at these, which are no white space to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)
#: The split of the vocabulary file, and the same for lower-cased texts of PLAIN: characters whose class is fixed by these ranges, that
#: NFC leaves alone, and whose lower case is one of them (Latin letters up to U+017F without U+0130, ASCII digits, marks, white space).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
PLAIN = re.compile("[\t-\r\x20-\x7e\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u2053]*")
PLAIN_SPLIT = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{LETTERS}0-9]+")


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies use for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PrefixBpe:
    """Encodes one pre-token. End: the mark that closes a word; it belongs to the last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "", unknown: str | None = None, fuse: bool = False):
        self.end, self.unknown, self.fuse = end, unknown, fuse
        self.ids = vocab
        self.rank: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.joined: dict[tuple[str, str], int] = {}
        for k, (a, b) in enumerate(merges):
            self.joined.setdefault((a, b), k)
            if a + b not in self.rank:
                self.rank[a + b], self.parts[a + b] = k, (a, b)
        # tokens by number: a pair of tokens is one integer
        self.symbols = {t for t in vocab if len(t) == 1 and t + end in vocab}
        self.tokens = list(vocab)
        self.apart: dict[int, bool] = {}
        self._build([(self._mark(t), k) for k, t in enumerate(self.tokens) if self._stands(t)])

    def _build(self, words: list[tuple[str, int]]) -> None:
        """The automaton: edges of the trie by state << 21 | character, suffix links, and the tokens that end in each state, longest first."""
        self.sizes = [0] * len(self.tokens)
        self.edges: dict[int, int] = {}
        self.links, self.found = [0], [()]
        self.steps: dict[int, int] = {}
        level = [(0, 0, word, k) for word, k in words]  # state before, its link, token
        at = 0
        while level:
            after = []
            for state, link, word, k in level:
                key = state << 21 | ord(word[at])
                if (new := self.edges.get(key)) is None:
                    new = self.edges[key] = len(self.links)
                    self.links.append(self._walk(link, key & 0x1FFFFF) if state else 0)
                    self.found.append(None)
                if at + 1 == len(word):
                    self.sizes[k] = len(word) - word.endswith(END)
                    self.found[new] = (k,)
                else:
                    after.append((new, self.links[new], word, k))
            level, at = after, at + 1
        for state in range(1, len(self.links)):  # by depth, so a link's tokens are complete
            self.found[state] = (self.found[state] or ()) + self.found[self.links[state]]

    def _walk(self, state: int, char: int) -> int:
        """The next state by the trie's edges and suffix links."""
        while (new := self.edges.get(state << 21 | char)) is None:
            if not state:
                return 0
            state = self.links[state]
        return new

    def step(self, key: int) -> int:
        """The state after state << 21 | character."""
        if (new := self.steps.get(key)) is None:
            if len(self.steps) > STEPS:
                self.steps.clear()
            new = self.steps[key] = self._walk(key >> 21, key & 0x1FFFFF)
        return new

    def _mark(self, token: str) -> str:
        """The end mark as one private character, so that positions count symbols."""
        return token[: -len(self.end)] + END if self.end and token.endswith(self.end) and token != self.end else token

    def _stands(self, token: str) -> bool:
        """Whether merging a token's own symbols gives that token: its last merge must not be cut by an earlier one."""
        if token not in self.parts:
            return len(self._mark(token).rstrip(END)) == 1
        a, b = self.parts[token]
        return self._apart_until(a, b, self.rank[token])

    def _apart_until(self, left: str, right: str, limit: int) -> bool:
        """Whether no merge across the border of two tokens happens before merge number limit.

        Undo the younger of the two border tokens, again and again. At each step only merges older than what was undone
        could have taken place across the border.
        """
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the younger on the left: merges across the border with the part must be older than it
                limit, left = min(limit, a), self.parts[left][1]
            else:  # on the right the border merge comes first at equal rank, as merges run from the left
                limit, right = min(limit, b + 1), self.parts[right][0]

    def compatible(self, pair: int) -> bool:
        """Whether two tokens, left << 32 | right by number, stay apart."""
        if (known := self.apart.get(pair)) is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            known = self.apart[pair] = self._apart_until(self.tokens[pair >> 32], self.tokens[pair & 0xFFFFFFFF], 1 << 60)
        return known

    def encode(self, word: str) -> list[str]:
        """Tokens of a pre-token given in the byte alphabet. Symbols that the vocabulary lacks are its unknown token, or dropped without one."""
        if self.symbols.issuperset(word) or not word:
            return self._known(word, self.end)
        return self._with_unknown(word)

    def _with_unknown(self, word: str) -> list[str]:
        known = [c in self.ids for c in word[:-1]] + [word[-1] + self.end in self.ids]
        if self.unknown is None:
            return self._known("".join(c for c, k in zip(word, known, strict=True) if k), self.end if known[-1] else "")
        out: list[str] = []
        at = 0
        for good, run in groupby(known):
            size = len(list(run))
            if good:
                out += self._known(word[at : at + size], self.end if at + size == len(word) else "")
            else:
                out += [self.unknown] * (1 if self.fuse else size)
            at += size
        return out

    def _known(self, word: str, end: str) -> list[str]:
        """end: the end mark where the word is closed, else empty."""
        return [self.tokens[t] for t in next(self.encode_sorted([word], bool(end)))] if word else []

    def encode_sorted(self, words: Iterable[str], closed: bool) -> Iterator[list[int]]:
        """Numbers of the tokens of each word, whose symbols the vocabulary has; closed: with the end mark after it.

        A prefix has the same last token in all words that begin with it, so only what a word doesn't share with the
        word before it is new: in sorted order that is least.
        """
        states, last = [0], [-1]  # by prefix of the word
        steps, found, sizes, apart = self.steps, self.found, self.sizes, self.apart
        step, compatible, final = self.step, self.compatible, ord(END)
        before = ""
        for word in words:
            k = 0
            for a, b in zip(word, before):  # noqa: B905
                if a != b:
                    break
                k += 1
            del states[k + 1 :], last[k + 1 :]
            before = word
            state = states[k]
            for c in map(ord, word[k:]):
                k += 1
                key = state << 21 | c
                if (state := steps.get(key)) is None:
                    state = step(key)
                for token in found[state]:
                    if start := k - sizes[token]:
                        if (left := last[start]) < 0:
                            continue
                        pair = left << 32 | token
                        if (fits := apart.get(pair)) is None:
                            fits = compatible(pair)
                        if not fits:
                            continue
                    break
                else:
                    token = -1
                states.append(state)
                last.append(token)
            if closed:
                for token in found[step(state << 21 | final)]:
                    if not (start := k - sizes[token]) or (left := last[start]) >= 0 and compatible(left << 32 | token):
                        break
                else:
                    token = -1
            else:
                token = last[k]
            if token < 0:
                raise ValueError(f"no token of the vocabulary ends at {k}")
            out = [token]
            while k := k - sizes[token]:
                token = last[k]
                out.append(token)
            out.reverse()
            yield out


class Memo:
    """A bounded table of what recurs: a key enters when it is asked for again, and what was not asked for lately is forgotten.

    When the young half is full, it becomes the old one. Keys that were asked for are known by a bit of their hash, so that
    the many that occur once don't push out the others.
    """

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}
        self.asked = bytearray(SEEN)

    def get(self, key: str):
        if (found := self.young.get(key)) is None and (found := self.old.get(key)) is not None:
            self._enter(key, found)
        return found

    def put(self, key: str, value) -> None:
        k = hash(key) & (SEEN - 1)
        if self.asked[k]:
            self._enter(key, value)
        else:
            self.asked[k] = 1

    def _enter(self, key: str, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordEncoder:
    """Encodes and decodes texts as the file's tokenizer does: NFC, white space dropped, lower case, split, BPE."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bpe = PrefixBpe(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "", model.get("unk_token"), bool(model.get("fuse_unk")))
        self.names = {k: t for t, k in [*model["vocab"].items(), *self.special.items()]}
        self.pieces = [k.to_bytes(4, "little") for k in model["vocab"].values()]
        self.piece_of = {t: k.to_bytes(4, "little") for t, k in model["vocab"].items()}
        self.alphabet = byte_alphabet()
        self.whole = self.bpe.symbols.issuperset(self.alphabet)
        self.plain = self.split.pattern == SPLIT
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cuts = Memo(MEMO)

    def parts(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string has a blank before it, as no pre-token has."""
        plain = self.plain and not any(s in text for s in self.special)
        if plain and PLAIN.fullmatch(text):
            return PLAIN_SPLIT.findall(text.lower())
        out: list[str] = []
        for cut in SPACE.split(text) if SEPARATORS.search(text) else text.split():
            if plain and PLAIN.fullmatch(cut):
                out += PLAIN_SPLIT.findall(cut.lower())
            elif cut:
                out += self._cut(cut)
        return out

    def _cut(self, cut: str) -> list[str]:
        """Pre-tokens of a text without white space, of any characters."""
        if (known := self.cuts.get(cut)) is None:
            known = []
            for text in self.special_at.split(cut) if self.special_at else [cut]:
                if text in self.special:
                    known.append(" " + text)
                elif text:
                    plain = text if text.isascii() else unicodedata.normalize("NFC", text)
                    known += self.split.findall(plain.lower() if plain.isascii() else "".join(map(str.lower, plain)))
            if len(cut) <= 64:
                self.cuts.put(cut, known)
        return known

    def _learn(self, words: set[str]) -> list[str]:
        """Enters the ids of all these pre-tokens into the young half of the table; gives those that are too long to stay there.

        When the young half is full, it becomes the old one, from which words that are asked for return.
        """
        if len(self.young) >= KNOWN:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for word in words.difference(young):
            if (ids := old.get(word)) is not None:
                young[word] = ids
            elif word[0] == " ":
                young[word] = self.special[word[1:]].to_bytes(4, "little")
            else:
                new.append(word)
        new.sort()
        alphabet, pieces = self.alphabet, self.pieces
        shown = (w if w.isascii() and w.isalnum() else "".join([alphabet[b] for b in w.encode()]) for w in new)
        if self.whole:
            young.update(zip(new, (b"".join([pieces[t] for t in found]) for found in self.bpe.encode_sorted(shown, bool(self.bpe.end))), strict=True))
        else:
            young.update((w, b"".join([self.piece_of[t] for t in self.bpe.encode(s)])) for w, s in zip(new, shown, strict=True))
        return [w for w in new if len(w) > 64]

    def texts(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, str]]:
        """Of each text all ids as little-endian 32-bit integers, and the decoded text: tokens with a blank between, as there is no decoder."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            group.append(self.parts(text) if text else [])
            held += len(group[-1])
            if held >= GROUP:
                yield from self._coded(group)
                group, held = [], 0
        yield from self._coded(group)

    def _coded(self, group: list[list[str]]) -> Iterator[tuple[bytes, str]]:
        long = self._learn(set().union(*group))
        ids_of, name = self.young.__getitem__, self.names.__getitem__
        for parts in group:
            ids = b"".join(map(ids_of, parts))
            yield ids, " ".join(map(name, memoryview(ids).cast("I"))) if ids else ""
        for word in long:
            del self.young[word]


@lru_cache(maxsize=2)
def encoder(spec: str) -> WordEncoder:
    return WordEncoder(spec)


SCHEMA = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode_documents(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs, of any number of equal rows: the columns in keep (doc_id), n_tokens and digests.

    vocabulary: path of the tokenizer's JSON file, read once by the driver and sent as a broadcast (its size is that of
    the vocabulary, not of the data). with_ids adds ids (array of int) and decoded (string). A null or empty text has no
    token; its digests are those of nothing. Special strings inside texts are special tokens. No shuffle.
    """
    keep = ["doc_id"] if keep is None else keep
    bounded_batches(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [docs.schema[c] for c in keep] + SCHEMA.fields
    if with_ids:
        fields = [*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(spec.value)
        for batch in batches:
            n, ids, decoded, raw, plain = [], [], [], [], []
            for a, b in coder.texts(t.as_py() for t in batch.column(batch.num_columns - 1)):
                n.append(len(a) // 4)
                ids.append(hashlib.sha256(a).hexdigest())
                decoded.append(hashlib.sha256(b.encode()).hexdigest())
                if with_ids:
                    raw.append(memoryview(a).cast("I").tolist() if a else [])
                    plain.append(b)
            more = [pa.array(raw, pa.list_(pa.int32())), pa.array(plain, pa.string())] if with_ids else []
            columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), *more]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        encoder.cache_clear()
        del coder
        give_back()

    return docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text")).mapInArrow(run, T.StructType(fields))
