"""Byte-pair encoding and decoding by walking a trie of distinct words.

A greedy BPE encoding has a useful property: the encoding of a prefix is the
encoding of a shorter prefix plus one token, and that last token is the only
vocabulary token ending there whose pair with the shorter prefix's last token
BPE would leave unmerged. So one token per prefix is the whole state. The words
of a batch that are not known yet go into a trie; a depth-first walk hands the
last-token state of each node down to its children, and words that share a
prefix share the work for it. A word's ids are read off the states on its path.

Whether BPE leaves a pair of tokens unmerged is decided by undoing merges on
both sides of the seam, latest first, and looking for a merge across the seam
that would have come earlier. Answers are kept per pair.

Texts never leave their row: encoding is one pass over the table without a
shuffle, executors that are lost only cost their tasks. Known words are kept
per Python worker in two generations of bounded size.

Defined results for odd input: a null text encodes as the empty text; empty
text has no ids and decodes to the empty string; texts of any length are
encoded whole; repeated rows are encoded each; an empty table gives an empty
result; other columns pass through, except those with the names of new columns,
which are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gistra.llm.common import table

#: Fixed value: the pre-token pattern of the word vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: characters with the Unicode property White_Space, as a class body.
SPACES = "\t-\r \x85\xa0  -     　"
#: Words that a worker keeps in the younger of its two generations; a query that runs alone has room for more.
KEEP, KEEP_ALONE = 100_000, 300_000
#: Texts between two walks; bounds the trie.
STEP = 512


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Merge table, special tokens and the trie walk of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, x, y = self.vocab[a + b], self.vocab[a], self.vocab[b]
            self.merged.setdefault((x, y), r)
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = r, x, y
        end = self.suffix
        inner = {t: i for t, i in self.vocab.items() if not (end and t.endswith(end) and t != end)}
        self.final = {t.removesuffix(end): i for t, i in self.vocab.items() if t.endswith(end) and t != end} if end else inner
        self.inner = inner
        self.width = [len(t.removesuffix(end)) if end and t != end else len(t) for t in self.token]
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.seams: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a, b side by side unmerged."""
        key = (a, b)
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) > 2_000_000:
                self.seams.clear()
            known = self.seams[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        rank, merged = self.rank, self.merged
        limit = len(self.merged) + 1
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]  # at equal rank the left merge came first
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def alone(self, t: int) -> bool:
        """Whether BPE makes token t of its own characters."""
        known = self.whole.get(t)
        if known is None:
            x, y = self.left[t], self.right[t]
            known = self.whole[t] = self.rank[t] < 0 or (self.alone(x) and self.alone(y) and self._meets(x, y, self.rank[t]))
        return known

    def _meets(self, a: int, b: int, r: int) -> bool:
        """Whether a and b are still whole and unmerged when merge r is due."""
        rank, merged = self.rank, self.merged
        limit = len(merged) + 1
        first = True
        while True:
            m = merged.get((a, b), limit)
            if m < limit and not (first and m == r):
                return False
            first = False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def _spell(self, word: str) -> str:
        """The word in the byte alphabet."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", "\u0120")
        return word.encode().decode("latin-1").translate(self.bytes)

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words (each one pre-token).

        The trie is held as the sorted words: each shares with the one before it
        the nodes of their common prefix, and going down the list visits the
        nodes depth first. ``last`` has the last-token state of every node on
        the path to the present word. Exactly one token fits a node, so any order
        of trying finds it: the parent's last token grown by the new character
        first, then tokens from short to long.
        """
        inner, final, width = self.inner.get, self.final.get, self.width
        known, suffix = self.seams.get, bool(self.suffix)
        out: dict[str, list[int]] = {}
        last, before = [-1], ""
        words = list(words)
        for text, word in sorted(zip(map(self._spell, words), words)):
            n, k = len(text), 0
            for a, b in zip(before, text):
                if a != b:
                    break
                k += 1
            del last[k + 1 :]
            before = text
            for d in range(len(last), n + 1):
                tokens = final if suffix and d == n else inner
                grown = at = d - 1 - width[last[-1]] if d > 1 else 0
                while True:
                    t = tokens(text[at:d])
                    if t is not None:
                        if not at:
                            if self.alone(t):
                                break
                        else:
                            key = (last[at], t)
                            apart = known(key)
                            if self.apart(*key) if apart is None else apart:
                                break
                    at = d - 1 if at == grown else at - 1
                    if at == grown:
                        at -= 1
                    if at < 0:
                        raise ValueError(f"no encoding of {word!r}: a byte is missing from the vocabulary")
                last.append(t)
            ids, at = [t if suffix else last[n]], n
            at -= width[ids[0]]
            while at > 0:
                t = last[at]
                ids.append(t)
                at -= width[t]
            ids.reverse()
            out[word] = ids
            if suffix:
                del last[n:]  # that node was the end of a word, not a place within one
        return out


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


class Encoder:
    """Whole texts to ids, and ids to text, with the vocabulary whose words end in a suffix."""

    def __init__(self, path: str, keep: int = KEEP) -> None:
        self.model, self.keep = bpe(path), keep
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.words = regex.compile(WORDS)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.far = re.compile("[^\0-\u024f\u2010-\u2027\u20ac]")
        self.odd_space = re.compile("[\x1c-\x1f]")
        self.space = re.compile(f"[{SPACES}]+")
        special = sorted(self.model.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.marks = tuple({s[:2] for s in special})
        self.strings = {str(i): t for i, t in enumerate(self.model.token)}
        self.numbers = list(self.strings)

    def _plain(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalized."""
        if not text.isascii():
            if self.far.search(text):  # beyond Latin letters, the Unicode version of the library counts
                text = self.normalizer.normalize_str(text)
            elif not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        text = text.lower()
        find = self.words.findall
        far = not text.isascii() and self.far.search(text)
        if not far and not self.odd_space.search(text):
            return find(text)
        out: list[str] = []
        for c in filter(None, self.space.split(text)):
            out += [c[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(c)] if far and self.far.search(c) else find(c)
        return out

    def chunks(self, text: str) -> list[str]:
        """Words of a text; a special token is one that starts with NUL NUL."""
        if not any(m in text for m in self.marks):
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += ["\0\0" + part] if k % 2 else self._plain(part)
        return out

    def _learn(self, missing: set[str]) -> None:
        special, number = self.model.special, self.numbers.__getitem__
        marks = {c for c in missing if c.startswith("\0\0") and c[2:] in special}
        for c in marks:
            self.young[c] = str(special[c[2:]])
        for w, x in self.model.encode_words(missing - marks).items():
            self.young[w] = " ".join(map(number, x))

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by one space."""
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        split = [self.chunks(t) for t in texts]
        young, old = self.young, self.old
        missing: set[str] = set()
        for s in split:
            missing.update(s)
        missing = missing.difference(young)
        known = missing.intersection(old) if old else set()
        for c in known:
            young[c] = old[c]
        self._learn(missing - known)
        get = young.__getitem__
        return [" ".join(filter(None, map(get, s))) for s in split]

    def decode(self, ids: str) -> str:
        """The text of decimal ids: without a decoder in the file, tokens joined by one space."""
        return " ".join(map(self.strings.__getitem__, ids.split(" "))) if ids else ""


@lru_cache(maxsize=4)
def encoder(path: str, keep: int = KEEP) -> Encoder:
    return Encoder(path, keep)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _columns(df: DataFrame, new: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n.lower() for n, _ in new}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + [T.StructField(n, k) for n, k in new])


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for at in range(0, batch.num_rows, STEP):
        part = batch.slice(at, STEP)
        yield part, [x or "" for x in part.column(column).to_pylist()]


def _with(part: pa.RecordBatch, schema: T.StructType, new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(f.name) for f in schema.fields], names=[f.name for f in schema.fields])


def encode(df: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the ids of ``column`` as array<int>."""
    schema = _columns(df, [(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part, texts in _batches(batch, column):
                ids = [list(map(int, s.split())) for s in enc.encode(texts)]
                yield _with(part, schema, {out: pa.array(ids, pa.list_(pa.int32()))})

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text of the ids in ``column``; null ids decode to the empty string."""
    schema = _columns(df, [(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                texts = [enc.decode(" ".join(map(str, x or []))) for x in part.column(column).to_pylist()]
                yield _with(part, schema, {out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, column: str = "text", ids: bool = True, keep: int = KEEP) -> DataFrame:
    """Replaces ``column`` by n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    new += [("ids", T.ArrayType(T.IntegerType()))] if ids else []
    schema = _columns(df.drop(column), new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sha = encoder(path, keep), hashlib.sha256
        for batch in batches:
            for part, texts in _batches(batch, column):
                found = enc.encode(texts)
                sizes = [s.count(" ") + 1 if s else 0 for s in found]
                cols = {
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_sha256": pa.array([sha(s.encode()).hexdigest() for s in found]),
                    "decoded_sha256": pa.array([sha(enc.decode(s).encode()).hexdigest() for s in found]),
                }
                if ids:
                    flat = np.fromstring(" ".join(filter(None, found)), dtype=np.int32, sep=" ") if any(sizes) else np.zeros(0, np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
                yield _with(part, schema, cols)

    return df.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every document with the word vocabulary, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, vocabulary(), ids=False, keep=KEEP_ALONE)
