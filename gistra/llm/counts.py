"""Token counts that follow edits.

A document is kept as its pre-tokens in blocks, under a segment tree with the
code points and tokens of every subtree. An edit is located by descending the
tree; only the pre-tokens it touches, those whose match looked at the edited
place, and those up to the point where old and new boundaries agree again are
encoded anew. The blocks they lie in are rewritten and the sums on the paths to
the root updated, so an edit costs what it touches and not the document.

Why boundaries agree again: the pattern matches from left to right, and what it
matches from a place on depends only on the text from there on. Once a new
boundary falls on an old one behind the edit, everything after is as before.

Counts of pre-tokens come from the trie walk of ``bpe`` with the byte-level
vocabulary and are kept per Python worker, in two generations of bounded size.
Special tokens are ordinary text here.

Defined results for odd input: a null text is empty; an empty text has no
tokens; texts of any length are counted whole; edits outside the text are
clipped to it; repeated rows are counted each; an empty table gives an empty
result; other columns pass through except those named like new ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gistra.llm.bpe import bpe, vocabulary
from gistra.llm.common import table

#: Fixed value: the pattern of the byte-level vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for texts of the characters below, where the quicker module's classes agree with it.
QUICK = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
FAR = re.compile("[^\\t\\n\\r -~\\xa1-\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\u024f\\u2013\\u2014\\u2018-\\u201e\\u2026\\u20ac]")
BLOCK = 64
KEEP = 400_000
STEP = 256

Edit = tuple[int, int, str]


def pieces_of(text: str) -> list[str]:
    """The pre-tokens of a text."""
    return PATTERN.findall(text) if FAR.search(text) else QUICK.findall(text)


class Counter(dict):
    """Tokens of pre-tokens, from the trie walk of one vocabulary. A lookup learns what is missing."""

    def __init__(self, path: str, keep: int = KEEP) -> None:
        super().__init__()
        self.model, self.keep = bpe(path), keep
        self.old: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        """Makes the counts of these pre-tokens known. What is known longest goes when there are too many."""
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()
        missing = pieces.difference(self)
        known = missing.intersection(self.old) if self.old else set()
        for p in known:
            self[p] = self.old[p]
        self.update((w, len(ids)) for w, ids in self.model.encode_words(missing - known).items())

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = len(self.model.encode_words([piece])[piece])
        self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class TokenTree:
    """The pre-tokens of a text under a segment tree of (code points, tokens)."""

    def __init__(self, pieces: list[str], counts: Counter) -> None:
        self.counts = counts
        self.encoded = len(pieces)
        self._build([pieces[k : k + BLOCK] for k in range(0, len(pieces), BLOCK)] or [[]])

    def _build(self, blocks: list[list[str]]) -> None:
        self.blocks = blocks
        n = 1
        while n < len(blocks):
            n *= 2
        self.base = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        get = self.counts.__getitem__
        self.chars[n : n + len(blocks)] = [sum(map(len, b)) for b in blocks]
        self.tokens[n : n + len(blocks)] = [sum(map(get, b)) for b in blocks]
        for k in range(n - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def _locate(self, at: int) -> tuple[int, int]:
        """(block, its first code point) of the first block that reaches ``at``."""
        k, begin = 1, 0
        while k < self.base:
            k *= 2
            if begin + self.chars[k] < at:
                begin += self.chars[k]
                k += 1
        return min(k - self.base, len(self.blocks) - 1), begin

    def _set(self, k: int, pieces: list[str]) -> None:
        self.blocks[k] = pieces
        x = k + self.base
        c, t = sum(map(len, pieces)) - self.chars[x], sum(map(self.counts.__getitem__, pieces)) - self.tokens[x]
        while x:
            self.chars[x] += c
            self.tokens[x] += t
            x //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces code points start to end by ``new``."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first, at = self._locate(start)
        pieces = self.blocks[first]
        i = 0
        while i < len(pieces) and at + len(pieces[i]) < start:
            at += len(pieces[i])
            i += 1
        # the match that ends at the edit, or spans it, looked at the edited place; start one before it
        if i:
            i -= 1
            at -= len(pieces[i])
        elif first:
            while first and not i:
                first -= 1
                pieces = self.blocks[first]
                i = len(pieces)
            if i:
                i -= 1
                at -= len(pieces[i])
        block, j, old = first, i, []
        gone = at  # the end, in the old text, of the pieces taken so far

        def take() -> str | None:
            nonlocal block, j, gone
            while block < len(self.blocks) and j >= len(self.blocks[block]):
                block, j = block + 1, 0
            if block >= len(self.blocks):
                return None
            p = self.blocks[block][j]
            j += 1
            gone += len(p)
            old.append(p)
            return p

        while gone < end and take() is not None:
            pass
        flat = "".join(old)
        text = flat[: start - at] + new + flat[end - at :]
        shift = len(new) - (end - start)
        fresh: list[str] = []
        done = at  # the end, in the new text, of the fresh pieces
        scanned = False
        while not scanned:
            # more old text until the fresh boundaries meet an old one behind the edit
            ahead = [p for p in (take(), take()) if p is not None]
            text += "".join(ahead)
            whole = not ahead
            ends = {at}
            x = at
            for p in old:
                x += len(p)
                ends.add(x)
            fresh, done = [], at
            limit = at + len(text)
            for m in PATTERN.finditer(text):
                stop = at + m.end()
                if not whole and stop >= limit:
                    break  # its match could reach past what has been read
                fresh.append(m.group())
                done = stop
                back = stop - shift
                if back >= end and stop >= start + len(new) and back in ends and not whole:
                    scanned = True
                    break
            if whole:
                scanned = True
        # give back the old pieces behind the meeting point
        back = done - shift
        while gone > back:
            gone -= len(old.pop())
            if j == 0:
                while j == 0:
                    block -= 1
                    j = len(self.blocks[block])
            j -= 1
        self.encoded += len(fresh)
        head = self.blocks[first][:i]
        if block == first:
            self._set(first, head + fresh + self.blocks[first][j:])
        else:
            if block < len(self.blocks):
                self._set(block, self.blocks[block][j:])
            for k in range(first + 1, min(block, len(self.blocks))):
                self._set(k, [])
            self._set(first, head + fresh)
        if len(self.blocks[first]) > 4 * BLOCK:
            rest = [p for b in self.blocks for p in b]
            self._build([rest[k : k + BLOCK] for k in range(0, len(rest), BLOCK)])


def edits_of(text: str) -> list[Edit]:
    """The edits of the registered query: a word put in, a few code points taken out, one replaced.

    Places are in the text as the edits before have left it.
    """
    n = len(text)
    return [(n // 2, n // 2, " revised"), (n // 4, n // 4 + min(12, n // 8), ""), (3 * n // 4, 3 * n // 4 + min(1, n), "2")]


def with_counts(docs: DataFrame, path: str, edits: Callable[[str], list[Edit]] = edits_of, text: str = "text") -> DataFrame:
    """Replaces the text by n_tokens, edited_n_tokens, n_pieces and n_reencoded (pre-tokens)."""
    new = ("n_tokens", "edited_n_tokens", "n_pieces", "n_reencoded")
    keep = [f for f in docs.schema.fields if f.name not in (text, *new)]
    schema = T.StructType([*keep, *(T.StructField(n, T.LongType()) for n in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                texts = [t or "" for t in part.column(text).to_pylist()]
                pieces = [pieces_of(t) for t in texts]
                seen: set[str] = set()
                for p in pieces:
                    seen.update(p)
                counts.learn(seen)
                rows = []
                for t, p in zip(texts, pieces):
                    tree = TokenTree(p, counts)
                    before, n = tree.total, tree.encoded
                    for e in edits(t):
                        tree.edit(*e)
                    rows.append((before, tree.total, n, tree.encoded - n))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *cols], names=schema.names)

    return docs.mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its edits."""
    return with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
