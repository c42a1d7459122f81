"""Benchmark decontamination with a BM25 index of the test items.

The items are few and known beforehand, the corpus is not, so the items are
indexed and every training passage is a query. Scores are BM25 with the item as
the document, each divided by the score the item gives itself, so one threshold
holds for all items. Passages are windows that overlap by half and are more
than twice as long as the longest item, so every occurrence lies whole in one.

Retrieval is exact block-max WAND. A posting list is ordered by item and has
the greatest impact of the list and of each block of items. Many passages are
first looked at together: a passage goes no further if the maxima of its lists
stay under the threshold, or if in no block the maxima of the block do (terms
found in many items are not followed here; what they could add at most is kept
per block). The lists of each passage left are then walked: the pivot is the
first item at which the maxima of the lists up to it reach the threshold; where
the maxima of the pivot's block don't, the lists leap to the next block where
they do, else they leap to the pivot, which is scored. Every item above the threshold is
retrieved. A retrieved item counts as leaked into the passage if
the passage has at least ``OVERLAP`` of the five-word shingles of its question
and of its answer, or of the whole item: an answer of few words is lost to one
edit.

The corpus is read once for each index and never shuffled. Items are dealt by
hash to indexes of about ``ITEMS`` items; statistics are aggregated over all
items by Spark, and the driver handles one index at a time.

Defined results for odd input: null and empty texts and items match nothing; an
item of fewer than five words is matched as one sequence; in Chinese and
Japanese text each character is a word; parts of an item that
are shorter than five words are taken with the words beside them; texts of any
length are searched whole; repeated rows and repeated items are reported each;
an empty table on either side gives an empty result; extra columns are ignored
by ``leaks`` and pass through ``clean``.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistra.llm.common import cut, table

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
GRAM = 5
#: Items in a block of postings; items in one index, which bounds what tasks receive.
BLOCK = 4
ITEMS = 20_000
#: A term in more than this share of items is not followed when candidates are searched.
COMMON = 0.05
#: Least words of a passage; words that are searched at once.
PASSAGE = 128
CHUNK = 60_000
WORD = re.compile(r"\w+")
#: Scripts without spaces: each character is a word.
LONE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
SPACELESS = re.compile(f"[{LONE}]")
WORD_OR_LONE = re.compile(rf"[{LONE}]|[^\W{LONE}]+")


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (WORD if text.isascii() or not SPACELESS.search(text) else WORD_OR_LONE).findall(text)


def parts_of(text: str | None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer of an item.

    The question ends with its first question mark, else before the last
    sentence, else in the middle. Each part has at least GRAM words, if the item
    does.
    """
    text = text or ""
    all_words = words_of(text)
    head, mark, tail = text.partition("?")
    if mark and words_of(tail):
        cut = len(words_of(head))
    else:
        sentences = [len(words_of(s)) for s in re.split(r"(?<=[.!?])\s+", text) if words_of(s)]
        cut = len(all_words) - sentences[-1] if len(sentences) > 1 else (len(all_words) + 1) // 2
    return all_words[: max(cut, GRAM)], all_words[min(cut, max(0, len(all_words) - GRAM)) :]


def grams(words: list[str], size: int = GRAM) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


class Index:
    """BM25 impacts of a block of items, normalized so that an item scores 1 for itself."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float) -> None:
        self.ids = [i for i, _ in items]
        parts = [parts_of(t) for _, t in items]
        self.question = [grams(q) for q, _ in parts]
        self.answer = [grams(a) for _, a in parts]
        self.whole = [grams(words_of(t)) for _, t in items]
        self.size = [min(GRAM, len(words_of(t))) for _, t in items]  # of its shingles, and of both its parts'
        words = [words_of(t) for _, t in items]
        self.longest = max(map(len, words), default=0)
        self.terms: dict[str, int] = {}
        rows: list[tuple[int, int, float]] = []
        for k, w in enumerate(words):
            impacts = {}
            for t, f in Counter(w).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                impacts[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean))
            total = sum(impacts.values())
            rows += [(self.terms.setdefault(t, len(self.terms)), k, x / total) for t, x in impacts.items()]
        rows.sort()
        term, item, impact = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.item, self.impact = item.astype(np.int64), impact.astype(float)
        v = len(self.terms)
        self.start = np.searchsorted(term, np.arange(v + 1))
        often = np.diff(self.start) > max(2, COMMON * len(items))
        self.blocks = -(-len(items) // BLOCK) or 1
        rest = np.zeros(len(items))
        np.add.at(rest, self.item[often[term]], self.impact[often[term]])
        self.rest = np.zeros(self.blocks)
        np.maximum.at(self.rest, np.arange(len(items)) // BLOCK, rest)
        # maxima of blocks, as rows (term, block, maximum), and of whole lists
        key = term.astype(np.int64) * self.blocks + self.item // BLOCK
        uniq, back = np.unique(key, return_inverse=True)
        top = np.zeros(len(uniq))
        np.maximum.at(top, back, self.impact)
        self.top_block, self.top = uniq % self.blocks, top
        self.top_start = np.searchsorted(uniq // self.blocks, np.arange(v + 1))
        self.most = np.zeros(v)
        np.maximum.at(self.most, term, self.impact)
        self.follow = ~often
        # for leaps within lists, which are quicker in plain arrays
        self.items, self.impacts = array("q", self.item.tolist()), array("d", self.impact.tolist())
        self.starts, self.mosts = array("q", self.start.tolist()), array("d", self.most.tolist())

    @staticmethod
    def _rows(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the lists ``which``, and the number in ``which`` that each row belongs to."""
        n = start[which + 1] - start[which]
        owner = np.repeat(np.arange(len(which)), n)
        before = np.cumsum(n) - n
        return np.arange(n.sum()) - before[owner] + start[which][owner], owner

    def retrieve(self, window: np.ndarray, term: np.ndarray, n_windows: int) -> list[tuple[int, int, float]]:
        """(window, item, score) of all scores at or above the threshold.

        ``window`` and ``term`` are the distinct pairs, ordered by window.
        """
        border = THRESHOLD - 1e-9
        hopeful = np.bincount(window, self.most[term], n_windows) >= border
        kept = hopeful[window]
        window, term = window[kept], term[kept]
        followed = self.follow[term]
        w, t = window[followed], term[followed]
        rows, owner = self._rows(self.top_start, t)
        key = w[owner] * self.blocks + self.top_block[rows]
        uniq, back = np.unique(key, return_inverse=True)
        bound = np.bincount(back, self.top[rows], len(uniq)) + self.rest[uniq % self.blocks] if len(uniq) else np.zeros(0)
        live = uniq[bound >= border]
        alone = np.nonzero(self.rest >= border)[0]
        if len(alone):  # these blocks could do without any followed term
            live = np.unique(np.concatenate([live, (np.unique(window)[:, None] * self.blocks + alone).ravel()]))
        # the bounds of the blocks left, now with all terms
        kept = np.isin(window, np.unique(live // self.blocks))
        window, term = window[kept], term[kept]
        rows, owner = self._rows(self.top_start, term)
        key = window[owner] * self.blocks + self.top_block[rows]
        among = np.isin(key, live)
        uniq, back = np.unique(key[among], return_inverse=True)
        live = uniq[np.bincount(back, self.top[rows[among]], len(uniq)) >= border] if len(uniq) else uniq
        out = []
        hopes: dict[int, list[int]] = {}
        for k in live.tolist():
            hopes.setdefault(k // self.blocks, []).append(k % self.blocks)
        for x, blocks in hopes.items():
            a, b = np.searchsorted(window, (x, x + 1))
            out += [(x, item, score) for item, score in self.walk(term[a:b].tolist(), border, blocks)]
        return out

    def walk(self, terms: list[int], border: float, blocks: list[int]) -> list[tuple[int, float]]:
        """(item, score) of the items whose impacts on ``terms`` sum up to the border, by block-max WAND.

        ``blocks``: in ascending order, those whose maxima reach the border.
        """
        out = []
        hope = iter(blocks)
        block = next(hope)
        items, starts, mosts = self.items, self.starts, self.mosts
        # cursors: item, place, end, greatest impact; all begin at the first of the blocks
        lists = []
        for t in terms:
            end = starts[t + 1]
            at = bisect_left(items, block * BLOCK, starts[t], end)
            if at < end:
                lists.append([items[at], at, end, mosts[t]])

        def leap(cursor: list, item: int) -> None:
            cursor[1] = at = bisect_left(items, item, cursor[1], cursor[2])
            cursor[0] = items[at] if at < cursor[2] else -1

        while lists:
            lists.sort()
            total, last = 0.0, -1
            for last, x in enumerate(lists):
                total += x[3]
                if total >= border:
                    break
            else:
                break  # no item from here on can reach the border
            if block == self.blocks:
                break
            pivot = lists[last][0]
            while last + 1 < len(lists) and lists[last + 1][0] == pivot:
                last += 1
            while block < pivot // BLOCK:
                block = next(hope, self.blocks)
            if block > pivot // BLOCK:  # all lists leap past the blocks between
                for x in lists:
                    if x[0] < block * BLOCK:
                        leap(x, block * BLOCK)
            elif lists[0][0] == pivot:
                score = sum(self.impacts[x[1]] for x in lists[: last + 1])
                if score >= border:
                    out.append((pivot, score))
                for x in lists[: last + 1]:
                    leap(x, pivot + 1)
            else:
                for x in lists[:last]:
                    if x[0] < pivot:
                        leap(x, pivot)
            lists = [x for x in lists if x[0] >= 0]
        return out

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float, int]]]:
        """Per text: (item number, score, question overlap, answer overlap, first word of the passage)."""
        found: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
        size = max(PASSAGE, 2 * self.longest)
        stride = size // 2
        get = self.terms.get
        doc_words: list[list[str]] = []
        owners: list[tuple[int, int]] = []  # per window: text, first word
        base = 0
        w_parts: list[np.ndarray] = []
        t_parts: list[np.ndarray] = []

        def flush() -> None:
            nonlocal base
            if owners:
                pairs = np.unique(np.concatenate(w_parts) * len(self.terms) + np.concatenate(t_parts)) if w_parts else np.zeros(0, np.int64)
                if len(pairs):
                    for w, item, score in self.retrieve(pairs // len(self.terms), pairs % len(self.terms), len(owners)):
                        d, at = owners[w]
                        seen = grams(kept[d][at : at + size], self.size[item])
                        q, a, whole = self.question[item], self.answer[item], self.whole[item]
                        over = len(q & seen) / len(q), len(a & seen) / len(a)
                        leaked = min(over) >= OVERLAP or len(whole & seen) >= OVERLAP * len(whole)
                        if leaked and score > found[d].get(item, (0.0,))[0]:
                            found[d][item] = (score, *over, at)
            owners.clear()
            w_parts.clear()
            t_parts.clear()
            kept.clear()
            base = 0

        kept: dict[int, list[str]] = {}
        held = 0
        for d, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            at = np.nonzero(ids >= 0)[0]
            n = max(1, -(-(len(words) - stride) // stride)) if len(words) > size else 1
            kept[d] = words
            lead = at // stride
            for w in (np.minimum(lead, n - 1), np.minimum(np.maximum(lead - 1, 0), n - 1)):
                w_parts.append(base + w)
                t_parts.append(ids[at])
            owners.extend((d, k * stride) for k in range(n))
            base += n
            held += len(words)
            if held >= CHUNK:
                flush()
                held = 0
        flush()
        return [[(i, *v) for i, v in sorted(f.items())] for f in found]


def indexes(items: DataFrame, key: str, text: str, size: int = 0) -> Iterator[Index]:
    """Indexes of about ``size`` items (ITEMS), one at a time; statistics are those of all items."""
    size = size or ITEMS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                terms = sorted(set(words))
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(terms), pa.int64()), pa.array(terms), pa.array([len(words)] + [0] * (len(terms) - 1), pa.int64())], names=["h", "term", "words"])

    rows = items.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("id", "t"))
    terms = cut(rows.select("h", "t").mapInArrow(spread, "h long, term string, words long"))
    n, words = terms.agg(F.count_if(F.col("words") > 0), F.sum("words")).first()
    if not n:
        return
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    parts = -(-n // size)
    for k in range(parts):
        own = F.pmod("h", F.lit(parts)) == k
        kept = sorted(((r.id, r.t) for r in rows.filter(own).toLocalIterator() if words_of(r.t)), key=lambda x: (x[0] is None, x))
        if kept:
            told = df if parts == 1 else df.join(terms.filter(own).select("term").distinct(), "term", "left_semi")
            yield Index(kept, {r.term: r.df for r in told.toLocalIterator()}, n, words / n)


LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """A row for every document and item leaked into it, from its best passage."""
    names = [f.split()[0] for f in LEAK.split(", ")]
    narrow = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    out = None
    for index in indexes(items, item_key, text):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], index.ids[i], s, q, a, at) for d, found in enumerate(index.search(batch.column(1).to_pylist())) for i, s, q, a, at in found]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        got = narrow.mapInArrow(run, LEAK)
        out = got if out is None else out.union(got)
    return out if out is not None else docs.sparkSession.range(0).select(*(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in LEAK.split(", ")))


def clean(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The documents into which no item leaked, with all their columns; nothing is shuffled."""
    out = docs
    for index in indexes(items, item_key, text):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not f for f in index.search(batch.column(text).to_pylist())], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items leaked into documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
