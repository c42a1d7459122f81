"""Quality scores: ridge regression on random Fourier features, isotonically calibrated.

Every text becomes a short vector of document statistics (shares of character
classes, repetition of words, lines and bytes, function words, lengths). Random
Fourier features approximate a Gaussian kernel over the standardized vectors;
ridge regression on them needs only the sums of z z' and z y, which each
partition adds up on its own and a second level of tasks adds together. The
equations of two folds are kept apart, so each labelled row can be scored by a
model that has not seen it; isotonic regression of labels on those scores turns
raw scores into probabilities. It works on counts in fixed score bins, so it
covers all labelled rows in bounded memory.

Labels, language, source and id are never inputs of a score.

Rows whose crc32(id as text) mod 3 is 1 are held out of all learning. All other
labelled rows are used; there is no sample.

Defined results for odd input: a null text is empty; empty texts have all
statistics zero and are scored like any other; a null id is not held out and
never labelled; of repeated labels of an id the mean, rounded up, counts;
without labelled rows of either kind every score is 0.5; repeated rows are
scored alike; an empty table gives an empty result; other columns pass through
except those named like new ones, which are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistra.llm.common import cut, table

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that it for on with as are be this by from or an at was not "
        "le la les de des du et en un une que qui pour dans est sur par pas "
        "der die das und ist von mit den zu ein eine nicht auf für im sich "
        "el los las y que en una por con para del se su al es"
    ).split()
)
NAMES = (
    "chars", "words", "upper", "digit", "space", "bang", "mark", "symbol", "high", "newline",
    "word_length", "long_words", "distinct", "top_word", "again", "function", "bare", "lines_again", "line_length", "squeeze",
)
FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-2
BINS = 2048
#: Tasks that add up the sums of partitions before the driver does.
GROUPS = 16
SEED = 20240501
#: Keys of labels that are sent to all tasks at most.
TOLD = 500_000


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[np.frombuffer(chars.encode("latin-1"), np.uint8)] = 1
    return out


_CLASSES = np.stack([
    _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789"), _mask(" \t\r\n"), _mask("!?"), _mask(".,;:'\"()-"),
    _mask("#$%&*+/<=>@[\\]^_`{|}~"), (np.arange(256) >= 128).astype(float), _mask("\n"),
])


def statistics(text: str | None) -> np.ndarray:
    """The vector of one whole text, in the order of NAMES."""
    raw = (text or "").encode()
    out = np.zeros(len(NAMES))
    if not raw:
        return out
    n = len(raw)
    words = raw.split()
    k = len(words)
    shares = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    out[0], out[1] = np.log1p(n), np.log1p(k)
    out[2:10] = shares
    lines = raw.split(b"\n")
    if k:
        counts = Counter(words)
        out[10] = (n - shares[2] * n) / k
        out[11] = sum(c for w, c in counts.items() if len(w) > 20) / k
        out[12] = len(counts) / k
        out[13] = max(counts.values()) / k
        out[14] = sum(map(eq, words, words[1:])) / k
        out[15] = sum(map(counts.__getitem__, FUNCTION_WORDS & counts.keys())) / k
        out[16] = sum(c for w, c in counts.items() if w[-1:].isalpha() or w[-1] >= 128) / k
    out[17] = 1 - len(set(lines)) / len(lines)
    out[18] = np.log1p(n / len(lines))
    out[19] = len(zlib.compress(raw, 1)) / (n + 20)
    return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fold(key: Column) -> Column:
    """0 or 1 among the rows that are not held out."""
    return F.coalesce((F.crc32(key.cast("string")) % 3 == 2).cast("int"), F.lit(0))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardized statistics, with those and a constant."""
    rng = np.random.default_rng(SEED)
    omega = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    s = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(s @ omega + phase), s * 0.1, np.ones((len(x), 1))])


def statistics_of(docs: DataFrame, text: str = "text", out: str = "x") -> DataFrame:
    """Replaces the text by its statistics."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column(text)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), x], names=schema.names)

    return docs.mapInArrow(run, schema)


def _stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, len(NAMES)))


def _sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per fold: the sums of z z', z y and 1, added up within partitions, then in GROUPS groups of them."""
    size = FEATURES + len(mean) + 1

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for pdf in parts:
            for f, part in pdf.groupby("fold"):
                for at in range(0, len(part), 4096):
                    block = part.iloc[at : at + 4096]
                    z, y = expand(_stack(block["x"]), mean, scale), block["y"].to_numpy(float)
                    t = total.setdefault(int(f), [np.zeros((size, size)), np.zeros(size), 0.0])
                    t[0] += z.T @ z
                    t[1] += z.T @ y
                    t[2] += len(y)
        group = TaskContext.get().partitionId() % GROUPS
        for f, (g, c, n) in total.items():
            yield pd.DataFrame({"part": [group], "fold": [f], "g": [g.tobytes()], "c": [c.tobytes()], "n": [n]})

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for pdf in parts:
            for r in pdf.itertuples():
                t = total.setdefault(r.fold, [np.zeros(size * size), np.zeros(size), 0.0])
                t[0] += np.frombuffer(r.g)
                t[1] += np.frombuffer(r.c)
                t[2] += r.n
        for f, (g, c, n) in total.items():
            yield pd.DataFrame({"fold": [f], "g": [g.tobytes()], "c": [c.tobytes()], "n": [n]})

    kind = "fold int, g binary, c binary, n double"
    got = rows.mapInPandas(add, f"part int, {kind}").repartitionById(GROUPS, F.col("part")).mapInPandas(merge, kind).toLocalIterator()
    out: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
    for r in got:
        g, c, n = out.get(r.fold, (np.zeros((size, size)), np.zeros(size), 0.0))
        out[r.fold] = (g + np.frombuffer(r.g).reshape(size, size), c + np.frombuffer(r.c), n + r.n)
    return out


def _ridge(g: np.ndarray, c: np.ndarray, n: float) -> np.ndarray:
    penalty = np.full(len(g), RIDGE * max(n, 1.0) / FEATURES + 1e-6)
    penalty[-1] = 1e-6
    return np.linalg.solve(g + np.diag(penalty), c)


def isotonic(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the pooled blocks of adjacent violators."""
    blocks: list[list[float]] = []
    for at, p, n in zip(x, positive, total):
        blocks.append([at * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that have a label; the labels' keys are sent to all tasks where they are few."""
    keys = labels.select(F.col(key).alias("__key")).filter("__key is not null").distinct()
    near = F.broadcast(keys) if keys.count() <= TOLD else keys
    return docs.join(near, F.col(key) == F.col("__key"), "left_semi")


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """rows(key, x) and labels(key, label 0/1) -> a calibrated model; held-out rows are not used."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.ceil(F.avg(label) - 0.5).cast("int").alias("y"))
    free = rows.filter(F.col(key).isNotNull() & ~held_out(F.col(key)))
    train = cut(free.join(known, key).select("x", "y", fold(F.col(key)).alias("fold")))
    p = len(NAMES)
    x = [F.col("x")[i] for i in range(p)]
    got = train.agg(*map(F.avg, x), *map(F.stddev_pop, x), F.count("*"), F.sum("y")).first()
    n, ones = got[-2], got[-1] or 0
    if not n or ones in (0, n):
        return Model(np.zeros(p), np.ones(p), np.zeros(0), np.zeros(1), np.full(1, 0.5))
    mean, scale = np.array(got[:p], float), np.maximum(np.array(got[p : 2 * p], float), 1e-3)
    sums = _sums(train, mean, scale)
    g, c, n = (sum(s[i] for s in sums.values()) for i in range(3))
    weights = _ridge(g, c, n)
    other = {f: _ridge(*sums[1 - f]) if 1 - f in sums else weights for f in (0, 1)}

    def bins(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for f, part in pdf.groupby("fold"):
                raw = expand(_stack(part["x"]), mean, scale) @ other[int(f)]
                at = np.clip(((raw + 0.5) * (BINS / 2)).astype(int), 0, BINS - 1)
                yield pd.DataFrame({"bin": at, "y": part["y"].to_numpy()}).groupby("bin")["y"].agg(pos="sum", n="count").reset_index()

    counts = train.mapInPandas(bins, "bin int, pos long, n long").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).orderBy("bin").toPandas()
    centre = (counts["bin"].to_numpy() + 0.5) / (BINS / 2) - 0.5
    knots, values = isotonic(centre, counts["pos"].to_numpy(float), counts["n"].to_numpy(float))
    # a slight slope past the blocks keeps the order of raw scores
    return Model(mean, scale, weights, np.concatenate([[knots[0] - 1], knots, [knots[-1] + 1]]), np.concatenate([[values[0] * 0.5], values, [0.5 + values[-1] * 0.5]]))


def apply(rows: DataFrame, model: Model) -> DataFrame:
    """Replaces the statistics ``x`` by ``score``."""
    keep = [f for f in rows.schema.fields if f.name not in ("x", "score")]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(model.score(x))], names=schema.names)

    return rows.mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least ``least``, with all their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.vstack([statistics(t.as_py()) for t in batch.column(text)])
                yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document."""
    rows = cut(statistics_of(table(spark, sf_dir, "documents").select("doc_id", "text")))
    model = fit(rows, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return apply(rows.withColumn("held_out", held_out(F.col("doc_id"))), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
